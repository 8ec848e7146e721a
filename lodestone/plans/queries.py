"""One query for each operator family, with the SQL it is held against."""

from __future__ import annotations

import datetime
import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import ann, agent, chunk, economy, embed, evalset, events, index, judge, metrics, pack, pattern_index, rerank, retrieve
from lodestone.operators._state import kept
from lodestone.plans.base import BASE, C, GOLD, LEGS, RRF, TERMS, any_gold, bm, chunks, gold_of, interval, legs, lexical, norm, once, per_question, query, questions, resampled, sents, tok, weighted_sql
from lodestone.plans.retrieval import late_sql
from lodestone.sources import table

_legs = legs


def _gold(spark, sf):
    return any_gold(gold_of(spark, sf))


def _fused(spark, sf):
    c, q, a, b = _legs(spark, sf)
    return c, q, retrieve.rrf([a, b], 20)


# --- retrieval ----------------------------------------------------------------------------------------


@query(f"{BASE}, {TERMS}, {bm('la', 8)}, {GOLD}, {per_question('la', 8)} SELECT * FROM pm")
def bm25_evaluation(spark, sf):
    """The flagship: BM25 for all questions, gold by containment, metrics of each question."""
    q = questions(spark, sf)
    return metrics.retrieval_metrics(q, gold_of(spark, sf), lexical(spark, sf, 8), 8)


@query(f"{BASE}, {TERMS}, {bm('la', 10)} SELECT * FROM la")
def bm25_topk(spark, sf):
    return lexical(spark, sf, 10)


@query(f"{BASE}, {TERMS}, {bm('x1', 3, 0.9, 0.4)}, {bm('x2', 3, 1.2, 0.75)}, {bm('x3', 3, 2.0, 0.9)} SELECT 0.9 AS k1, 0.4 AS b, * FROM x1 UNION ALL SELECT 1.2, 0.75, * FROM x2 UNION ALL SELECT 2.0, 0.9, * FROM x3")
def bm25_grid(spark, sf):
    found = retrieve.postings(questions(spark, sf), chunks(spark, sf))
    parts = [retrieve.score(found, 3, k1, b).select(F.lit(k1).alias("k1"), F.lit(b).alias("b"), "*") for k1, b in ((0.9, 0.4), (1.2, 0.75), (2.0, 0.9))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


KNN_SQL = """k AS (SELECT * FROM (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM (
SELECT a.vec_id AS qid, b.vec_id AS chunk_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)) WHERE rank <= 10)"""


def _vectors(spark, sf):
    v = table(spark, sf, "embeddings")
    return v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"), "label"), v.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


@query(f"WITH {KNN_SQL} SELECT * FROM k")
def knn_exact_topk(spark, sf):
    q, v = _vectors(spark, sf)
    return retrieve.knn(q, v, 10)


@query(f"WITH {KNN_SQL} SELECT k.qid, round(avg(CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END), 6) AS precision FROM k JOIN embeddings a ON a.vec_id = k.qid JOIN embeddings b ON b.vec_id = k.chunk_id GROUP BY k.qid")
def knn_label_precision(spark, sf):
    q, v = _vectors(spark, sf)
    hits = retrieve.knn(q, v, 10).join(q.select("qid", F.col("label").alias("a")), "qid").join(v.select("chunk_id", F.col("label").alias("b")), "chunk_id")
    return hits.groupBy("qid").agg(F.round(F.avg((F.col("a") == F.col("b")).cast("double")), 6).alias("precision"))


@query()
def ann_ivf_recall(spark, sf):
    """Recall of inverted lists against exact search, and the share of vectors scored, by the number of cells probed."""
    q, v = _vectors(spark, sf)
    exact = kept(retrieve.knn(q, v, 10).select("qid", "chunk_id"))
    centers = embed.ivf_build(v, 16)
    parts = []
    for probes in (embed.PROBES, 10, 12):
        found = embed.ivf_search(q, v, centers, probes, 10).select("qid", "chunk_id")
        parts.append(metrics.ann_recall(found, exact).select(F.lit(probes).alias("probes"), "recall"))
    return functools.reduce(DataFrame.unionByName, parts)


def _cells(v: DataFrame) -> tuple[DataFrame, ann.Codebook, int]:
    book = ann.fit(v)
    return kept(ann.index(v, book)), book, ann.tune(v, book)


@query()
def ann_coded_topk(spark, sf):
    """Nearest vectors by coded cells, as many of them as neighbours of a few stored vectors call for."""
    q, v = _vectors(spark, sf)
    coded, book, probes = _cells(v)
    return ann.search(q, v, coded, book, probes)[0]


@query()
def ann_coded_recall(spark, sf):
    """Recall of coded cells, and the shares of vectors read as codes and scored exactly, by cells probed and codes kept."""
    q, v = _vectors(spark, sf)
    exact = kept(retrieve.knn(q, v, 10).select("qid", "chunk_id"))
    coded, book, tuned = _cells(v)
    n, parts = v.count(), []
    for probes, rescored in ((max(1, tuned // 2), 10), (tuned, 5), (tuned, 10)):
        found, looked = ann.search(q, v, coded, book, probes, rescored=rescored)
        shares = looked.agg(*(F.round(F.avg(c) / n, 6).alias(c) for c in ("coded", "scored")))
        size = [F.lit(x).alias(c) for c, x in (("n_vectors", n), ("cells", len(book.centers)), ("probes", probes), ("rescored", rescored))]
        parts.append(metrics.ann_recall(found, exact).crossJoin(shares).select(*size, "recall", "coded", "scored"))
    return functools.reduce(DataFrame.unionByName, parts)


DIMS = [4, 8, 16, 32, 64]
NESTED = f"""v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), d(dim) AS (VALUES {', '.join(f'({d})' for d in DIMS)}), p AS (SELECT dim, vec_id, e[1:dim] AS e, sqrt(list_dot_product(e[1:dim], e[1:dim])) AS m FROM v, d),
n AS MATERIALIZED (SELECT * FROM (SELECT dim, qid, chunk_id, score, row_number() OVER (PARTITION BY dim, qid ORDER BY score DESC, chunk_id) AS rank FROM (SELECT a.dim, a.vec_id AS qid, b.vec_id AS chunk_id, round(CASE WHEN a.m * b.m > 0 THEN list_dot_product(a.e, b.e) / (a.m * b.m) ELSE 0.0 END, 6) AS score FROM p a JOIN p b ON a.dim = b.dim WHERE a.vec_id % 50 = 0)) WHERE rank <= 10)"""


@query(f"WITH {NESTED} SELECT * FROM n")
def nested_prefixes(spark, sf):
    """Nearest vectors by five prefixes of the vectors, from one pass."""
    return ann.nested(*_vectors(spark, sf), DIMS)


@query(f"WITH {NESTED} SELECT x.dim, round(avg(CASE WHEN f.qid IS NULL THEN 0.0 ELSE 1.0 END), 6) AS overlap, round(avg(CASE WHEN x.rank = 1 THEN CASE WHEN f.rank = 1 THEN 1.0 ELSE 0.0 END END), 6) AS top1 FROM n x LEFT JOIN n f ON f.dim = 64 AND f.qid = x.qid AND f.chunk_id = x.chunk_id GROUP BY x.dim")
def dimension_ablation(spark, sf):
    """How much of what whole vectors find their prefixes find."""
    return ann.ablation(kept(ann.nested(*_vectors(spark, sf), DIMS)), DIMS[-1])


@query()
def neighbour_graph(spark, sf):
    """The ten nearest vectors of every vector."""
    return ann.neighbours(_vectors(spark, sf)[1], 10)


@query()
def ann_graph_recall(spark, sf):
    """Recall of a walk over a graph of neighbours, and the share of vectors it visits, over all vectors and over those
    that a filter allows."""
    q, v = _vectors(spark, sf)
    edges = kept(embed.knn_graph(v))
    n = v.count()
    parts = []
    for name, allowed in (("all", None), ("allowed", v.filter("label % 3 = 0"))):
        exact = retrieve.knn(q, v if allowed is None else allowed, 10).select("qid", "chunk_id")
        found, visits = embed.graph_search(q, v, edges, 10, 192, 8, allowed=allowed)
        share = visits.agg(F.round(F.avg("visits") / n, 6).alias("visited"))
        parts.append(metrics.ann_recall(found, exact).crossJoin(share).select(F.lit(name).alias("nodes"), "recall", "visited"))
    return parts[0].unionByName(parts[1])


@query(f"WITH {C}, pats(qid, pattern) AS (VALUES (0, 'licen[cs]e'), (1, '\\d{{3}}-\\d{{4}}'), (2, 'of the')), m AS (SELECT qid, chunk_id, CAST(len(regexp_extract_all(text, '(?i)' || pattern)) AS DOUBLE) AS score FROM pats, c) SELECT * FROM (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM m WHERE score > 0) WHERE rank <= 20")
def grep_topk(spark, sf):
    patterns = spark.sql("SELECT * FROM VALUES (0, 'licen[cs]e'), (1, '[0-9]{3}-[0-9]{4}'), (2, 'of the') AS t(qid, pattern)")
    return retrieve.grep(patterns, chunks(spark, sf), 20)


PATTERNS = {0: "licen[cs]e", 1: "[0-9]{3}-[0-9]{4}", 2: "of the", 3: "(apache|gnu general) licen", 4: "^[A-Z]{2,}", 5: "(creative )?commons", 6: "copyright.*reserved|warranty of any kind", 7: "e(re|n)+d", 8: "all rights"}
_VALUES = ", ".join(f"({qid}, '{pattern}')" for qid, pattern in PATTERNS.items())


@query(f"WITH {C}, pats(qid, pattern) AS (VALUES {_VALUES}), m AS (SELECT qid, chunk_id, CAST(len(regexp_extract_all(text, '(?i)' || pattern)) AS DOUBLE) AS score FROM pats, c) SELECT * FROM (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM m WHERE score > 0) WHERE rank <= 20")
def grep_indexed(spark, sf):
    """Patterns with literals, choices of some, optional ones and none, over a trigram index."""
    patterns = spark.createDataFrame(list(PATTERNS.items()), "qid int, pattern string")
    index_ = once(spark, sf, "trigrams", lambda: pattern_index.trigram_index(chunks(spark, sf)))
    return pattern_index.search(patterns, chunks(spark, sf), index_)


@query(f"{LEGS}, {RRF} SELECT * FROM fused")
def rrf_fusion(spark, sf):
    return _fused(spark, sf)[2]


@query(f"{LEGS} {weighted_sql(0.2)}")
def weighted_fusion(spark, sf):
    _, _, a, b = _legs(spark, sf)
    return retrieve.weighted(a, b, 0.2, 10)


@query(LEGS + " " + " UNION ALL ".join(f"SELECT {a} AS alpha, * FROM ({weighted_sql(a, 5)})" for a in (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7)))
def alpha_sweep(spark, sf):
    _, _, a, b = _legs(spark, sf)
    a, b = kept(a), kept(b)
    parts = [retrieve.weighted(a, b, x, 5).select(F.lit(x).alias("alpha"), "*") for x in (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7)]
    return functools.reduce(DataFrame.unionByName, parts)


@query(f"{LEGS} SELECT qid, CAST(sum(a * b) AS BIGINT) AS n_both, count(*) AS n_either FROM (SELECT qid, chunk_id, max(a) AS a, max(b) AS b FROM (SELECT qid, chunk_id, 1 AS a, 0 AS b FROM la UNION ALL SELECT qid, chunk_id, 0, 1 FROM lb) GROUP BY ALL) GROUP BY qid")
def leg_overlap(spark, sf):
    _, _, a, b = _legs(spark, sf)
    return retrieve.leg_overlap(a, b)


@query(f"{BASE}, {GOLD} SELECT * FROM g")
def gold_resolution(spark, sf):
    return _gold(spark, sf)


@query(f"{BASE}, {GOLD} SELECT qid FROM q WHERE qid NOT IN (SELECT qid FROM g)")
def unresolved_gold(spark, sf):
    q, c = questions(spark, sf), chunks(spark, sf)
    return retrieve.unresolved(q, _gold(spark, sf))


# --- text, filters ------------------------------------------------------------------------------------


@query(f"WITH {C} SELECT chunk_id, len({tok('text')}) AS n_tokens, len(list_distinct({tok('text')})) AS n_distinct, CAST(greatest(1, ceil(length(text) / 4.0)) AS INTEGER) AS approx, len({sents('text')}) AS n_sentences, md5({norm('text')}) AS norm FROM c")
def tokenize_stats(spark, sf):
    t = T.tokens(F.col("text"))
    return chunks(spark, sf).select("chunk_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"), T.approx_tokens(F.col("text")).alias("approx"), F.size(T.sentences(F.col("text"))).alias("n_sentences"), F.md5(F.encode(T.normalized(F.col("text")), "UTF-8")).alias("norm"))


@query(f"WITH {C} SELECT chunk_id, len(regexp_extract_all(upper(text), '[A-Z][A-Z0-9]{{2,}}(?:_[A-Z0-9]+)+|[A-Z]{{2,}}-\\d+')) AS n FROM c")
def identifier_probe(spark, sf):
    return chunks(spark, sf).select("chunk_id", F.size(T.identifiers(F.upper("text"))).alias("n"))


@query(f"WITH {C} SELECT source, count(*) AS n FROM c WHERE source IN ('src1', 'src2', 'src3') AND tenant = 'en' AND published >= '2024-02-01' AND published <= '2024-11-30' GROUP BY source")
def date_window_filter(spark, sf):
    return retrieve.filtered(chunks(spark, sf), ["src1", "src2", "src3"], "en", "2024-02-01", "2024-11-30").groupBy("source").agg(F.count("*").alias("n"))


PERSONAS = "personas(persona, groups) AS (VALUES ('analyst', ['src0', 'src1', 'src2']), ('guest', ['src3']), ('nobody', CAST([] AS VARCHAR[])))"


def _personas(spark):
    return spark.sql("SELECT * FROM VALUES ('analyst', array('src0', 'src1', 'src2')), ('guest', array('src3')), ('nobody', cast(array() AS array<string>)) AS t(persona, groups)")


@query(f"WITH {C}, {PERSONAS} SELECT persona, count(*) AS n FROM c JOIN personas ON list_contains(groups, source) GROUP BY persona")
def acl_prefilter(spark, sf):
    return retrieve.visible_to(chunks(spark, sf), _personas(spark)).groupBy("persona").agg(F.count("*").alias("n"))


@query(f"{BASE}, {TERMS}, {bm('la', 8)} SELECT qid, count(*) AS before, count(*) FILTER (source IN ('src0', 'src1', 'src2', 'src3', 'src4')) AS after, count(*) - count(*) FILTER (source IN ('src0', 'src1', 'src2', 'src3', 'src4')) AS k_collapse FROM la JOIN c USING (chunk_id) GROUP BY qid")
def acl_postfilter_kcollapse(spark, sf):
    c, q = chunks(spark, sf), questions(spark, sf)
    groups = q.select("qid", F.array(*(F.lit(f"src{i}") for i in range(5))).alias("groups"))
    return pack.k_collapse(lexical(spark, sf, 8), c, groups, 8)


# --- metrics ------------------------------------------------------------------------------------------


@query(f"{LEGS}, {RRF}, {per_question('fused', 8)} SELECT * FROM pm")
def rrf_evaluation(spark, sf):
    c, q, hits = _fused(spark, sf)
    return metrics.retrieval_metrics(q, gold_of(spark, sf), hits, 8)


@query(f"{LEGS}, ks(k) AS (VALUES (1), (3), (8), (20)) SELECT k, round(avg(f), 6) AS recall FROM (SELECT k, g.qid, max(CASE WHEN la.rank <= k THEN 1.0 ELSE 0.0 END) AS f FROM g CROSS JOIN ks LEFT JOIN la ON la.qid = g.qid AND la.chunk_id = g.chunk_id GROUP BY ALL) GROUP BY k")
def k_sweep(spark, sf):
    a = lexical(spark, sf, 50)
    found = _gold(spark, sf).join(a.select("qid", "chunk_id", "rank"), ["qid", "chunk_id"], "left").groupBy("qid").agg(F.min("rank").alias("r"))
    ks = spark.range(1).select(F.explode(F.array(*map(F.lit, (1, 3, 8, 20)))).alias("k"))
    return found.crossJoin(F.broadcast(ks)).groupBy("k").agg(F.round(F.avg(F.coalesce((F.col("r") <= F.col("k")).cast("double"), F.lit(0.0))), 6).alias("recall"))


@query(f"{LEGS} SELECT q.qid, round(coalesce(p, 0.0), 6) AS context_precision FROM q LEFT JOIN (SELECT la.qid, avg(CASE WHEN g.chunk_id IS NULL THEN 0.0 ELSE 1.0 END) AS p FROM la LEFT JOIN g USING (qid, chunk_id) WHERE rank <= 8 GROUP BY la.qid) USING (qid)")
def context_precision(spark, sf):
    c, q, a = chunks(spark, sf), questions(spark, sf), lexical(spark, sf, 50)
    return metrics.context_precision(a, _gold(spark, sf), q, 8)


@query(f"{LEGS} SELECT q.qid, round(coalesce(x, 1.0), 6) AS ceiling FROM q LEFT JOIN (SELECT g.qid, avg(CASE WHEN la.chunk_id IS NULL THEN 0.0 ELSE 1.0 END) AS x FROM g LEFT JOIN la ON la.qid = g.qid AND la.chunk_id = g.chunk_id AND la.rank <= 20 GROUP BY g.qid) USING (qid)")
def reranker_ceiling(spark, sf):
    c, q, a = chunks(spark, sf), questions(spark, sf), lexical(spark, sf, 50)
    return rerank.ceiling(q, _gold(spark, sf), a, 20)


ABST = "x AS (SELECT qid, qid NOT IN (SELECT qid FROM g) AS is_null, coalesce((SELECT max(score) FROM la WHERE la.qid = q.qid), 0) AS s FROM q)"
ABST_SQL = "count(*) FILTER (is_null AND s < {t}) AS tp, count(*) FILTER (NOT is_null AND s < {t}) AS fp, count(*) FILTER (is_null AND NOT s < {t}) AS fn"
PRF = "round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 6) AS recall, round(CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) ELSE 0.0 END, 6) AS f1"


def _abstaining(spark, sf):
    c, q, a = chunks(spark, sf), questions(spark, sf), lexical(spark, sf, 50)
    best = a.groupBy("qid").agg(F.max("score").alias("s"))
    gold = _gold(spark, sf).select("qid").distinct().withColumn("g", F.lit(True))
    return q.select("qid").join(best, "qid", "left").join(gold, "qid", "left").select("qid", F.col("g").isNull().alias("is_null"), F.coalesce("s", F.lit(0.0)).alias("s"))


@query(f"{LEGS}, {ABST} SELECT {PRF}, fn AS false_answers, fp AS over_refusals FROM (SELECT {ABST_SQL.format(t=30)} FROM x)")
def abstention_scores(spark, sf):
    return metrics.abstention(_abstaining(spark, sf), F.col("is_null"), F.col("s") < 30)


@query(f"{LEGS}, {ABST} " + " UNION ALL ".join(f"SELECT {t} AS threshold, {PRF} FROM (SELECT {ABST_SQL.format(t=t)} FROM x)" for t in (10, 20, 30, 40)))
def threshold_sweep(spark, sf):
    rows = _abstaining(spark, sf)
    parts = [metrics.abstention(rows, F.col("is_null"), F.col("s") < t).select(F.lit(t).alias("threshold"), "precision", "recall", "f1") for t in (10, 20, 30, 40)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"{LEGS} SELECT count(*) AS n, round(avg(score), 6) AS mean, list_sort(list(score))[greatest(1, CAST(floor(count(*) * 0.95) AS INTEGER))] AS p95 FROM la WHERE rank = 1")
def summary_p95(spark, sf):
    a = lexical(spark, sf, 50)
    best = kept(a.filter("rank = 1"))
    return best.agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean")).crossJoin(metrics.ranked_value(best, "score", 0.95).select(F.col("value").alias("p95")))


@query("SELECT coalesce(l.quality::VARCHAR, '?') AS quality, count(*) AS n, round(avg(n_chars), 3) AS n_chars, round(avg(l.toxic), 3) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def slice_report(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return metrics.slice_report(rows, "quality", ["n_chars", "toxic"])


@query("SELECT lang, source, count(*) AS n, round(avg(n_chars), 3) AS n_chars FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def slice_grouping_sets(spark, sf):
    table(spark, sf, "documents").createOrReplaceTempView("_slices")
    return spark.sql("SELECT lang, source, count(*) AS n, round(avg(n_chars), 3) AS n_chars FROM _slices GROUP BY GROUPING SETS ((lang), (source), ())")


MISS = "ml AS (SELECT qid FROM g GROUP BY qid HAVING qid NOT IN (SELECT g.qid FROM g JOIN la USING (qid, chunk_id) WHERE rank <= 1)), md AS (SELECT qid FROM g GROUP BY qid HAVING qid NOT IN (SELECT g.qid FROM g JOIN lb USING (qid, chunk_id) WHERE rank <= 1))"


@query(f"{LEGS}, {MISS}, x AS (SELECT (SELECT count(*) FROM md) AS n_dense, (SELECT count(*) FROM ml) AS n_lexical, (SELECT count(*) FROM ml JOIN md USING (qid)) AS n_both, (SELECT count(*) FROM (SELECT qid FROM ml UNION SELECT qid FROM md)) AS n_either) SELECT *, round(CASE WHEN n_dense > 0 THEN n_both / n_dense ELSE 0.0 END, 6) AS conditional, round(CASE WHEN n_either > 0 THEN n_both / n_either ELSE 0.0 END, 6) AS jaccard FROM x")
def failure_overlap(spark, sf):
    c, q, a, b = _legs(spark, sf)
    gold = _gold(spark, sf)
    missed = [gold.select("qid").distinct().join(leg.filter("rank <= 1").join(gold, ["qid", "chunk_id"]).select("qid"), "qid", "left_anti") for leg in (a, b)]
    return metrics.failure_overlap(missed[0], missed[1])


@query(f"{LEGS}, f AS (SELECT ga.qid, anchor_idx, max(CASE WHEN la.qid IS NULL THEN 0.0 ELSE 1.0 END) AS f FROM ga LEFT JOIN (SELECT * FROM la WHERE rank <= 3) la ON la.qid = ga.qid AND la.chunk_id = ga.chunk_id GROUP BY ALL), pq AS (SELECT qid, round(avg(f), 6) AS r, min(f) AS c, count(*) AS k FROM f GROUP BY qid), m AS (SELECT avg(r) AS a, sum(round(r * k)) / sum(k) AS i, avg(c) AS full FROM pq), g2 AS (SELECT avg(pow(a, k)) AS pa, avg(pow(i, k)) AS pi FROM pq, m) SELECT round(a, 4) AS macro, round(i, 4) AS micro, round(full, 4) AS full_chain, round(pa, 4) AS predicted_macro, round(pi, 4) AS predicted_micro, round(full - pa, 4) AS delta_macro, round(full - pi, 4) AS delta_micro FROM m, g2".replace(" full FROM", ' "full" FROM').replace("round(full", 'round("full"'))
def independence_prediction(spark, sf):
    a = lexical(spark, sf, 50)
    return metrics.independence_report(gold_of(spark, sf), a.filter("rank <= 3"))


@query("WITH p AS (SELECT quality AS a, toxic AS b FROM labels), c AS (SELECT a, b, count(*) AS n FROM p GROUP BY ALL), t AS (SELECT sum(n) AS t, coalesce(sum(n) FILTER (a = b), 0) AS agree FROM c), e AS (SELECT sum(x.n * y.n) AS c FROM (SELECT a, sum(n) AS n FROM c GROUP BY a) x JOIN (SELECT b, sum(n) AS n FROM c GROUP BY b) y ON a = b) SELECT round(CASE WHEN c / (t * t) = 1 THEN 1.0 ELSE (agree / t - c / (t * t)) / (1 - c / (t * t)) END, 6) AS kappa, round(agree / t, 6) AS agreement, CAST(t AS BIGINT) AS n FROM t, e")
def cohens_kappa(spark, sf):
    return metrics.kappa(table(spark, sf, "labels"), "quality", "toxic")


BOOT = f"pairs AS (SELECT doc_id AS qid, toxic - quality AS d FROM labels), {resampled('pairs', 'ms', 200)}, x AS (SELECT (SELECT round(avg(d), 6) FROM pairs) AS delta, {interval('ms', 200)}, (SELECT round(avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END), 6) FROM ms) AS p_better)"


@query(f"WITH {BOOT} SELECT *, CASE WHEN lo > 0 OR hi < 0 THEN 'real' ELSE 'inside the noise band' END AS verdict FROM x")
def bootstrap_ci(spark, sf):
    return metrics.paired_bootstrap(table(spark, sf, "labels").select(F.col("doc_id").alias("qid"), F.col("quality").alias("a"), F.col("toxic").alias("b")), 200)


@query("SELECT metric, baseline, current, round(current - baseline, 6) AS delta, CASE WHEN round(current - baseline, 6) < -tolerance THEN 'BLOCK' ELSE 'ok' END AS gate FROM (SELECT 'quality' AS metric, 0.9 AS baseline, round(avg(quality), 6) AS current, 0.02 AS tolerance FROM labels UNION ALL SELECT 'clean', 0.8, round(1 - avg(toxic), 6), 0.03 FROM labels)")
def release_gate(spark, sf):
    now = table(spark, sf, "labels").agg(F.round(F.avg("quality"), 6).alias("quality"), F.round(1 - F.avg("toxic"), 6).alias("clean"))
    baseline = spark.sql("SELECT * FROM VALUES ('quality', 0.9D, 0.02D), ('clean', 0.8D, 0.03D) AS t(metric, baseline, tolerance)")
    return metrics.gate(now.unpivot([], ["quality", "clean"], "metric", "current"), baseline)


# --- chunking -----------------------------------------------------------------------------------------

WORDS = "list_filter(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' '), lambda w: w <> '')"
FIXED = f"w AS (SELECT doc_id, {WORDS} AS w FROM documents), pos AS (SELECT doc_id, w, unnest(range(0, CAST(greatest(0, ceil((len(w) - 48) / 40.0)) AS BIGINT) + 1)) AS ordinal FROM w WHERE len(w) > 0), f AS (SELECT doc_id, ordinal, array_to_string(list_slice(w, ordinal * 40 + 1, ordinal * 40 + 48), ' ') AS text FROM pos)"


def _docs(spark, sf):
    return chunks(spark, sf).select("doc_id", "title", "text", F.array().cast("array<string>").alias("entities"))


@query(f"WITH {FIXED} SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, count(*) OVER (PARTITION BY doc_id) AS n_chunks, text, concat_ws(':', doc_id, ordinal, substr(sha1(text), 1, 10)) AS chunk_id FROM f")
def chunk_fixed(spark, sf):
    return chunk.fixed(_docs(spark, sf), 64, 0.15)


LINES = f"ln AS (SELECT doc_id, title, i AS passage, x AS text FROM (SELECT doc_id, title, unnest(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS x, generate_subscripts(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), 1) AS i FROM c)), lw AS (SELECT *, {WORDS} AS w FROM ln), pieces AS (SELECT doc_id, title, passage, 0 AS n, trim(text) AS t FROM lw WHERE len(w) <= 48 UNION ALL SELECT doc_id, title, passage, n, array_to_string(list_slice(w, n * 43 + 1, n * 43 + 48), ' ') FROM (SELECT *, unnest(range(0, CAST(ceil((len(w) - 48) / 43.0) AS BIGINT) + 1)) AS n FROM lw WHERE len(w) > 48)), s AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY passage, n) - 1 AS ordinal, trim(title || chr(10) || t) AS text FROM pieces)"


@query(f"WITH {C}, {LINES} SELECT doc_id, ordinal, count(*) OVER (PARTITION BY doc_id) AS n_chunks, text, concat_ws(':', doc_id, ordinal, substr(sha1(text), 1, 10)) AS chunk_id FROM s")
def chunk_structural(spark, sf):
    return chunk.structural(_docs(spark, sf), 64)


@query(f"WITH {C}, {LINES}, x AS (SELECT doc_id, ordinal, trim('From a document about ' || CASE WHEN c.doc_id % 2 = 0 AND len({tok('c.title')}) > 0 THEN array_to_string(list_slice({tok('c.title')}, 1, 3), ', ') ELSE c.title END || '.' || chr(10) || s.text) AS text FROM s JOIN c USING (doc_id)) SELECT doc_id, ordinal, count(*) OVER (PARTITION BY doc_id) AS n_chunks, text, concat_ws(':', doc_id, ordinal, substr(sha1(text), 1, 10)) AS chunk_id FROM x")
def chunk_contextual(spark, sf):
    return chunk.contextual(_docs(spark, sf).withColumn("entities", F.when(F.col("doc_id") % 2 == 0, F.slice(T.tokens(F.col("title")), 1, 4)).otherwise(F.col("entities"))), 64)


FIRST90 = f"tk AS (SELECT doc_id, {tok('text')} AS t FROM c), ctx AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS ctx FROM (SELECT doc_id, x, p, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS r FROM (SELECT doc_id, x, min(p) AS p FROM (SELECT doc_id, unnest(t) AS x, generate_subscripts(t, 1) AS p FROM tk) GROUP BY ALL)) WHERE r <= 90 GROUP BY doc_id)"


@query(f"WITH {C}, {LINES}, {FIRST90} SELECT doc_id, ordinal, md5('[doc-context] ' || coalesce(ctx, '') || chr(10) || s.text) AS embed_md5 FROM s LEFT JOIN ctx USING (doc_id)")
def chunk_late(spark, sf):
    return chunk.late(_docs(spark, sf), 64).select("doc_id", "ordinal", F.md5(F.encode("embed_text", "UTF-8")).alias("embed_md5"))


@query(f"WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents), pa AS (SELECT doc_id, parent, array_to_string(list_slice(w, parent * 240 + 1, parent * 240 + 240), ' ') AS text FROM (SELECT doc_id, w, unnest(range(0, CAST(greatest(0, ceil((len(w) - 240) / 240.0)) AS BIGINT) + 1)) AS parent FROM w WHERE len(w) > 0)), pw AS (SELECT *, string_split(text, ' ') AS w FROM pa) SELECT doc_id, CAST(parent AS INTEGER) AS parent, CAST(child AS INTEGER) AS child, 'child::' || substr(array_to_string(list_slice(w, child * 48 + 1, child * 48 + 48), ' '), 1, 80) AS heading, text FROM (SELECT *, unnest(range(0, CAST(greatest(0, ceil((len(w) - 48) / 48.0)) AS BIGINT) + 1)) AS child FROM pw)")
def chunk_parent(spark, sf):
    return chunk.parent(_docs(spark, sf), 64, 320)


@query()
def chunk_recursive(spark, sf):
    return chunk.recursive(_docs(spark, sf), 128, 0.1)


@query()
def chunk_semantic(spark, sf):
    return chunk.semantic(_docs(spark, sf), 128, 0.22)


@query(f"WITH {FIXED}, z AS (SELECT CAST(greatest(1, ceil(length(text) / 4.0)) AS INTEGER) AS n FROM f) SELECT count(*) AS chunks, CAST(floor(median(n)) AS BIGINT) AS median, list_sort(list(n))[CAST(floor(count(*) * 0.9) AS INTEGER) + 1] AS p90, max(n) AS largest, CAST(sum(n) AS BIGINT) AS total, 1.0 AS storage_x FROM z")
def chunk_stats(spark, sf):
    return chunk.chunk_stats(chunk.fixed(_docs(spark, sf), 64, 0.15))


# --- index life cycle ---------------------------------------------------------------------------------

IDX = "idx AS (SELECT doc_id AS chunk_id, 'v1' AS index_version, doc_id, text, 'lsa@1:d96' AS embedder_tag, doc_id % 7 = 0 AS tombstoned FROM documents), new AS (SELECT CASE WHEN doc_id % 4 = 0 THEN doc_id + 1000000000 ELSE doc_id END AS chunk_id, 'v1' AS index_version, doc_id, text || ' (2)' AS text, CASE WHEN doc_id % 10 = 0 THEN 'lsa@1:d96' ELSE 'hash@1:d192' END AS embedder_tag FROM documents), up AS (SELECT * FROM idx WHERE chunk_id NOT IN (SELECT chunk_id FROM new) UNION ALL SELECT *, false FROM new)"


def _index(spark, sf):
    """All documents in an older state and in a newer one, in which some have other ids."""
    d = table(spark, sf, "documents")
    old = d.select(F.col("doc_id").alias("chunk_id"), F.lit("v1").alias("index_version"), "doc_id", "text", F.lit("lsa@1:d96").alias("embedder_tag"), (F.col("doc_id") % 7 == 0).alias("tombstoned"))
    renamed = F.when(F.col("doc_id") % 4 == 0, F.col("doc_id") + 1000000000).otherwise(F.col("doc_id"))
    new = d.select(renamed.alias("chunk_id"), F.lit("v1").alias("index_version"), "doc_id", F.concat("text", F.lit(" (2)")).alias("text"), F.when(F.col("doc_id") % 10 == 0, "lsa@1:d96").otherwise("hash@1:d192").alias("embedder_tag"))
    return old, new


@query(f"WITH {IDX} SELECT chunk_id, index_version, doc_id, md5(text) AS text_md5, embedder_tag, tombstoned FROM up")
def upsert_merge(spark, sf):
    return index.upsert(*_index(spark, sf)).select("chunk_id", "index_version", "doc_id", F.md5(F.encode("text", "UTF-8")).alias("text_md5"), "embedder_tag", "tombstoned")


@query(f"WITH {IDX} SELECT chunk_id FROM idx WHERE NOT (tombstoned OR chunk_id % 11 = 0)")
def tombstone_compact(spark, sf):
    old, _ = _index(spark, sf)
    return index.compact(index.tombstone(old, old.filter("chunk_id % 11 = 0").select("chunk_id"), "v1"), "v1").select("chunk_id")


@query(f"WITH {IDX} SELECT chunk_id, CASE WHEN i.chunk_id IS NOT NULL AND n.chunk_id IS NOT NULL THEN 'stable' WHEN n.chunk_id IS NOT NULL THEN 'new' ELSE 'orphaned' END AS state FROM idx i FULL JOIN new n USING (chunk_id)")
def incremental_diff(spark, sf):
    return index.diff(*_index(spark, sf))


@query(f"WITH {IDX} SELECT embedder_tag, count(*) AS n, count(*) OVER () <= 1 AS ok FROM up WHERE NOT tombstoned GROUP BY embedder_tag")
def mixed_version_check(spark, sf):
    return index.mixed_versions(index.upsert(*_index(spark, sf)), "v1")


@query(f"WITH {IDX} SELECT index_version, count(*) AS n_rows, count(*) FILTER (tombstoned) AS n_dead, count(DISTINCT doc_id) AS n_docs, count(DISTINCT embedder_tag) AS n_tags FROM up GROUP BY index_version")
def index_stats(spark, sf):
    return index.index_stats(index.upsert(*_index(spark, sf)))


@query(f"WITH {C} SELECT count(*) AS n, min(chunk_id) AS first_id FROM c GROUP BY array_to_string(list_sort(list_distinct({tok('text')})), ' ') HAVING count(*) > 1")
def duplicate_chunks(spark, sf):
    return index.duplicates(chunks(spark, sf), T.tokens(F.col("text")))


@query(f"WITH {C} SELECT tenant, count(*) AS n, min(published) AS published, CASE WHEN count(DISTINCT source) = 1 THEN min(source) ELSE '' END AS acl FROM c GROUP BY tenant")
def case_groups(spark, sf):
    return index.case_groups(chunks(spark, sf), "tenant").withColumn("acl", F.array_join("acl", ","))


# --- reranking, packing, answers ----------------------------------------------------------------------

FEAT = f"""tp AS (SELECT * FROM la WHERE rank <= 20), {late_sql('ms', 64, 'tp')}, qd AS (SELECT qid, {tok('query')} AS qt, list_distinct({tok('query')}) AS qs FROM q), f0 AS (SELECT la.qid, la.chunk_id, la.rank, qt, qs, ct.t AS dt, len(ct.t) AS dl, avg(len(ct.t)) OVER (PARTITION BY la.qid) AS avgdl, lower(c.text) AS low, list_distinct({tok('c.title')}) AS head, list_filter(qs, lambda x: list_contains(ct.t, x)) AS present FROM la JOIN qd USING (qid) JOIN ct USING (chunk_id) JOIN c USING (chunk_id) WHERE la.rank <= 20),
feat AS (SELECT qid, chunk_id, rank, round(CASE WHEN len(qs) > 0 AND dl > 0 THEN len(present) / len(qs) / (0.45 + 0.55 * dl / greatest(1.0, avgdl)) ELSE 0.0 END, 6) AS coverage,
round(CASE WHEN len(present) >= 2 THEN len(present) / greatest(len(present), list_max(list_transform(present, lambda x: dl + 1 - list_position(list_reverse(dt), x))) - list_min(list_transform(present, lambda x: list_position(dt, x))) + 1) WHEN len(present) = 1 THEN 0.3 ELSE 0.0 END, 6) AS proximity,
round(CASE {' '.join(f"WHEN len(qt) >= {s} AND list_bool_or(list_transform(range(1, greatest(2, len(qt) - {s} + 2)), lambda i: contains(low, array_to_string(list_slice(qt, i, i + {s} - 1), ' ')))) THEN {s}" for s in range(6, 1, -1))} ELSE 0 END / greatest(2, len(qt)), 6) AS phrase,
round(CASE WHEN len(qs) > 0 THEN len(list_intersect(qs, head)) / len(qs) ELSE 0.0 END, 6) AS title, round(coalesce(ms.m, 0.0), 6) AS maxsim, round(list_dot_product(hq.v, hc.v), 6) AS doc_cosine, 0.0 AS exact_id, round(ln(1 + dl) / 8, 6) AS length FROM f0 JOIN hq USING (qid) JOIN hc USING (chunk_id) LEFT JOIN ms USING (qid, chunk_id))"""


def _features(spark, sf):
    c, q, a = chunks(spark, sf), questions(spark, sf), lexical(spark, sf, 50)
    return rerank.pair_features(a.filter("rank <= 20"), q, c)


@query(f"{LEGS}, {FEAT} SELECT * FROM feat")
def pair_features(spark, sf):
    return _features(spark, sf)


@query(f"{LEGS}, {FEAT}, sc AS (SELECT qid, chunk_id, rank AS r0, round(1 / (1 + exp(-(1.1148 * coverage + 0.1382 * proximity - 0.5067 * phrase + 0.5836 * title - 0.0590 * maxsim + 1.2589 * doc_cosine + 0.6051 * exact_id - 0.7266 * length - 0.7722))), 6) AS score FROM feat) SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY r0 <= 10 DESC, CASE WHEN r0 <= 10 THEN -score END, r0) AS rank FROM sc")
def logistic_rerank(spark, sf):
    return rerank.logistic(_features(spark, sf), depth=10)


@query(f"{BASE}, {TERMS}, {bm('la', 8)} SELECT qid, chunk_id, CASE WHEN n < 3 OR rank = 1 THEN rank WHEN rank = 2 THEN n ELSE rank - 1 END AS place FROM (SELECT *, count(*) OVER (PARTITION BY qid) AS n FROM la)")
def edges_order(spark, sf):
    return pack.edges_order(lexical(spark, sf, 8))


@query(f"""{BASE}, {TERMS}, {bm('la', 20)}, h AS (SELECT la.qid, la.rank, la.chunk_id, CAST(greatest(1, ceil(length(text) / 4.0)) AS BIGINT) AS n FROM la JOIN c USING (chunk_id)),
r AS (WITH RECURSIVE z AS (SELECT qid, 0 AS pos, CAST(0 AS BIGINT) AS used, 0 AS k, CAST([] AS BIGINT[]) AS ids FROM (SELECT DISTINCT qid FROM h) UNION ALL SELECT z.qid, z.pos + 1, CASE WHEN k < 8 AND used + n <= 3000 THEN used + n ELSE used END, CASE WHEN k < 8 AND used + n <= 3000 THEN k + 1 ELSE k END, CASE WHEN k < 8 AND used + n <= 3000 THEN list_append(ids, chunk_id) ELSE ids END FROM z JOIN h ON h.qid = z.qid AND h.rank = z.pos + 1) SELECT * FROM z),
l AS (SELECT r.* FROM r JOIN (SELECT qid, max(pos) AS pos FROM r GROUP BY qid) USING (qid, pos)) SELECT qid, unnest(ids) AS chunk_id, CAST(generate_subscripts(ids, 1) AS INTEGER) AS rank, used FROM l""")
def pack_budget(spark, sf):
    c, q = chunks(spark, sf), questions(spark, sf)
    hits = lexical(spark, sf, 20).join(c.select("chunk_id", T.approx_tokens(F.col("text")).alias("n_tokens")), "chunk_id")
    return pack.pack(hits, 8, 3000)


@query(f"""{BASE}, {TERMS}, {bm('la', 10)}, h AS (SELECT la.qid, la.rank, la.chunk_id, list_distinct(t) AS t FROM la JOIN ct USING (chunk_id)),
sim AS (SELECT a.qid, a.rank AS ra, b.rank AS rb FROM h a JOIN h b ON a.qid = b.qid AND a.rank < b.rank WHERE len(list_intersect(a.t, b.t)) >= 0.82 * (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) AND len(a.t) + len(b.t) > 0),
z AS (WITH RECURSIVE y AS (SELECT qid, 0 AS pos, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT qid FROM h) UNION ALL SELECT y.qid, pos + 1, CASE WHEN EXISTS (SELECT 1 FROM sim WHERE sim.qid = y.qid AND rb = pos + 1 AND list_contains(kept, ra)) THEN kept ELSE list_append(kept, pos + 1) END FROM y JOIN h ON h.qid = y.qid AND h.rank = pos + 1) SELECT * FROM y),
l AS (SELECT z.* FROM z JOIN (SELECT qid, max(pos) AS pos FROM z GROUP BY qid) USING (qid, pos)), o AS (SELECT qid, unnest(kept) AS r, generate_subscripts(kept, 1) AS rank FROM l) SELECT o.qid, h.chunk_id, CAST(o.rank AS INTEGER) AS rank FROM o JOIN h ON h.qid = o.qid AND h.rank = o.r""")
def dedup_greedy(spark, sf):
    c, q = chunks(spark, sf), questions(spark, sf)
    hits = lexical(spark, sf, 10).join(c.select("chunk_id", T.tokens(F.col("text")).alias("tokens")), "chunk_id")
    return pack.dedup(hits.withColumn("tokens", F.array_distinct("tokens")), 0.82)


JB = f"{BASE}, {TERMS}, {bm('la', 4)}, bl AS (SELECT qid, {tok('text')} AS bt FROM la JOIN c USING (chunk_id)), cl AS (SELECT qid, generate_subscripts(s, 1) AS i, unnest(s) AS claim FROM (SELECT qid, list_filter({sents('anchor')}, lambda s: length(s) > 12) AS s FROM q)), sup AS (SELECT cl.qid, i, max(CASE WHEN len(list_distinct({tok('claim')})) = 0 THEN 1.0 ELSE coalesce(len(list_intersect(list_distinct({tok('claim')}), bt)) / len(list_distinct({tok('claim')})), 0.0) END) AS best FROM cl LEFT JOIN bl USING (qid) GROUP BY ALL), pr AS (SELECT qid, count(*) AS n_claims, count(*) FILTER (best < 0.5) AS n_bad FROM sup GROUP BY qid)"


@query(f"{JB} SELECT q.qid, coalesce(n_claims, 0) AS n_claims, coalesce(n_bad, 0) AS n_bad, CASE WHEN coalesce(n_claims, 0) = 0 THEN 1.0 ELSE round(1 - n_bad / n_claims, 6) END AS score, CASE WHEN coalesce(n_bad, 0) = 0 THEN 'pass' ELSE 'fail' END AS label FROM q LEFT JOIN pr USING (qid)")
def judge_faithfulness(spark, sf):
    c, q = chunks(spark, sf), questions(spark, sf)
    blocks = lexical(spark, sf, 4).join(c.select("chunk_id", "text"), "chunk_id")
    return judge.faithfulness(q.select("qid", F.col("anchor").alias("answer")), blocks)


@query(f"{BASE}, k AS (SELECT qid, list_transform(list_filter(string_split(regexp_replace(anchor, '\\band\\b|,|;', chr(1), 'g'), chr(1)), lambda p: length(trim(p)) > 8), lambda p: list_slice(list_filter({tok('p')}, lambda t: length(t) > 3), 1, 6)) AS keys, {tok('query')} AS a FROM q), m AS (SELECT qid, len(keys) AS n_parts, len(list_filter(keys, lambda k: len(k) > 0 AND len(list_filter(k, lambda t: list_contains(a, t))) < 0.25 * len(k))) AS n_missing FROM k) SELECT *, round(1 - n_missing / greatest(1, n_parts), 6) AS score FROM m")
def judge_completeness(spark, sf):
    q = questions(spark, sf)
    return judge.completeness(q.select("qid", F.col("anchor").alias("query"), F.col("query").alias("answer")))


@query(f"{BASE}, k AS (SELECT qid, query, list_slice(list_filter(string_split_regex(lower(anchor), '[^a-z0-9$%.]+'), lambda t: length(t) > 2), 1, 6) AS k FROM q) SELECT qid, CASE WHEN len(k) > 0 AND len(list_filter(k, lambda t: contains(lower(query), t))) / len(k) >= 0.6 THEN 1.0 ELSE 0.0 END AS correct FROM k")
def answer_correct(spark, sf):
    return judge.answer_correct(questions(spark, sf).select("qid", F.col("query").alias("answer"), F.col("anchor").alias("gold")))


# --- costs, caches, decisions, events -----------------------------------------------------------------

TOKS = "CAST(greatest(1, ceil(length(text) / 4.0)) AS BIGINT)"


@query(f"SELECT role, CAST(sum({TOKS}) AS BIGINT) AS n_tokens, round(sum(CASE WHEN role = 'assistant' THEN {TOKS} * 15.0 ELSE {TOKS} * 3.0 END) / 1e6, 6) AS cost FROM conversations GROUP BY role")
def token_cost(spark, sf):
    n = T.approx_tokens(F.col("text")).cast("long")
    rows = table(spark, sf, "conversations").select("role", n.alias("n"))
    cost = economy.Rates().cost(F.when(F.col("role") == "assistant", 0).otherwise(F.col("n")), F.when(F.col("role") == "assistant", F.col("n")).otherwise(0))
    return rows.groupBy("role").agg(F.sum("n").alias("n_tokens"), F.round(F.sum(cost), 6).alias("cost"))


SEQ = "r AS (SELECT conv_id % 16 AS tenant, row_number() OVER (PARTITION BY conv_id % 16 ORDER BY conv_id, turn, role, text) AS seq, coalesce(role, '') || ':' || coalesce(text, '') AS prefix FROM conversations)"


@query(f"WITH {SEQ} SELECT tenant, seq, coalesce(seq - lag(seq) OVER (PARTITION BY tenant, prefix ORDER BY seq) <= 40, false) AS hit FROM r")
def prompt_cache_hits(spark, sf):
    """Whole messages as what is cached, in the order of each tenant's requests."""
    order = Window.partitionBy(F.col("conv_id") % 16).orderBy("conv_id", "turn", "role", "text")
    prefix = F.concat(F.coalesce("role", F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))
    requests = table(spark, sf, "conversations").select((F.col("conv_id") % 16).alias("tenant"), F.row_number().over(order).alias("seq"), prefix.alias("prefix"))
    return economy.prompt_cache(requests, 40)


@query("""WITH p AS (SELECT conv_id AS tenant, turn AS seq, text AS prompt FROM conversations WHERE turn IS NOT NULL), pairs AS (SELECT a.tenant, a.seq, (SELECT max(n) FROM (SELECT unnest(range(0, least(length(a.prompt), length(b.prompt)) + 1)) AS n) WHERE substr(a.prompt, 1, n) = substr(b.prompt, 1, n)) AS n FROM p a JOIN p b ON a.tenant = b.tenant AND b.seq < a.seq AND b.seq >= a.seq - 24)
SELECT p.tenant, p.seq, CAST(coalesce((SELECT max(n) FROM pairs WHERE pairs.tenant = p.tenant AND pairs.seq = p.seq), 0) AS BIGINT) AS cached, CAST(length(prompt) AS BIGINT) AS total FROM p""")
def prefix_cache_lcp(spark, sf):
    return economy.prefix_share(table(spark, sf, "conversations").select(F.col("conv_id").alias("tenant"), F.col("turn").alias("seq"), F.col("text").alias("prompt")), 24)


@query(f"{LEGS}, x AS (SELECT g.qid, min(rank) AS r FROM g LEFT JOIN la USING (qid, chunk_id) GROUP BY g.qid) SELECT owner, count(*) AS n FROM (SELECT CASE WHEN r IS NULL THEN 'First-stage retrieval' WHEN r > 3 THEN 'Ranking / packing' ELSE 'none' END AS owner FROM x) GROUP BY owner")
def fault_isolation(spark, sf):
    a = lexical(spark, sf, 50)
    r = _gold(spark, sf).join(a, ["qid", "chunk_id"], "left").groupBy("qid").agg(F.min("rank").alias("r"))
    nodes = [(F.col("r").isNull() | (F.col("r") > 3), "Retrieval", False), (F.col("r").isNull(), "First-stage retrieval", True), (F.col("r") > 3, "Ranking / packing", True)]
    return economy.decide(r, nodes, "none").groupBy("owner").agg(F.count("*").alias("n"))


@query("SELECT event_type AS option, round(sum(s * w) / 6.0, 6) AS score FROM (SELECT event_type, 1.0 AS w, round(avg(value), 6) AS s FROM events GROUP BY 1 UNION ALL SELECT event_type, 2.0, round(avg(user_id), 6) FROM events GROUP BY 1 UNION ALL SELECT event_type, 3.0, CAST(count(*) AS DOUBLE) FROM events GROUP BY 1) GROUP BY event_type")
def score_matrix(spark, sf):
    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("option")).agg(F.round(F.avg("value"), 6).alias("a"), F.round(F.avg("user_id"), 6).alias("b"), F.count("*").cast("double").alias("c"))
    scores = e.unpivot(["option"], ["a", "b", "c"], "criterion", "score")
    weights = spark.sql("SELECT * FROM VALUES ('a', 1.0D), ('b', 2.0D), ('c', 3.0D) AS t(criterion, weight)")
    return economy.score_matrix(weights, scores)


EV = "ev AS (SELECT event_id, ts, user_id AS login, CAST(json_extract_string(props, '$.k') AS BIGINT) % 20 AS unit, CAST(json_extract_string(props, '$.k') AS BIGINT) % 50 AS thread, CASE event_type WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'pass' WHEN 'click' THEN 'hint' ELSE event_type END AS kind FROM events)"


def _events(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "purchase", "pass").when(F.col("event_type") == "click", "hint").otherwise(F.col("event_type"))
    return table(spark, sf, "events").select("event_id", "ts", F.col("user_id").alias("login"), (k % 20).alias("unit"), (k % 50).alias("thread"), kind.alias("kind"))


@query(f"WITH {EV}, r AS (SELECT *, kind IN ('fail', 'pass') AND coalesce(max(CASE WHEN kind = 'fail' THEN 1 ELSE 0 END) OVER (PARTITION BY login, thread ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS retry FROM ev) SELECT login, count(*) FILTER (kind IN ('fail', 'pass')) AS attempts, count(DISTINCT CASE WHEN kind = 'pass' THEN unit END) AS cleared, count(DISTINCT CASE WHEN kind IN ('fail', 'pass') THEN unit END) - count(DISTINCT CASE WHEN kind = 'pass' THEN unit END) AS still_open, count(*) FILTER (retry) AS retries, count(*) FILTER (kind = 'hint') AS hints, max(ts) AS last_active FROM r GROUP BY login")
def learner_progress(spark, sf):
    return events.progress(_events(spark, sf))


@query(f"WITH {EV} SELECT unit, count(*) FILTER (kind IN ('fail', 'pass')) AS graded, count(*) FILTER (kind = 'pass') AS cleared, count(*) FILTER (kind = 'hint') AS hints, round(CASE WHEN count(*) FILTER (kind IN ('fail', 'pass')) > 0 THEN count(*) FILTER (kind = 'pass') / count(*) FILTER (kind IN ('fail', 'pass')) END, 6) AS share FROM ev WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15' GROUP BY unit")
def weekly_digest(spark, sf):
    return events.digest(_events(spark, sf), datetime.datetime(2024, 1, 8), datetime.datetime(2024, 1, 15))


@query(f"WITH {EV} SELECT thread, 3 * count(*) + 2 * count(DISTINCT login) + count(*) FILTER (kind = 'hint') AS heat FROM ev GROUP BY thread")
def thread_heat(spark, sf):
    e = _events(spark, sf).groupBy("thread").agg(F.count("*").alias("comments"), F.count_distinct("login").alias("humans"), F.count_if(F.col("kind") == "hint").alias("reactions"))
    return events.heat(e)


@query("WITH RECURSIVE u AS (SELECT n_nationkey AS unit FROM nation), e AS (SELECT n_nationkey AS unit, CAST(floor(n_nationkey / 3) AS INTEGER) AS needs FROM nation WHERE n_nationkey > 0), w AS (SELECT unit, 0 AS wave FROM u UNION ALL SELECT e.unit, w.wave + 1 FROM w JOIN e ON e.needs = w.unit) SELECT unit, max(wave) AS wave FROM w GROUP BY unit")
def prereq_waves(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("unit"))
    return events.waves(n, n.filter("unit > 0").select("unit", F.floor(F.col("unit") / 3).cast("int").alias("needs")))


NEEDS = "e AS (SELECT s_suppkey AS unit, (s_suppkey * 3 + s_nationkey) % (SELECT count(*) FROM supplier) AS needs FROM supplier WHERE s_suppkey % 5 <> 0 UNION SELECT s_suppkey, s_suppkey - 1 FROM supplier WHERE s_suppkey % 4 = 0 AND s_suppkey > 0), r AS (SELECT unit AS a, needs AS b FROM e UNION SELECT r.a, e.needs FROM r JOIN e ON e.unit = r.b), own AS (SELECT a AS unit FROM r WHERE a = b)"


def _needs(spark, sf):
    s = kept(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("unit"), "s_nationkey"))
    n = s.count()
    one = s.filter("unit % 5 <> 0").select("unit", ((F.col("unit") * 3 + F.col("s_nationkey")) % n).alias("needs"))
    return s.select("unit"), one.unionByName(s.filter("unit % 4 = 0 AND unit > 0").select("unit", (F.col("unit") - 1).alias("needs")))


@query(f"WITH RECURSIVE {NEEDS} SELECT (SELECT min(x.b) FROM r x JOIN r y ON y.a = x.b AND y.b = x.a WHERE x.a = own.unit) AS cycle, unit FROM own")
def prerequisite_cycles(spark, sf):
    """Suppliers as units with prerequisites drawn from their keys: those that wait for each other."""
    return events.cycles(_needs(spark, sf)[1])


@query(f"WITH RECURSIVE {NEEDS}, stuck AS (SELECT unit FROM own UNION SELECT a FROM r WHERE b IN (SELECT unit FROM own)), w AS (SELECT s_suppkey AS unit, 0 AS wave FROM supplier WHERE s_suppkey NOT IN (SELECT unit FROM stuck) UNION ALL SELECT e.unit, w.wave + 1 FROM w JOIN e ON e.needs = w.unit WHERE e.unit NOT IN (SELECT unit FROM stuck)), z AS (SELECT unit, max(wave) AS wave FROM w GROUP BY unit) SELECT * FROM z UNION ALL SELECT unit, coalesce((SELECT max(wave) + 1 FROM z), 0) FROM stuck")
def prereq_waves_with_cycles(spark, sf):
    """The same units in waves; those on a cycle and what depends on them form the last one."""
    return events.waves(*_needs(spark, sf))


# --- agent, embedding, sampling -----------------------------------------------------------------------


@query(f"{BASE} SELECT qid, CASE WHEN regexp_matches(anchor, '[A-Z][A-Z0-9]{{2,}}(?:_[A-Z0-9]+)+|[A-Z]{{2,}}-\\d+') THEN 'lexical' WHEN regexp_matches(anchor, '\\b(file|path|function|class|def |import )\\b') THEN 'grep' WHEN regexp_matches(anchor, '(?i)\\b(why|how|approach|strategy|concept|mean|difference)\\b') THEN 'dense' ELSE 'hybrid' END AS tool FROM q")
def choose_tool(spark, sf):
    return questions(spark, sf).select("qid", agent.choose_tool(F.col("anchor")).alias("tool"))


@query(f"{BASE}, {TERMS}, {bm('la', 4)}, e AS (SELECT qid, {tok('text')} AS e FROM la JOIN c USING (chunk_id)), s AS (SELECT q.qid, CASE WHEN len(list_distinct({tok('anchor')})) = 0 THEN 1.0 ELSE coalesce(max(len(list_intersect(list_distinct({tok('anchor')}), e)) / len(list_distinct({tok('anchor')}))), 0.0) END AS b FROM q LEFT JOIN e USING (qid) GROUP BY q.qid, anchor) SELECT qid, b >= 0.34 AS sufficient, CASE WHEN b >= 0.34 THEN 1 ELSE 0 END AS covered, 1 AS total FROM s")
def sufficiency_check(spark, sf):
    c, q = chunks(spark, sf), questions(spark, sf)
    found = lexical(spark, sf, 4).join(c.select("chunk_id", "text"), "chunk_id").select("qid", "text")
    return agent.sufficiency(q.select("qid", F.col("anchor").alias("sub")), found)


@query("WITH s AS (SELECT conv_id AS qid, turn AS step, role AS item FROM conversations), need AS (SELECT DISTINCT conv_id AS qid, unnest(['user', 'assistant', 'system']) AS item FROM conversations), f AS (SELECT qid, item, min(step) AS step FROM s JOIN need USING (qid, item) GROUP BY ALL) SELECT qid, CASE WHEN count(f.item) = 3 THEN max(f.step) END AS step FROM (SELECT DISTINCT qid FROM need) LEFT JOIN f USING (qid) GROUP BY qid")
def first_sufficient_step(spark, sf):
    s = table(spark, sf, "conversations").select(F.col("conv_id").alias("qid"), F.col("turn").alias("step"), F.col("role").alias("item"))
    needs = s.select("qid").distinct().withColumn("item", F.explode(F.array(*map(F.lit, ("user", "assistant", "system")))))
    return agent.first_sufficient(s, needs)


@query("""WITH p AS (SELECT item_id AS chunk_id, ' ' || regexp_replace(lower(text), '\\s+', ' ', 'g') || ' ' AS s FROM benchmark), g AS (SELECT chunk_id, g, count(*) AS n FROM (SELECT chunk_id, substr(s, i, 3) AS g FROM (SELECT chunk_id, s, unnest(range(1, length(s) - 1)) AS i FROM p)) GROUP BY ALL), h AS (SELECT chunk_id, n, ('0x' || substr(md5(g), 1, 8))::BIGINT AS h FROM g), b AS (SELECT chunk_id, CAST(h % 192 AS INTEGER) AS bucket, sum(CASE WHEN (h >> 8) & 1 = 1 THEN n ELSE -n END) AS n FROM h GROUP BY ALL HAVING sum(CASE WHEN (h >> 8) & 1 = 1 THEN n ELSE -n END) <> 0) SELECT chunk_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY chunk_id)), 6) AS value FROM b""")
def hashing_embedder(spark, sf):
    return embed.hashed(table(spark, sf, "benchmark").select(F.col("item_id").alias("chunk_id"), "text"))


@query()
def lsa_dense(spark, sf):
    """Dense retrieval: questions against documents in a latent space fitted on all terms of the documents."""
    c, q = chunks(spark, sf).select("chunk_id", "text"), questions(spark, sf)
    model = embed.lsa_fit(c)
    qs = embed.lsa_encode(q.select(F.col("qid").alias("chunk_id"), F.col("anchor").alias("text")), model).select(F.col("chunk_id").alias("qid"), "vector")
    return retrieve.knn(qs, embed.lsa_encode(c, model, rows=model.rows), 10)


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE r <= greatest(3, CAST(floor(n * 0.1) AS BIGINT))")
def stratified_sample(spark, sf):
    return evalset.stratified(table(spark, sf, "documents"), "lang")


@query(f"{LEGS} SELECT chunk_id, qid, a.rank AS old_rank, b.rank AS new_rank, CASE WHEN a.rank IS NULL THEN 'added' WHEN b.rank IS NULL THEN 'dropped' WHEN a.rank = b.rank THEN 'same' ELSE 'moved' END AS change FROM (SELECT * FROM la WHERE rank <= 8) a FULL JOIN (SELECT * FROM lb WHERE rank <= 8) b USING (qid, chunk_id)")
def trace_diff(spark, sf):
    _, _, a, b = _legs(spark, sf)
    return metrics.diff_runs(a.filter("rank <= 8"), b.filter("rank <= 8"))


@query("SELECT user_id, event_type, value, event_id FROM events ORDER BY value DESC, event_id LIMIT 20")
def trace_report(spark, sf):
    """The top of a report in SQL text over a view; the limit is the report's."""
    table(spark, sf, "events").createOrReplaceTempView("_traces")
    return spark.sql("SELECT user_id, event_type, value, event_id FROM _traces ORDER BY value DESC, event_id LIMIT 20")


@query("SELECT event_type, round(sum(value) FILTER (dayofmonth(ts) <= 10), 4) AS d1, round(sum(value) FILTER (dayofmonth(ts) > 10 AND dayofmonth(ts) <= 20), 4) AS d2, round(sum(value) FILTER (dayofmonth(ts) > 20), 4) AS d3 FROM events GROUP BY event_type")
def metric_pivot(spark, sf):
    e = table(spark, sf, "events").select("event_type", "value", F.when(F.dayofmonth("ts") <= 10, "d1").when(F.dayofmonth("ts") <= 20, "d2").otherwise("d3").alias("d"))
    return e.groupBy("event_type").pivot("d", ["d1", "d2", "d3"]).agg(F.round(F.sum("value"), 4))
