"""Queries on search: fielded, hybrid, filtered by groups, by parts of a question, reranked, and in a loop."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import agent, embed, lexical_index, pack, rerank, retrieve
from lodestone.operators._state import kept
from lodestone.plans.assembly import ENT, entities
from lodestone.plans.base import BASE, C, LEGS, Q, RRF, TERMS, bm, chunk_terms, chunk_vectors, chunks, gold_of, index_of, legs, lexical, query, questions, tok, vec, weighted_sql, with_heading
from lodestone.sources import table


def an(x: str) -> str:
    """SQL of the terms of fielded search."""
    return f"list_filter(regexp_extract_all(translate(lower({x}), '{T.ACCENTS[0]}', '{T.ACCENTS[1]}'), '[\\p{{L}}\\p{{N}}_-]+'), lambda t: length(t) > 1)"


FIELDS = f"cf AS (SELECT *, coalesce(substr(string_split(text, chr(10))[2], 1, 40), '') AS heading FROM c), fx AS (SELECT chunk_id, {an('text')} AS a, {an('title')} AS b, {an('heading')} AS d FROM cf)"
FTERMS = f"""{FIELDS}, dl AS (SELECT chunk_id, 4.0 * len(a) + 2.0 * len(b) + 1.0 * len(d) AS dl FROM fx), st AS (SELECT count(*) AS n, avg(dl) AS a FROM dl),
p AS (SELECT chunk_id, term, sum(w) AS tf FROM (SELECT chunk_id, unnest(a) AS term, 4.0 AS w FROM fx UNION ALL SELECT chunk_id, unnest(b), 2.0 FROM fx UNION ALL SELECT chunk_id, unnest(d), 1.0 FROM fx) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM p GROUP BY term), qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({an('query')}) AS term FROM q) GROUP BY ALL)"""


@query(f"{BASE}, {FTERMS}, {bm('la', 10)} SELECT * FROM la")
def fielded_topk(spark, sf):
    return retrieve.fielded(questions(spark, sf), with_heading(spark, sf), 10)


PROBES = ("555-3824", "by-nc", "apache", "555")


@query(f"WITH {C}, pb AS (SELECT unnest([{', '.join(repr(p) for p in PROBES)}]) AS term), t AS (SELECT chunk_id, lower(text) AS low, {an('text')} AS a, {tok('text')} AS b FROM c) SELECT term, count(*) FILTER (contains(low, term)) AS as_text, count(*) FILTER (list_contains(a, term)) AS analyzed, count(*) FILTER (list_contains(b, term)) AS tokenized FROM pb, t GROUP BY term")
def analyzer_probe(spark, sf):
    """In how many chunks identifiers are found: as text, by the analyzer that keeps hyphens, by the one that doesn't."""
    rows = chunks(spark, sf).select(F.lower("text").alias("low"), T.analyzed(F.col("text")).alias("a"), T.tokens(F.col("text")).alias("b"))
    probes = F.broadcast(spark.createDataFrame([(p,) for p in PROBES], "term string"))
    return rows.crossJoin(probes).groupBy("term").agg(F.count_if(F.contains("low", "term")).alias("as_text"), F.count_if(F.array_contains("a", F.col("term"))).alias("analyzed"), F.count_if(F.array_contains("b", F.col("term"))).alias("tokenized"))


FUSIONS = {"rrf": "SELECT * FROM fused WHERE rank <= 10", "weighted": weighted_sql(0.2), "lexical": "SELECT * FROM la WHERE rank <= 10", "dense": "SELECT * FROM lb WHERE rank <= 10"}


@query(f"{LEGS}, {RRF} " + " UNION ALL ".join(f"SELECT '{name}' AS fusion, qid, chunk_id, score, rank FROM ({sql})" for name, sql in FUSIONS.items()))
def hybrid_topk(spark, sf):
    """A lexical and a dense leg over one corpus, fused in each way."""
    _, _, a, b = legs(spark, sf)
    a, b = kept(a), kept(b)
    parts = [retrieve.hybrid(a, b, name, 10, alpha=0.2).select(F.lit(name).alias("fusion"), "qid", "chunk_id", "score", "rank") for name in FUSIONS]
    return functools.reduce(DataFrame.unionByName, parts)


SUBS = """sb0 AS (SELECT qid, text, regexp_replace(trim(text), '\\?+$', '') AS s FROM {source}), sb1 AS (SELECT *, trim(regexp_extract(s, '(?is)^(.*?)\\bthat\\b(.*)$', 1)) AS o, trim(regexp_extract(s, '(?is)^(.*?)\\bthat\\b(.*)$', 2)) AS i FROM sb0),
sb2 AS (SELECT qid, text, list_concat(CASE WHEN regexp_matches(s, '(?i)\\bthat\\b') AND len(string_split_regex(i, '\\s+')) > 2 THEN ['Which entity ' || i || '?', o || ' (of that entity)?'] ELSE [] END, list_transform(list_filter(list_transform(string_split(regexp_replace(s, '\\band\\b|;', chr(1), 'g'), chr(1)), lambda p: trim(p)), lambda p: len(string_split_regex(p, '\\s+')) >= 3), lambda p: p || '?')) AS l FROM sb1),
sb AS (SELECT qid, CASE WHEN len(l) > 0 THEN list_slice(list_filter(l, lambda x, i: list_position(l, x) = i), 1, 3) ELSE [text] END AS l FROM sb2)"""


@query(f"WITH {Q}, {SUBS.format(source='(SELECT qid, anchor AS text FROM q)')} SELECT qid, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS n, unnest(l) AS sub FROM sb")
def decompose(spark, sf):
    return questions(spark, sf).select("qid", F.posexplode(agent.decompose(F.col("anchor"))).alias("n", "sub"))


PARTS = f"{BASE.replace(f', {Q}', '')}, {Q.replace('q AS', 'q0 AS', 1)}, {SUBS.format(source='(SELECT qid, anchor AS text FROM q0)')}, q AS (SELECT qid * 10 + i AS qid, query || ' ' || sub AS query FROM (SELECT qid, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS sub FROM sb) JOIN q0 USING (qid)), {TERMS}, {bm('la', 5)}"


@query(f"{PARTS}, u AS (SELECT CAST(floor(qid / 10) AS BIGINT) AS qid, chunk_id, min((qid % 10) * 1000 + rank) AS pos FROM la GROUP BY ALL) SELECT * FROM (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY pos, chunk_id) AS rank FROM u) WHERE rank <= 8")
def decompose_union(spark, sf):
    """Each part of a question searched together with it, and the hits united in the order of the parts."""
    subs = questions(spark, sf).select("qid", "query", F.posexplode(agent.decompose(F.col("anchor"))).alias("part", "sub"))
    asked = subs.select((F.col("qid") * 10 + F.col("part")).alias("qid"), F.concat("query", F.lit(" "), "sub").alias("query"))
    hits = retrieve.bm25(asked, chunks(spark, sf), 5)
    return retrieve.union_of_parts(hits.select(F.floor(F.col("qid") / 10).alias("qid"), (F.col("qid") % 10).alias("part"), "chunk_id", "rank"), 8)


def _vectors(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")
    return v.filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("qid"), "vector"), v


COS = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n, label FROM embeddings)"


@query(f"WITH {COS} SELECT * FROM (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM (SELECT a.vec_id AS qid, b.vec_id AS chunk_id, round(list_dot_product(a.v, b.v) / (CASE WHEN a.n = 0 THEN 1 ELSE a.n END * CASE WHEN b.n = 0 THEN 1 ELSE b.n END), 6) AS score FROM e a, e b WHERE a.vec_id % 50 = 0)) WHERE rank <= 10")
def knn_cosine_topk(spark, sf):
    return retrieve.knn(*_vectors(spark, sf), 10, cosine=True)


@query(f"WITH {COS}, s AS (SELECT a.vec_id AS qid, b.vec_id AS chunk_id, b.label, round(list_dot_product(a.v, b.v), 6) AS score FROM e a, e b WHERE a.vec_id % 50 = 0), post AS (SELECT qid, count(*) FILTER (label % 3 = 0) AS n FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 10 GROUP BY qid), pre AS (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM s WHERE label % 3 = 0) SELECT pre.*, post.n AS left_by_late_filter FROM pre JOIN post USING (qid) WHERE rank <= 10")
def knn_filtered_topk(spark, sf):
    """Filtering before the search, and how many hits a filter after it would have left."""
    q, v = _vectors(spark, sf)
    allowed = v.filter("label % 3 = 0")
    late = retrieve.knn(q, v, 10).join(allowed.select("chunk_id", F.lit(1).alias("in")), "chunk_id", "left").groupBy("qid").agg(F.count("in").alias("left_by_late_filter"))
    return retrieve.knn(q, allowed, 10).join(late, "qid")


PERSONAS = "pn(persona, groups) AS (VALUES ('analyst', ['src0', 'src1', 'src2']), ('guest', ['src3']), ('nobody', CAST([] AS VARCHAR[])))"


def personas(spark) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES ('analyst', array('src0', 'src1', 'src2')), ('guest', array('src3')), ('nobody', cast(array() AS array<string>)) AS t(persona, groups)")


def seen_by(spark, sf, k: int = 8) -> DataFrame:
    """(persona, qid, chunk_id, rank): the best hits among what each persona may read."""
    c = chunks(spark, sf)
    scored = retrieve.score(retrieve.postings(questions(spark, sf), c), 1 << 30)
    may = scored.join(retrieve.visible_to(c, personas(spark)), "chunk_id")
    order = Window.partitionBy("persona", "qid").orderBy(F.desc("score"), "chunk_id")
    return may.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("persona", "qid", "chunk_id", "rank")


SEEN = f"{BASE}, {TERMS}, {bm('la', 1 << 30)}, {PERSONAS}, sv AS (SELECT * FROM (SELECT persona, groups, qid, chunk_id, row_number() OVER (PARTITION BY persona, qid ORDER BY score DESC, chunk_id) AS rank FROM la JOIN c USING (chunk_id) JOIN pn ON list_contains(groups, source)) WHERE rank <= 8)"


@query(f"{SEEN} SELECT persona, count(qid) AS n_packed, count(*) FILTER (qid IS NOT NULL AND NOT list_contains(groups, source)) AS violations FROM (SELECT pn.persona, pn.groups, sv.qid, c.source FROM pn LEFT JOIN sv USING (persona) LEFT JOIN c USING (chunk_id)) GROUP BY persona")
def persona_isolation(spark, sf):
    """For every persona and question, packed chunks that none of the persona's groups may read: there are none."""
    hits = seen_by(spark, sf).join(chunks(spark, sf).select("chunk_id", "acl"), "chunk_id")
    rows = personas(spark).join(hits, "persona", "left")
    bad = F.col("qid").isNotNull() & ~F.arrays_overlap("acl", "groups")
    return rows.groupBy("persona").agg(F.count("qid").alias("n_packed"), F.count_if(bad).alias("violations"))


@query(f"{SEEN}, po AS (SELECT persona, qid, chunk_id FROM (SELECT * FROM la WHERE rank <= 8) la JOIN c USING (chunk_id) JOIN pn ON list_contains(groups, source)), bo AS (SELECT coalesce(sv.persona, po.persona) AS persona, sv.chunk_id AS a, po.chunk_id AS b FROM sv FULL JOIN po ON sv.persona = po.persona AND sv.qid = po.qid AND sv.chunk_id = po.chunk_id) SELECT persona, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS same, count(*) FILTER (b IS NULL) AS only_before, count(*) FILTER (a IS NULL) AS only_after FROM bo GROUP BY persona")
def score_leak_probe(spark, sf):
    """What filtering by groups before the search finds that filtering after it loses, and the other way round."""
    c = chunks(spark, sf)
    after = lexical(spark, sf, 8).join(retrieve.visible_to(c, personas(spark)), "chunk_id").select("persona", "qid", "chunk_id", F.lit(1).alias("b"))
    both = seen_by(spark, sf).select("persona", "qid", "chunk_id", F.lit(1).alias("a")).join(after, ["persona", "qid", "chunk_id"], "full")
    return both.groupBy("persona").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("same"), F.count_if(F.col("b").isNull()).alias("only_before"), F.count_if(F.col("a").isNull()).alias("only_after"))


@query(f"WITH {C} SELECT source, count(*) AS n FROM c WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY source")
def doc_id_filter(spark, sf):
    return retrieve.filtered(chunks(spark, sf), doc_ids=table(spark, sf, "labels").filter("quality = 1")).groupBy("source").agg(F.count("*").alias("n"))


@query(f"WITH {C}, {PERSONAS} SELECT persona, count(*) AS n FROM c JOIN pn ON list_contains(groups, source) WHERE tenant = 'en' AND published >= '2024-03-01' GROUP BY persona")
def visible_counts(spark, sf):
    """How many chunks of a tenant and time each persona may read."""
    c = retrieve.filtered(chunks(spark, sf), tenant="en", published_from="2024-03-01")
    return retrieve.visible_to(c, personas(spark)).groupBy("persona").agg(F.count("*").alias("n"))


CLASSY = "CASE qid % 5 WHEN 0 THEN query || ' ERR_DISK_FULL' WHEN 1 THEN query || ' pause between tries' WHEN 2 THEN 'the Lyon-based ' || query ELSE query END"


@query(f"WITH {Q} SELECT qid, CASE qid % 5 WHEN 0 THEN 'identifier' WHEN 1 THEN 'lexical gap' WHEN 2 THEN 'descriptor' WHEN 3 THEN 'null' ELSE 'named entity' END AS class FROM q")
def query_classes(spark, sf):
    q = questions(spark, sf).select("qid", F.expr(CLASSY).alias("query"))
    return q.select("qid", agent.query_class(F.col("query"), F.col("qid") % 5 == 3).alias("class"))


ROUTED = f"rt AS (SELECT q.qid, count(DISTINCT en.entity) FILTER (contains(lower(query), en.entity)) >= 2 OR regexp_matches(query, '{agent.RELATIVE}') OR regexp_matches(query, '{agent.COMPARING}') AS m, any_value(also IS NOT NULL) AS t FROM q CROSS JOIN (SELECT DISTINCT entity FROM en) en GROUP BY q.qid, query)"


@query(f"{BASE}, {ENT}, {ROUTED}, n AS (SELECT count(*) FILTER (m AND t) AS tp, count(*) FILTER (m AND NOT t) AS fp, count(*) FILTER (NOT m AND t) AS fn, count(*) FILTER (m) AS r, count(*) AS n FROM rt) SELECT round(tp / greatest(1, tp + fp), 6) AS precision, round(tp / greatest(1, tp + fn), 6) AS recall, round(r / n, 6) AS routed FROM n")
def multihop_router(spark, sf):
    q = questions(spark, sf)
    routed = agent.looks_multihop(q, entities(spark, sf).withColumnRenamed("entity", "name"))
    return agent.router_scores(routed, q.select("qid", F.when(F.col("also").isNull(), 1).otherwise(2).alias("hops")))


TOKS = f"tq AS (SELECT qid, list_slice({tok('query')}, 1, 48) AS t FROM q), wd AS (SELECT DISTINCT unnest(t) AS token FROM tq)"


@query(f"{BASE}, {TOKS}, {vec('wv', 'wd', 'token', 'token')} SELECT qid, CAST(i - 1 AS INTEGER) AS at, token, list_transform(list_filter(list_transform(range(1, 193), lambda j: [CAST(j - 1 AS DOUBLE), v[j]]), lambda x: x[2] <> 0), lambda x: CAST(x[1] AS INTEGER) || ':' || CAST(round(x[2] * 1e6) AS BIGINT)) AS parts FROM (SELECT qid, generate_subscripts(t, 1) AS i, unnest(t) AS token FROM tq) JOIN wv USING (token)")
def token_vectors(spark, sf):
    """The parts that aren't 0 of the vectors of each question's tokens."""
    found = embed.token_vectors(questions(spark, sf), "qid", "query")
    parts = F.filter(F.transform("vector", lambda v, j: F.struct(j.alias("j"), v.alias("v"))), lambda x: x["v"] != 0)
    return found.select("qid", "at", "token", F.transform(parts, lambda x: F.concat(x["j"].cast("string"), F.lit(":"), F.round(x["v"] * 1e6).cast("long").cast("string"))).alias("parts"))


def late_sql(name: str, size: int, hits: str) -> str:
    """SQL of maxsim (qid, chunk_id, m) over the first ``size`` tokens of questions and hits."""
    return f"""{name}q AS (SELECT qid, generate_subscripts(t, 1) AS i, unnest(t) AS token FROM (SELECT qid, list_slice({tok('query')}, 1, {size}) AS t FROM q)), {name}d AS (SELECT chunk_id, unnest(t) AS token FROM (SELECT chunk_id, list_slice({tok('text')}, 1, {size}) AS t FROM c WHERE chunk_id IN (SELECT chunk_id FROM {hits}))), {name}w AS (SELECT token FROM {name}q UNION SELECT token FROM {name}d), {vec(f'{name}v', f'{name}w', 'token', 'token')},
{name}p AS (SELECT a.token AS x, b.token AS y, list_dot_product(a.v, b.v) AS s FROM (SELECT DISTINCT token FROM {name}q) z JOIN {name}v a ON a.token = z.token, (SELECT DISTINCT token FROM {name}d) u JOIN {name}v b ON b.token = u.token),
{name} AS (SELECT qid, chunk_id, avg(m) AS m FROM (SELECT h.qid, h.chunk_id, l.i, max(s) AS m FROM {hits} h JOIN {name}q l ON l.qid = h.qid JOIN (SELECT DISTINCT chunk_id, token FROM {name}d) r ON r.chunk_id = h.chunk_id JOIN {name}p ON x = l.token AND y = r.token GROUP BY ALL) GROUP BY ALL)"""


@query(f"{BASE}, {TERMS}, {bm('la', 12)}, tp AS (SELECT * FROM la WHERE rank <= 8), {late_sql('ms', 48, 'tp')}, sc AS (SELECT la.*, CASE WHEN la.rank <= 8 THEN round(coalesce(m, 0.0), 6) END AS late FROM la LEFT JOIN ms USING (qid, chunk_id)) SELECT qid, chunk_id, coalesce(late, score) AS score, row_number() OVER (PARTITION BY qid ORDER BY rank <= 8 DESC, -late, rank) AS rank FROM sc")
def maxsim_rerank(spark, sf):
    c, q = chunks(spark, sf), questions(spark, sf)
    return rerank.late_interaction(kept(lexical(spark, sf, 12)), q, c, depth=8)


@query()
def reranker_weights(spark, sf):
    """Weights that a logistic model learns from pairs of questions and hits, gold or not."""
    c, q = chunks(spark, sf), questions(spark, sf)
    features = rerank.pair_features(lexical(spark, sf, 20), q, c)
    marked = features.join(gold_of(spark, sf).select("qid", "chunk_id").distinct().withColumn("label", F.lit(1)), ["qid", "chunk_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
    weights = rerank.fit_logistic(kept(marked), [n for n in rerank.WEIGHTS if n != "bias"])
    return spark.createDataFrame(sorted(weights.items()), "feature string, weight double")


def _found(spark, sf):
    """A tool's search, one leg or both, for the agent's loop; terms and vectors of the chunks serve all turns."""
    c = chunks(spark, sf)

    def retrieved(asked: DataFrame) -> DataFrame:
        asked = kept(asked)
        a = kept(retrieve.score(retrieve.postings(asked, c, cut=chunk_terms(spark, sf)), 20))
        b = kept(retrieve.knn(embed.hashed_vectors(asked, "qid", "query"), chunk_vectors(spark, sf), 20))
        parts = []
        for tool, fusion in (("lexical", "lexical"), ("dense", "dense"), ("grep", "rrf"), ("hybrid", "rrf")):
            mine = asked.filter(F.col("tool") == tool).select("qid")
            parts.append(retrieve.hybrid(a.join(mine, "qid", "left_semi"), b.join(mine, "qid", "left_semi"), fusion, 4).select("qid", "chunk_id", "rank"))
        return functools.reduce(DataFrame.unionByName, parts).join(c.select("chunk_id", "text"), "chunk_id")

    return retrieved


def looped(spark, sf, turns: int = 3, threshold: float = 0.9):
    q = questions(spark, sf)
    return agent.search_loop(q.select("qid", F.col("anchor").alias("query")), _found(spark, sf), turns, threshold)


@query()
def agent_loop(spark, sf):
    return looped(spark, sf)[0].withColumn("missing", F.size("missing"))


def _packed(evidence, k: int = 8) -> DataFrame:
    order = Window.partitionBy("qid").orderBy("turn", "rank", "chunk_id")
    sized = evidence.withColumn("place", F.row_number().over(order)).select("qid", F.col("place").alias("rank"), "chunk_id", T.approx_tokens(F.col("text")).alias("n_tokens"))
    return pack.pack(sized, k, 3000)


@query()
def trace_scores(spark, sf):
    results, _, evidence = looped(spark, sf)
    q = questions(spark, sf).select("qid", F.col("anchor").alias("query"))
    return agent.trace_scores(results, q, evidence, kept(_packed(evidence)), gold_of(spark, sf))


@query()
def loop_statistics(spark, sf):
    _, turns, evidence = looped(spark, sf)
    return agent.loop_stats(turns, evidence, kept(_packed(evidence)), questions(spark, sf).select("qid", F.col("anchor").alias("query")))


# --- kept index ---------------------------------------------------------------------------------------


@query(f"{BASE}, {TERMS}, {bm('la', 10)} SELECT * FROM la")
def index_topk(spark, sf):
    """The best chunks of each question from the kept index, by reading the blocks that can matter."""
    return lexical_index.search(index_of(spark, sf), questions(spark, sf), 10)[0]


@query()
def postings_read(spark, sf):
    """How many postings the ten best chunks of each question take, and how many its terms have."""
    return lexical_index.search(index_of(spark, sf), questions(spark, sf), 10)[1]


CHANGED = C.replace("text, source", "CASE WHEN doc_id % 7 = 0 THEN text || ' licence amended' ELSE text END AS text, source", 1).replace("FROM documents", "FROM documents WHERE doc_id % 11 <> 3", 1)


def _changed(spark, sf) -> tuple[DataFrame, lexical_index.Index]:
    """Chunks of which some are rewritten and some taken away, and the index that two more segments bring up to date."""
    c = chunks(spark, sf)
    new = c.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" licence amended"))).otherwise(F.col("text"))).filter("doc_id % 11 <> 3")
    name = uuid.uuid4().hex
    updated = lexical_index.add(index_of(spark, sf), f"{name}-rewritten", new.filter("doc_id % 7 = 0"))
    return new, lexical_index.add(updated, f"{name}-gone", new.limit(0), c.filter("doc_id % 11 = 3"))


@query(f"WITH {CHANGED}, {Q}, {TERMS}, {bm('la', 10)} SELECT * FROM la")
def index_after_changes(spark, sf):
    """The best chunks from an index of three segments: all chunks, those rewritten, and those taken away."""
    return lexical_index.search(_changed(spark, sf)[1], questions(spark, sf), 10)[0]


@query(f"WITH {CHANGED}, {Q}, {TERMS}, {bm('la', 10)} SELECT * FROM la")
def index_after_compaction(spark, sf):
    """The same after the segments are compacted to one."""
    new, changed = _changed(spark, sf)
    return lexical_index.search(lexical_index.compact(changed, spark, uuid.uuid4().hex, new), questions(spark, sf), 10)[0]


@query("WITH s AS (SELECT 0 AS seg, count(*) AS chunks, count(*) FILTER (doc_id % 7 = 0 AND doc_id % 11 <> 3) + count(*) FILTER (doc_id % 11 = 3) AS dead FROM documents UNION ALL SELECT 1, count(*) FILTER (doc_id % 7 = 0 AND doc_id % 11 <> 3), 0 FROM documents) SELECT * FROM s")
def index_segments(spark, sf):
    """What the segments of the changed index hold, and what of it is dead."""
    return lexical_index.stored(_changed(spark, sf)[1], spark).select("seg", "chunks", "dead")
