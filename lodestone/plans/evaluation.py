"""Queries on evaluation: rows a question, scorecards, comparisons, sweeps, and where evidence is lost."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import economy, evalset, judge, metrics, pack, retrieve
from lodestone.operators._state import kept
from lodestone.plans.assembly import STABLE, extract_sql, faith_sql
from lodestone.plans.base import BASE, GOLD, LEGS, RRF, TERMS, anchors, any_gold, bm, chunks, gold_of, interval, legs, lexical, per_question, query, questions, resampled, tok, weighted_sql
from lodestone.sources import table

N, K, CAP = 50, 8, 3000
TOKENS = "CAST(greatest(1, ceil(length({x}) / 4.0)) AS BIGINT)"


def packed_sql(hits: str, k: int = K, cap: int = CAP) -> str:
    """SQL of what is packed of some hits: pk (qid, chunk_id, rank, n) in order."""
    take = f"len(ids) < {k} AND used + n <= {cap}"
    return f"""ph AS (SELECT h.qid, h.rank, h.chunk_id, {TOKENS.format(x='text')} AS n FROM {hits} h JOIN c USING (chunk_id)), pz AS (WITH RECURSIVE z AS (SELECT qid, 0 AS pos, CAST(0 AS BIGINT) AS used, CAST([] AS BIGINT[]) AS ids FROM (SELECT DISTINCT qid FROM ph) UNION ALL SELECT z.qid, pos + 1, CASE WHEN {take} THEN used + n ELSE used END, CASE WHEN {take} THEN list_append(ids, chunk_id) ELSE ids END FROM z JOIN ph ON ph.qid = z.qid AND ph.rank = z.pos + 1) SELECT * FROM z),
pk AS (SELECT e.*, ph.n FROM (SELECT qid, unnest(ids) AS chunk_id, CAST(generate_subscripts(ids, 1) AS INTEGER) AS rank FROM pz JOIN (SELECT qid, max(pos) AS pos FROM pz GROUP BY qid) USING (qid, pos)) e JOIN ph USING (qid, chunk_id))"""


def found_sql(name: str, hits: str) -> str:
    return f"{name} AS (SELECT qid, round(avg(f), 6) AS r, min(f) AS c FROM (SELECT ga.qid, anchor_idx, max(CASE WHEN h.qid IS NULL THEN 0.0 ELSE 1.0 END) AS f FROM ga LEFT JOIN {hits} h ON h.qid = ga.qid AND h.chunk_id = ga.chunk_id GROUP BY ALL) GROUP BY qid)"


CORRECT = "CASE WHEN len(k) > 0 AND len(list_filter(k, lambda t: contains(lower(answer), t))) / len(k) >= 0.6 THEN 1.0 ELSE 0.0 END"
ROWS = f"""{BASE}, {TERMS}, {bm('la', N)}, {GOLD}, {packed_sql('la')}, bl AS (SELECT qid, rank, text FROM pk JOIN c USING (chunk_id)), {extract_sql('bl')}, {found_sql('fp', 'pk')}, {found_sql('fn', 'la')}, {per_question('la', K)},
mr AS (SELECT ga.qid, round(coalesce(1.0 / min(la.rank), 0.0), 6) AS mrr FROM ga LEFT JOIN la ON la.qid = ga.qid AND la.chunk_id = ga.chunk_id GROUP BY ga.qid), cp AS (SELECT pk.qid, round(avg(CASE WHEN g.qid IS NULL THEN 0.0 ELSE 1.0 END), 6) AS p, sum(n) AS used FROM pk LEFT JOIN g USING (qid, chunk_id) GROUP BY pk.qid), ce AS (SELECT g.qid, round(avg(CASE WHEN la.qid IS NULL THEN 0.0 ELSE 1.0 END), 6) AS x FROM g LEFT JOIN la USING (qid, chunk_id) GROUP BY g.qid),
ci AS (SELECT z.qid, round(avg(CASE WHEN pk.qid IS NULL THEN 0.0 ELSE 1.0 END), 6) AS resolvable, round(avg(CASE WHEN g.qid IS NULL THEN 0.0 ELSE 1.0 END), 6) AS on_gold FROM (SELECT qid, CAST(substr(unnest(string_split(citations, ',')), 2) AS INTEGER) AS rank FROM ex WHERE citations <> '') z LEFT JOIN pk USING (qid, rank) LEFT JOIN g ON g.qid = z.qid AND g.chunk_id = pk.chunk_id GROUP BY z.qid),
gi AS (SELECT qid, count(DISTINCT anchor_idx) AS n FROM ga GROUP BY qid), kk AS (SELECT qid, list_slice(list_filter(string_split_regex(lower(anchor), '[^a-z0-9$%.]+'), lambda t: length(t) > 2), 1, 6) AS k FROM q),
ev AS (SELECT q.qid, CAST(1 + (also IS NOT NULL)::INTEGER AS BIGINT) AS hops, gi.n IS NULL AS is_null, coalesce(gi.n, 0) AS gold_items, 1 + (also IS NOT NULL)::INTEGER - coalesce(gi.n, 0) AS unresolved_gold, fp.r AS evidence_recall, fn.r AS recall_at_n, pm.ndcg, mr.mrr, coalesce(cp.p, 0.0) AS context_precision, coalesce(ce.x, 1.0) AS ceiling, ex.answer, contains(lower(ex.answer), 'insufficient_evidence') AS abstained, CASE WHEN gi.n IS NULL THEN CASE WHEN contains(lower(ex.answer), 'insufficient_evidence') THEN 1.0 ELSE 0.0 END ELSE {CORRECT} END AS answer_correct, fp.c AS full_chain, fn.c AS full_chain_at_n, ci.resolvable AS citation_resolvable, ci.on_gold AS citation_on_gold,
CAST({STABLE} + coalesce(cp.used, 0) + {TOKENS.format(x='q.query')} AS BIGINT) AS tokens_in, CASE WHEN contains(lower(ex.answer), 'insufficient_evidence') THEN 6 ELSE greatest(8, CAST(floor(length(ex.answer) / 4.0) AS BIGINT)) END AS tokens_out FROM q JOIN ex USING (qid) JOIN kk USING (qid) LEFT JOIN gi USING (qid) LEFT JOIN fp USING (qid) LEFT JOIN fn USING (qid) LEFT JOIN pm USING (qid) LEFT JOIN mr USING (qid) LEFT JOIN cp USING (qid) LEFT JOIN ce USING (qid) LEFT JOIN ci USING (qid)),
er AS MATERIALIZED (SELECT *, round((tokens_in * 3.0 + tokens_out * 15.0) / 1e6, 8) AS cost_usd FROM ev)"""


def rows_of(spark, sf, k: int = K) -> DataFrame:
    """The evaluation rows of the lexical arm, kept."""
    c, q = chunks(spark, sf), questions(spark, sf)
    sized = c.select("chunk_id", "text", T.approx_tokens(F.col("text")).alias("n_tokens"))
    candidates = kept(lexical(spark, sf, N))
    packed = kept(pack.pack(candidates.join(sized.select("chunk_id", "n_tokens"), "chunk_id"), k, CAP).join(sized, "chunk_id"))
    answers = kept(judge.extractive(q, packed))
    return kept(metrics.evaluate(q.select("qid", "query", F.col("anchor").alias("answer")), anchors(spark, sf), kept(gold_of(spark, sf)), candidates, packed, answers, k, STABLE))


@query(f"{ROWS} SELECT * EXCLUDE (answer), md5(answer) AS answer_md5 FROM er")
def evaluate_rows(spark, sf):
    return rows_of(spark, sf).withColumn("answer_md5", F.md5(F.encode("answer", "UTF-8"))).drop("answer")


MEANS = ", ".join(f"round(avg({m}), 6) AS {m}" for m in (*metrics.QUALITY, "tokens_in", "tokens_out", "cost_usd"))
P95 = ", ".join(f"list_sort(list({m}))[greatest(1, CAST(floor(count(*) * 0.95) AS INTEGER))] AS {m}_p95" for m in ("tokens_in", "tokens_out", "cost_usd"))
TP, FP, FN = ("count(*) FILTER (is_null AND abstained)", "count(*) FILTER (NOT is_null AND abstained)", "count(*) FILTER (is_null AND NOT abstained)")


@query(f"{ROWS}, s AS (SELECT count(*) AS n, {MEANS}, {P95}, {TP} AS tp, {FP} AS over_refusals, {FN} AS false_answers FROM er) SELECT * EXCLUDE (tp), round(CASE WHEN tp + over_refusals > 0 THEN tp / (tp + over_refusals) END, 6) AS abstention_precision, round(CASE WHEN tp + false_answers > 0 THEN tp / (tp + false_answers) END, 6) AS abstention_recall, round(CASE WHEN tp > 0 THEN 2 * (tp / (tp + over_refusals)) * (tp / (tp + false_answers)) / (tp / (tp + over_refusals) + tp / (tp + false_answers)) ELSE 0.0 END, 6) AS abstention_f1 FROM s")
def scorecard(spark, sf):
    return metrics.summarize(rows_of(spark, sf))


@query(f"{ROWS}, ca AS (SELECT 'lucky' AS \"case\", count(*) FILTER (NOT is_null AND answer_correct >= 1 AND evidence_recall = 0) AS n, count(*) FILTER (NOT is_null) AS d FROM er UNION ALL SELECT 'blind', count(*) FILTER (NOT is_null AND answer_correct = 0 AND full_chain >= 1), count(*) FILTER (NOT is_null) FROM er UNION ALL SELECT 'half chain', count(*) FILTER (NOT is_null AND gold_items >= 2 AND evidence_recall > 0 AND evidence_recall < 1), count(*) FILTER (NOT is_null) FROM er UNION ALL SELECT 'false answer', count(*) FILTER (is_null AND NOT abstained), count(*) FILTER (is_null) FROM er) SELECT \"case\", n, round(CASE WHEN d > 0 THEN n / d END, 6) AS share FROM ca")
def result_diagnosis(spark, sf):
    return metrics.diagnosis(rows_of(spark, sf))


FAULTS = [("Retrieval", "evidence_recall = 0", False), ("First-stage retrieval", "full_chain_at_n < 1", True), ("Ranking / packing", "full_chain < 1", True), ("Generation", "NOT entailed", True)]


@query(f"{ROWS}, {faith_sql('(SELECT qid, answer FROM er)', 'jf', 0.5)}, ow AS (SELECT CASE WHEN full_chain_at_n < 1 THEN 'First-stage retrieval' WHEN full_chain < 1 THEN 'Ranking / packing' WHEN NOT (label = 'pass' AND NOT abstained) THEN 'Generation' ELSE 'Label / question / rubric' END AS owner FROM er JOIN jf USING (qid) WHERE NOT is_null AND answer_correct < 1) SELECT owner, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM ow GROUP BY owner")
def fault_distribution(spark, sf):
    """Which stage owns the wrong answers, and how many of them."""
    rows = rows_of(spark, sf)
    c, q = chunks(spark, sf), questions(spark, sf)
    sized = c.select("chunk_id", "text", T.approx_tokens(F.col("text")).alias("n_tokens"))
    blocks = pack.pack(lexical(spark, sf, N).join(sized.select("chunk_id", "n_tokens"), "chunk_id"), K, CAP).join(sized, "chunk_id")
    judged = judge.faithfulness(rows.select("qid", "answer"), blocks).select("qid", "label")
    wrong = rows.filter(~F.col("is_null") & (F.col("answer_correct") < 1)).join(judged, "qid").withColumn("entailed", (F.col("label") == "pass") & ~F.col("abstained"))
    return economy.fault_shares(wrong, [(F.expr(test), owner, terminal) for owner, test, terminal in FAULTS], "Label / question / rubric")


@query(f"{ROWS}, grid(depth) AS (VALUES (5), (10), (25), (50)), ft AS (SELECT depth, ga.qid, anchor_idx, max(CASE WHEN la.rank <= depth THEN 1.0 ELSE 0.0 END) AS a, max(CASE WHEN pk.qid IS NOT NULL AND la.rank <= depth THEN 1.0 ELSE 0.0 END) AS b FROM ga CROSS JOIN grid LEFT JOIN la ON la.qid = ga.qid AND la.chunk_id = ga.chunk_id LEFT JOIN pk ON pk.qid = ga.qid AND pk.chunk_id = ga.chunk_id GROUP BY ALL), fs AS (SELECT depth, avg(a) AS a, avg(b) AS b FROM (SELECT depth, qid, avg(a) AS a, avg(b) AS b FROM ft GROUP BY ALL) GROUP BY depth) SELECT depth, round(a, 6) AS ceiling, round(b, 6) AS delivered, CASE WHEN a - b < 0.10 THEN 'first stage' ELSE 'ranking and packing' END AS bottleneck FROM fs")
def recall_funnel(spark, sf):
    """Evidence among the first n candidates, and of it in the packed context: where to look for more."""
    c, q = chunks(spark, sf), questions(spark, sf)
    sized = c.select("chunk_id", T.approx_tokens(F.col("text")).alias("n_tokens"))
    hits = kept(lexical(spark, sf, N))
    packed = pack.pack(hits.join(sized, "chunk_id"), K, CAP).select("qid", "chunk_id", F.lit(True).alias("packed"))
    grid = F.broadcast(spark.sql("SELECT * FROM VALUES (5), (10), (25), (50) AS t(depth)"))
    at = gold_of(spark, sf).join(hits.select("qid", "chunk_id", "rank"), ["qid", "chunk_id"], "left").join(packed, ["qid", "chunk_id"], "left").crossJoin(grid)
    inside = F.coalesce(F.col("rank") <= F.col("depth"), F.lit(False))
    per = at.groupBy("depth", "qid", "anchor_idx").agg(F.max(inside.cast("int")).alias("a"), F.max((inside & F.col("packed").isNotNull()).cast("int")).alias("b")).groupBy("depth", "qid").agg(F.avg("a").alias("a"), F.avg("b").alias("b"))
    out = per.groupBy("depth").agg(F.avg("a").alias("a"), F.avg("b").alias("b"))
    return out.select("depth", F.round("a", 6).alias("ceiling"), F.round("b", 6).alias("delivered"), F.when(F.col("a") - F.col("b") < 0.10, "first stage").otherwise("ranking and packing").alias("bottleneck"))


ARMS = f"{LEGS}, {RRF}, w2 AS MATERIALIZED ({weighted_sql(0.2, 20)}), w5 AS MATERIALIZED ({weighted_sql(0.5, 20)}), " + ", ".join(per_question(h, K, f"_{h}") for h in ("la", "lb", "fused", "w2", "w5"))
NAMES = {"bm25": "la", "dense": "lb", "rrf": "fused", "w0.2": "w2", "w0.5": "w5"}
KEYS = ["evidence_recall", "full_chain", "ndcg", "mrr"]


def arms(spark, sf) -> dict[str, DataFrame]:
    """Rows of metrics for each rule of fusion."""
    _, q, a, b = legs(spark, sf)
    a, b, gold = kept(a), kept(b), kept(gold_of(spark, sf))
    hits = {"bm25": a, "dense": b, "rrf": retrieve.hybrid(a, b, "rrf", 20), "w0.2": retrieve.hybrid(a, b, "weighted", 20, alpha=0.2), "w0.5": retrieve.hybrid(a, b, "weighted", 20, alpha=0.5)}
    return {name: kept(metrics.retrieval_metrics(q, gold, h, K)) for name, h in hits.items()}


@query(ARMS + " " + " UNION ALL ".join(f"SELECT '{name}' AS run, count(*) AS n, {', '.join(f'round(avg({k}), 4) AS {k}' for k in KEYS)} FROM pm_{h}" for name, h in NAMES.items()))
def compare_arms(spark, sf):
    return metrics.compare_runs(arms(spark, sf), KEYS)


PAIRS = [("bm25", "rrf"), ("dense", "rrf"), ("rrf", "w0.2")]


def _boot(i: int, a: str, b: str, key: str) -> str:
    return f"b{i} AS (SELECT qid, y.{key} - x.{key} AS d FROM pm_{NAMES[a]} x JOIN pm_{NAMES[b]} y USING (qid) WHERE x.{key} IS NOT NULL AND y.{key} IS NOT NULL), {resampled(f'b{i}', f'r{i}', 200)}, o{i} AS (SELECT '{a} -> {b}' AS pair, (SELECT round(avg(d), 6) FROM b{i}) AS delta, {interval(f'r{i}', 200)}, (SELECT round(avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END), 6) FROM r{i}) AS p_better)"


@query(ARMS + ", " + ", ".join(_boot(i, a, b, "mrr") for i, (a, b) in enumerate(PAIRS)) + " " + " UNION ALL ".join(f"SELECT *, CASE WHEN lo > 0 OR hi < 0 THEN 'real' ELSE 'inside the noise band' END AS verdict FROM o{i}" for i in range(len(PAIRS))))
def compare_pairs(spark, sf):
    """Which differences between rules of fusion would survive another set of questions."""
    rows = arms(spark, sf)
    parts = [metrics.paired_bootstrap(rows[a].select("qid", F.col("mrr").alias("a")).join(rows[b].select("qid", F.col("mrr").alias("b")), "qid"), 200).select(F.lit(f"{a} -> {b}").alias("pair"), "*") for a, b in PAIRS]
    return functools.reduce(DataFrame.unionByName, parts)


@query(f"{ARMS}, hp AS (SELECT qid, CASE WHEN also IS NULL THEN 'one' ELSE 'two' END AS hops FROM q) SELECT hops AS slice, round(avg(x.evidence_recall), 6) AS base, round(avg(y.evidence_recall), 6) AS run, round(avg(y.evidence_recall) - avg(x.evidence_recall), 6) AS delta, avg(y.evidence_recall) - avg(x.evidence_recall) < -0.02 AS regressed FROM hp JOIN pm_la x USING (qid) JOIN pm_lb y USING (qid) GROUP BY hops")
def slice_regressions(spark, sf):
    rows = arms(spark, sf)
    hops = questions(spark, sf).select("qid", F.when(F.col("also").isNull(), "one").otherwise("two").alias("hops"))
    return metrics.slice_deltas(rows["bm25"].join(hops, "qid"), rows["dense"].join(hops, "qid"), "hops", "evidence_recall")


@query(f"{BASE}, {TERMS}, {bm('la', K)}, {GOLD}, {per_question('la', K)}, rr AS (SELECT qid, full_chain AS d FROM pm WHERE full_chain IS NOT NULL), {resampled('rr', 'ms', 400, 3)}, l AS (SELECT list_sort(list(m)) AS ms FROM ms) SELECT round(ms[11], 6) AS lo, round(ms[len(ms) - 9], 6) AS hi, round((ms[len(ms) - 9] - ms[11]) / 2, 4) AS band FROM l")
def noise_band(spark, sf):
    q = questions(spark, sf)
    rows = metrics.retrieval_metrics(q, gold_of(spark, sf), lexical(spark, sf, K), K)
    return metrics.noise_band(rows.select("qid", F.col("full_chain").alias("d")))


@query(f"{ROWS}, led AS (SELECT 'lexical' AS step, round(avg(evidence_recall), 4) AS evidence_recall, round(avg(full_chain), 4) AS full_chain, round(avg(answer_correct), 4) AS answer_correct, CAST(floor(avg(tokens_in)) AS BIGINT) AS tokens_in, round(avg(cost_usd), 6) AS cost_usd FROM er UNION ALL SELECT 'lexical, gold only', round(avg(evidence_recall), 4), round(avg(full_chain), 4), round(avg(answer_correct), 4), CAST(floor(avg(tokens_in)) AS BIGINT), round(avg(cost_usd), 6) FROM er WHERE NOT is_null) SELECT *, tokens_in <= 6000 AS tokens_in_ok, cost_usd <= 0.03 AS cost_usd_ok FROM led")
def run_ledger(spark, sf):
    """Evaluated steps as rows of a ledger, with the ceilings that each keeps to."""
    rows = rows_of(spark, sf)

    def entry(name: str, of: DataFrame) -> DataFrame:
        means = [F.round(F.avg(m), 4).alias(m) for m in ("evidence_recall", "full_chain", "answer_correct")]
        return of.agg(*means, F.floor(F.avg("tokens_in")).alias("tokens_in"), F.round(F.avg("cost_usd"), 6).alias("cost_usd")).select(F.lit(name).alias("step"), "*")

    ledger = entry("lexical", rows).unionByName(entry("lexical, gold only", rows.filter(~F.col("is_null"))))
    return metrics.within_ceilings(ledger, {"tokens_in": 6000, "cost_usd": 0.03})


TOPS = f"{LEGS}, tp AS (SELECT q.qid, q.qid NOT IN (SELECT qid FROM g) OR q.qid % 4 = 0 AS is_null, coalesce((SELECT max(score) FROM lb WHERE lb.qid = q.qid), 0.0) AS top FROM q)"
THETAS = [round(0.30 + 0.02 * i, 2) for i in range(33)]


def tops(spark, sf) -> DataFrame:
    """(qid, is_null, top): the best dense score of each question; every fourth one counts as a null question too."""
    _, q, _, b = legs(spark, sf)
    best = b.groupBy("qid").agg(F.max("score").alias("top"))
    known = any_gold(gold_of(spark, sf)).select("qid").distinct().withColumn("g", F.lit(True))
    return q.select("qid").join(best, "qid", "left").join(known, "qid", "left").select("qid", (F.col("g").isNull() | (F.col("qid") % 4 == 0)).alias("is_null"), F.coalesce("top", F.lit(0.0)).alias("top"))


@query(f"{TOPS}, th AS (SELECT unnest([{', '.join(f'CAST({t} AS DOUBLE)' for t in THETAS)}]) AS theta), n AS (SELECT theta, count(*) FILTER (top < theta AND is_null) AS tp, count(*) FILTER (top < theta AND NOT is_null) AS fp, count(*) FILTER (top >= theta AND is_null) AS fn FROM tp, th GROUP BY theta), s AS (SELECT theta, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM n), f AS (SELECT *, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM s) SELECT theta, round(p, 6) AS precision, round(r, 6) AS recall, f1, theta = (SELECT theta FROM f ORDER BY f1 DESC, theta LIMIT 1) AS best FROM f")
def abstention_curve(spark, sf):
    return metrics.threshold_sweep(tops(spark, sf), THETAS)


@query(f"{TOPS} SELECT is_null, count(*) AS n, round(quantile_cont(top, 0.25), 6) AS p25, round(quantile_cont(top, 0.5), 6) AS p50, round(quantile_cont(top, 0.75), 6) AS p75 FROM tp GROUP BY is_null")
def score_quartiles(spark, sf):
    return metrics.quartiles(tops(spark, sf), "is_null", "top")


@query("WITH p AS (SELECT quality AS a, toxic AS b FROM labels), c AS (SELECT a, b, count(*) AS n FROM p GROUP BY ALL), t AS (SELECT sum(n) AS t, coalesce(sum(n) FILTER (a = b), 0) AS agree FROM c), e AS (SELECT sum(x.n * y.n) AS c FROM (SELECT a, sum(n) AS n FROM c GROUP BY a) x JOIN (SELECT b, sum(n) AS n FROM c GROUP BY b) y ON a = b), k AS (SELECT round(CASE WHEN c / (t * t) = 1 THEN 1.0 ELSE (agree / t - c / (t * t)) / (1 - c / (t * t)) END, 6) AS kappa, round(agree / t, 6) AS agreement, CAST(t AS BIGINT) AS n FROM t, e) SELECT *, CASE WHEN kappa < 0.2 THEN 'poor' WHEN kappa < 0.4 THEN 'fair' WHEN kappa < 0.6 THEN 'moderate' WHEN kappa < 0.8 THEN 'substantial' ELSE 'almost perfect' END AS strength, kappa >= 0.6 AS usable FROM k")
def agreement_report(spark, sf):
    return metrics.agreement(table(spark, sf, "labels"), "quality", "toxic")


@query(f"{BASE}, {TERMS}, {bm('la', 10)}, {GOLD}, pq AS (SELECT g.qid, avg(CASE WHEN la.qid IS NULL THEN 0.0 ELSE 1.0 END) AS r, min(CASE WHEN la.qid IS NULL THEN 0 ELSE 1 END) AS c, coalesce(1.0 / min(rank), 0.0) AS m FROM g LEFT JOIN la USING (qid, chunk_id) GROUP BY g.qid) SELECT round(coalesce(avg(r), 0.0), 6) AS recall, round(coalesce(avg(c), 0.0), 6) AS full_chain, round(coalesce(avg(m), 0.0), 6) AS mrr, count(*) AS n FROM pq")
def document_evaluation(spark, sf):
    hits = lexical(spark, sf, 10).withColumnRenamed("chunk_id", "doc_id")
    return metrics.document_metrics(hits, any_gold(gold_of(spark, sf)).withColumnRenamed("chunk_id", "doc_id"), 10)


FIRST = "string_split(text, chr(10))[1]"
CAND = f"""cd AS (SELECT doc_id, source, lang, {FIRST} AS passage FROM documents WHERE len(list_filter(string_split(regexp_replace({FIRST}, '\\s+', ' ', 'g'), ' '), lambda w: w <> '')) >= 14),
cq AS (SELECT doc_id, source, 1 AS hops, 'According to ' || source || ', what is stated about ' || substr(passage, 1, 40) || '?' AS query, string_split(passage, '.')[1] AS answer, substr(passage, 1, 60) AS evidence FROM cd),
pr AS (SELECT source, min(doc_id) AS a, min(doc_id) FILTER (rk = 2) AS b FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rk FROM cd) WHERE rk <= 2 GROUP BY source HAVING count(*) = 2),
c2 AS (SELECT x.doc_id, x.source, 2 AS hops, 'Combining two records of ' || x.source || ', what is known?' AS query, string_split(x.passage, '.')[1] || '; ' || string_split(y.passage, '.')[1] AS answer, substr(x.passage, 1, 60) || ' ' || substr(y.passage, 1, 60) AS evidence FROM pr JOIN cd x ON x.doc_id = pr.a JOIN cd y ON y.doc_id = pr.b), al AS (SELECT * FROM cq UNION ALL SELECT * FROM c2),
ju AS (SELECT *, list_distinct({tok('answer')}) AS a, list_distinct({tok('query')}) AS w, list_distinct({tok('evidence')}) AS s FROM al), vd AS (SELECT *, CASE WHEN (len(a) - len(list_intersect(a, w))) / greatest(1, len(a)) < 0.35 THEN 'self-answerable' WHEN len(list_intersect(a, s)) / greatest(1, len(a)) < 0.30 THEN 'evidence does not entail' ELSE 'kept' END AS verdict FROM ju)"""


@query(f"WITH {CAND}, kp AS (SELECT doc_id, hops, verdict, row_number() OVER (PARTITION BY hops, verdict ORDER BY md5('11:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY hops, verdict) AS n FROM vd) SELECT doc_id, CAST(hops AS INTEGER) AS hops, verdict, verdict = 'kept' AND r <= greatest(1, CAST(floor(0.15 * n) AS BIGINT)) AS review FROM kp")
def eval_set_candidates(spark, sf):
    """Questions made from passages, of one document and of pairs that share a source, what filters say of them,
    and which of those kept are to be reviewed."""
    return evalset.judged(evalset.candidates(table(spark, sf, "documents")))
