"""Queries on the life of an index, costs, decisions, events, sources, and what chunking does to evidence."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import chunk, economy, embed, events, index, metrics, retrieve
from lodestone.operators._state import kept
from lodestone.plans.base import BASE, C, GOLD, LEGS, TERMS, anchors, bm, chunks, gold_of, lexical, per_question, query, questions, tok
from lodestone.plans.queries import EV, FIXED, IDX, LINES, _docs, _events, _index
from lodestone.sources import corpora, table

# --- index --------------------------------------------------------------------------------------------


@query("SELECT * FROM (VALUES ('v1', 'lsa@1:d96', 'fixed', '2024-01-01', 'first'), ('v2', 'hash@1:d192', 'structural', '2024-02-02', 'again')) AS t(index_version, embedder_tag, chunker, created_at, note)")
def version_registry(spark, sf):
    """Versions put in, one of them twice."""
    none = spark.createDataFrame([], "index_version string, embedder_tag string, chunker string, created_at string, note string")
    one = index.create_version(none, "v1", "lsa@1:d96", "fixed", "first", "2024-01-01")
    two = index.create_version(one, "v2", "lsa@1:d96", "fixed", "first", "2024-02-01")
    return index.create_version(two, "v2", "hash@1:d192", "structural", "again", "2024-02-02")


@query("SELECT * FROM (VALUES ('live', 'v2'), ('old', 'v1'), ('unknown', 'unknown')) AS t(name, index_version)")
def alias_resolution(spark, sf):
    aliases = spark.createDataFrame([("live", "v1"), ("old", "v1")], "alias string, index_version string")
    swapped = index.set_alias(aliases, "live", "v2")
    parts = [index.resolve(swapped, n).select(F.lit(n).alias("name"), "index_version") for n in ("live", "old", "unknown")]
    return functools.reduce(DataFrame.unionByName, parts)


@query(f"WITH {IDX} SELECT i.chunk_id, i.index_version, i.doc_id, md5(i.text) AS text_md5, i.tombstoned FROM idx i WHERE chunk_id = 7")
def get_chunk(spark, sf):
    return index.get(_index(spark, sf)[0], 7, "v1").select("chunk_id", "index_version", "doc_id", F.md5(F.encode("text", "UTF-8")).alias("text_md5"), "tombstoned")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'gone' WHEN doc_id % 3 = 0 THEN 'body' WHEN doc_id % 2 = 0 THEN 'metadata only' ELSE 'same' END AS state FROM documents UNION ALL SELECT doc_id + 1000000000, 'new' FROM documents WHERE doc_id % 11 = 0")
def document_changes(spark, sf):
    """What of the documents must be embedded anew: bodies that changed, not dates that did."""
    d = table(spark, sf, "documents").select("doc_id", "text", "source", "lang")
    changed = d.filter("doc_id % 5 <> 0").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" (corrected)"))).otherwise(F.col("text")))
    changed = changed.withColumn("source", F.when((F.col("doc_id") % 3 != 0) & (F.col("doc_id") % 2 == 0), "elsewhere").otherwise(F.col("source")))
    added = d.filter("doc_id % 11 = 0").withColumn("doc_id", F.col("doc_id") + 1000000000)
    return index.document_changes(d, changed.unionByName(added), ["source", "lang"])


@query(f"{BASE}, {TERMS}, {bm('la', 8)}, {bm('lb', 8, 0.9, 0.4)}, {GOLD}, {per_question('la', 8, '_a')}, {per_question('lb', 8, '_b')}, s AS (SELECT (SELECT avg(mrr) FROM pm_a WHERE qid % 3 = 0) AS a, (SELECT avg(mrr) FROM pm_b WHERE qid % 3 = 0) AS b) SELECT 'live' AS alias, CASE WHEN b - a >= 0 THEN 'v2' ELSE 'v1' END AS index_version, round(b - a, 6) AS delta FROM s")
def blue_green(spark, sf):
    """A second version evaluated on the frozen questions before the alias moves to it."""
    c, q, gold = chunks(spark, sf), questions(spark, sf), kept(gold_of(spark, sf))
    found = retrieve.postings(q, c)
    frozen = q.filter("qid % 3 = 0")
    scores = [metrics.retrieval_metrics(frozen, gold, retrieve.score(found, 8, k1, b), 8).agg(F.avg("mrr").alias("score")).select(F.lit(v).alias("index_version"), "score") for v, k1, b in (("v1", 1.5, 0.75), ("v2", 0.9, 0.4))]
    aliases = spark.createDataFrame([("live", "v1")], "alias string, index_version string")
    return index.swap_if_better(aliases, "live", scores[0].unionByName(scores[1]))


@query(f"""{BASE}, {TERMS}, {bm('la', 50)}, {GOLD}, dg AS (SELECT count(*) AS n FROM c GROUP BY array_to_string(list_sort(list_distinct({tok('text')})), ' ') HAVING count(*) > 1), rc AS (SELECT avg(r) AS r FROM (SELECT qid, avg(f) AS r FROM (SELECT ga.qid, anchor_idx, max(CASE WHEN la.qid IS NULL THEN 0.0 ELSE 1.0 END) AS f FROM ga LEFT JOIN la ON la.qid = ga.qid AND la.chunk_id = ga.chunk_id GROUP BY ALL) GROUP BY qid)),
m AS (SELECT 'coverage' AS check_name, 0.0 AS m, true AS good, 'FAIL' AS bad UNION ALL SELECT 'duplicates', (SELECT count(*) FROM dg), (SELECT count(*) FROM dg) < 0.02 * (SELECT count(*) FROM c), 'WARN' UNION ALL SELECT 'metadata', (SELECT count(*) FROM c WHERE title IS NULL OR title = '' OR published IS NULL), (SELECT count(*) FROM c WHERE title IS NULL OR title = '' OR published IS NULL) = 0, 'FAIL' UNION ALL SELECT 'encoders', 1.0, true, 'FAIL' UNION ALL SELECT 'recall', r, r > 0.80, 'WARN' FROM rc) SELECT check_name, round(CAST(m AS DOUBLE), 6) AS measured, CASE WHEN good THEN 'PASS' ELSE bad END AS verdict FROM m""")
def index_validation(spark, sf):
    c, q = chunks(spark, sf), questions(spark, sf)
    rows = c.withColumns({"index_version": F.lit("v1"), "tombstoned": F.lit(False), "embedder_tag": embed.tag("hash", "1", 192)})
    recall = metrics.recall_of(gold_of(spark, sf), lexical(spark, sf, 50), "r").agg(F.avg("r").alias("recall"))
    return index.validation(table(spark, sf, "documents"), rows, "v1", T.tokens(F.col("text")), ["title", "published"], recall)


@query(f"WITH {C}, ps AS (SELECT doc_id, tenant, i - 1 AS passage, x AS text FROM (SELECT doc_id, tenant, unnest(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS x, generate_subscripts(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), 1) AS i FROM c)) SELECT tenant, row_number() OVER (PARTITION BY tenant ORDER BY doc_id, passage) - 1 AS ordinal, doc_id, md5(text) AS text_md5 FROM ps")
def case_passages(spark, sf):
    """The passages of all documents of a tenant as those of one case."""
    c = chunks(spark, sf)
    return index.case_passages(chunk.passages(c.select("doc_id", "title", "text")), c, "tenant").select("tenant", "ordinal", "doc_id", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


# --- costs and decisions ------------------------------------------------------------------------------

CALLS = "conversations WHERE turn IS NOT NULL"
WORDS = "greatest(1, CAST(round_even(len(list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')) * 1.3, 0) AS BIGINT))"


@query(f"""WITH p AS (SELECT conv_id AS tenant, turn AS seq, text AS prompt FROM {CALLS}), pairs AS (SELECT a.tenant, a.seq, (SELECT max(n) FROM (SELECT unnest(range(0, least(length(a.prompt), length(b.prompt)) + 1)) AS n) WHERE substr(a.prompt, 1, n) = substr(b.prompt, 1, n)) AS n FROM p a JOIN p b ON a.tenant = b.tenant AND b.seq < a.seq AND b.seq >= a.seq - 24), m AS (SELECT tenant, seq, max(n) AS n FROM pairs GROUP BY ALL), t AS (SELECT p.tenant, p.seq, {WORDS.format(x='prompt')} AS total, CASE WHEN coalesce(n, 0) > 0 THEN {WORDS.format(x='substr(prompt, 1, n)')} ELSE 0 END AS hit FROM p LEFT JOIN m USING (tenant, seq)) SELECT *, total - hit AS billed FROM t""")
def prefix_billing(spark, sf):
    calls = table(spark, sf, "conversations").filter("turn IS NOT NULL").select(F.col("conv_id").alias("tenant"), F.col("turn").alias("seq"), F.col("text").alias("prompt"))
    return economy.prefix_billing(calls, 24)


GRID = "cfg AS (SELECT reranker, rerank_depth, n_candidates, out_tokens, turns FROM (SELECT unnest(['none', 'late', 'cross', 'llm']) AS reranker), (SELECT unnest([20, 50]) AS rerank_depth), (SELECT unnest([100]) AS n_candidates), (SELECT unnest([200, 450]) AS out_tokens), (SELECT unnest([1, 3]) AS turns))"


@query(f"WITH {GRID}, x AS (SELECT *, 40 + 0.5 * n_candidates AS retrieve_ms, CASE reranker WHEN 'late' THEN 10 + 0.6 * rerank_depth WHEN 'cross' THEN 20 + 4.0 * rerank_depth WHEN 'llm' THEN 300 + 12.0 * rerank_depth ELSE 0.0 END AS rerank_ms, 250 + 2.9 * out_tokens AS generate_ms FROM cfg), y AS (SELECT *, (220 + retrieve_ms + rerank_ms + generate_ms) * turns AS t FROM x) SELECT * EXCLUDE (t), round(t, 3) AS total_ms, greatest(0.0, round(2500 - t, 3)) AS headroom_ms, t <= 2500 AS within_budget FROM y")
def latency_model(spark, sf):
    def axis(name: str, values: list) -> DataFrame:
        return spark.range(1).select(F.explode(F.array(*map(F.lit, values))).alias(name))

    grid = axis("reranker", ["none", "late", "cross", "llm"])
    for name, values in (("rerank_depth", [20, 50]), ("n_candidates", [100]), ("out_tokens", [200, 450]), ("turns", [1, 3])):
        grid = grid.crossJoin(axis(name, values))
    return economy.latency_model(grid)


@query("WITH l(line, n_tokens, cost) AS (VALUES ('prefix', 3000, 0.0009), ('evidence', 4400, 0.0132), ('question', 200, 0.0006), ('answer', 450, 0.00675), ('rerank', 50, 0.1), ('search', 0, 0.00004)) SELECT line, CAST(n_tokens AS BIGINT) AS n_tokens, round(CAST(cost AS DOUBLE), 8) AS cost, round(cost / sum(cost) OVER (), 6) AS share FROM l")
def unit_economics(spark, sf):
    return economy.unit_economics(spark)


@query("WITH g AS (SELECT reuse, w FROM (SELECT unnest([2, 5, 10, 25, 60, 200]) AS reuse), (SELECT unnest([1.25, 2.0]) AS w)) SELECT reuse, max(s) FILTER (w < 1.5) AS five_minutes, max(s) FILTER (w > 1.5) AS one_hour FROM (SELECT reuse, w, round((w + 0.1 * (reuse - 1)) / reuse - 1, 6) AS s FROM g) GROUP BY reuse")
def retention_grid(spark, sf):
    return economy.retention_grid(spark, 3000, [2, 5, 10, 25, 60, 200], {"five_minutes": 1.25, "one_hour": 2.0})


@query("SELECT share, round(share * 0.9 + (1 - share) * 0.02, 6) AS blended, share * 0.9 + (1 - share) * 0.02 <= 0.15 AS inside FROM (SELECT avg(toxic) AS share FROM labels UNION ALL SELECT unnest([0.05, 0.08, 0.15, 0.3, 0.5]))")
def blended_cost(spark, sf):
    """What it costs if the share of hard questions is that of toxic documents, or one of a few."""
    shares = table(spark, sf, "labels").agg(F.avg("toxic").alias("share")).unionByName(spark.createDataFrame([(x,) for x in (0.05, 0.08, 0.15, 0.3, 0.5)], "share double"))
    return economy.blended_cost(shares, 0.9, 0.02, 0.15)


@query(f"{LEGS}, {per_question('la', 8, '_a')}, {per_question('la', 4, '_b')}, {per_question('lb', 8, '_c')}, v AS (SELECT 'k = 4' AS lever, 4.0 AS cost, avg(full_chain) AS quality FROM pm_b UNION ALL SELECT 'dense leg', 6.0, avg(full_chain) FROM pm_c), b AS (SELECT 8.0 AS c0, avg(full_chain) AS q0 FROM pm_a) SELECT lever, round((cost - c0) / c0, 6) AS cost_change, round(quality - q0, 6) AS quality_change FROM v, b")
def cost_levers(spark, sf):
    from lodestone.plans.base import legs

    _, q, a, b = legs(spark, sf)
    gold = kept(gold_of(spark, sf))

    def run(hits: DataFrame, k: int, cost: float) -> DataFrame:
        return metrics.retrieval_metrics(q, gold, hits, k).agg(F.avg("full_chain").alias("quality")).select(F.lit(cost).alias("cost"), "quality")

    a = kept(a)
    variants = run(a, 4, 4.0).select(F.lit("k = 4").alias("lever"), "cost", "quality").unionByName(run(b, 8, 6.0).select(F.lit("dense leg").alias("lever"), "cost", "quality"))
    return economy.levers(run(a, 8, 8.0), variants)


#: Names of facts, limits, owners and order of the trees' questions.
TREES = """
fault_isolation | gold_in_packed | = | false | false | Retrieval | go on
fault_isolation | gold_in_candidates | = | false | false | First-stage retrieval | end
fault_isolation | gold_intact_in_context | = | false | false | Ranking / packing | end
fault_isolation | answer_entailed | = | false | false | Generation | end
chunking | has_structure | = | true | false | Index | end
chunking | answers_span_paragraphs | = | true | false | Index | end
chunking | factoid_queries | = | true | false | Index + retrieval | end
chunking | affordable_index_pass | = | true | false | Index | end
embedding_model | corpus_can_leave_network | = | false | true | Platform | end
embedding_model | domain_vocabulary_far | = | true | false | Retrieval | end
embedding_model | multilingual | = | true | false | Retrieval | end
embedding_model | large_index | = | true | false | Platform | end
release_gate | frozen_drop | > | tolerance else 0.01D | 0D | Release gate | end
release_gate | regressed_slices | > | 0 | 0 | Product + release gate | end
release_gate | delta | abs <= | noise_band else 0D | 0D | Measurement | end
release_gate | cost_delta_pct | > | cost_envelope_pct else 15D | 0D | Budget owner | end
release_gate | p95_ms | > | p95_envelope_ms else 1e9D | 0D | Budget owner | end
"""
DOC_FACTS = {
    "gold_in_packed": "quality = 1",
    "gold_in_candidates": "quality IS NOT NULL",
    "gold_intact_in_context": "n_chars = length(text)",
    "answer_entailed": "toxic = 0",
    "has_structure": "position(chr(10) IN text) > 0",
    "answers_span_paragraphs": "length(text) - length(replace(text, '. ', ' ')) >= 30",
    "factoid_queries": "position('0' IN text) > 0",
    "affordable_index_pass": "length(text) <= 400",
    "corpus_can_leave_network": "position('@' IN text) = 0",
    "domain_vocabulary_far": "position('é' IN text) > 0",
    "multilingual": "lang <> 'en'",
    "large_index": "length(text) > 2000",
    "frozen_drop": "CAST(toxic AS DOUBLE) * 0.03",
    "regressed_slices": "1 - quality",
    "delta": "CAST(quality AS DOUBLE) - 1",
    "p95_ms": "CAST(length(text) AS DOUBLE)",
    "p95_envelope_ms": "1000.0",
}


def _tree_sql(tree: str, steps: list[str]) -> str:
    owners = [line.split("|")[5].strip() for line in TREES.splitlines() if line.startswith(f"{tree} |")]
    cases = [(at, test, owner) for at, (test, owner) in enumerate(zip(steps, owners, strict=True), 1) if test]
    return f"CASE {' '.join(f'WHEN {t} THEN {at}' for at, t, _ in cases)} ELSE {len(owners) + 1} END AS {tree}_place, " + f"CASE {' '.join(f"WHEN {t} THEN '{o}'" for _, t, o in cases)} ELSE '' END AS {tree}_owner"


@query(
    f"""WITH x AS (SELECT doc_id, {', '.join(f'({test}) AS {fact}' for fact, test in DOC_FACTS.items())} FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, {_tree_sql('fault_isolation', ['', 'NOT coalesce(gold_in_candidates, false)', 'NOT coalesce(gold_intact_in_context, false)', 'NOT coalesce(answer_entailed, false)'])},
CASE WHEN coalesce(gold_in_packed, false) THEN '' ELSE 'Retrieval' END AS fault_isolation_findings,
{_tree_sql('chunking', ['has_structure', 'answers_span_paragraphs', 'factoid_queries', 'affordable_index_pass'])},
{_tree_sql('embedding_model', ['NOT corpus_can_leave_network', 'domain_vocabulary_far', 'multilingual', 'large_index'])},
{_tree_sql('release_gate', ['coalesce(frozen_drop, 0) > 0.01', 'coalesce(regressed_slices, 0) > 0', 'abs(coalesce(delta, 0)) <= 0', 'false', 'p95_ms > p95_envelope_ms'])} FROM x"""
)
def decision_trees(spark, sf):
    """Four trees walked for every document, over facts read from its text and labels."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    unknown = {c: F.lit(None).cast("double") for c in ("tolerance", "noise_band", "cost_delta_pct", "cost_envelope_pct")}
    out = rows.select("doc_id", *(F.expr(test).alias(fact) for fact, test in DOC_FACTS.items())).withColumns(unknown)
    kept_columns = []
    for tree, nodes in economy.read_trees(TREES).items():
        names = {"owner": f"{tree}_owner", "place": f"{tree}_place", "findings": f"{tree}_findings"}
        out = economy.decide(out, nodes, "").withColumnsRenamed(names)
        kept_columns += [names["place"], names["owner"]] + ([names["findings"]] if tree == "fault_isolation" else [])
    return out.select("doc_id", *kept_columns)


@query("SELECT * FROM (VALUES ('identifiers', 'exact', 'weak', 'exact'), ('paraphrase', 'weak', 'strong', 'strong'), ('cost of an index', 'low', 'high', 'both')) AS t(criterion, lexical, dense, hybrid)")
def decision_matrix(spark, sf):
    return economy.matrix(spark, "criterion", ["lexical", "dense", "hybrid"], {"identifiers": ["exact", "weak", "exact"], "paraphrase": ["weak", "strong", "strong"], "cost of an index": ["low", "high", "both"]})


# --- events -------------------------------------------------------------------------------------------

TRACKS = "tr AS (SELECT u AS unit, u % 4 AS track FROM (SELECT unnest(range(20)) AS u)), nm(track, nth, stage) AS (VALUES (0, 0, 'Foundations'), (1, 1, 'Retrieval'), (2, 2, 'Evaluation'), (3, 3, 'Delivery'))"


@query(f"WITH {EV}, {TRACKS}, cl AS (SELECT DISTINCT login, CASE WHEN kind = 'pass' AND unit < login % 20 THEN unit END AS unit FROM ev), p AS (SELECT login, count(DISTINCT unit) AS n, max(nth) AS far FROM cl LEFT JOIN tr USING (unit) LEFT JOIN nm USING (track) GROUP BY login) SELECT login, CASE WHEN n = 0 THEN 'Starting' WHEN n >= 20 THEN 'Complete' ELSE stage END AS stage FROM p LEFT JOIN nm ON nth = far")
def learner_stages(spark, sf):
    cleared = _events(spark, sf).select("login", F.when((F.col("kind") == "pass") & (F.col("unit") < F.col("login") % 20), F.col("unit")).alias("unit"))
    tracks = spark.range(20).select(F.col("id").alias("unit"), (F.col("id") % 4).cast("int").alias("track"))
    names = spark.createDataFrame([(0, 0, "Foundations"), (1, 1, "Retrieval"), (2, 2, "Evaluation"), (3, 3, "Delivery")], "track int, nth int, stage string")
    return events.stages(cleared, tracks, names)


@query(f"WITH {EV}, f AS (SELECT unnest(['check-' || unit % 6, 'check-' || thread % 9 || '-b']) AS check_name FROM ev WHERE kind = 'fail') SELECT check_name, count(*) AS n, round(count(*) / (SELECT count(*) FROM ev WHERE kind = 'fail'), 6) AS share FROM f GROUP BY check_name ORDER BY n DESC, check_name LIMIT 10")
def failing_checks(spark, sf):
    """The ten checks that failed most; the limit is the report's."""
    named = F.array(F.concat(F.lit("check-"), (F.col("unit") % 6).cast("string")), F.concat(F.lit("check-"), (F.col("thread") % 9).cast("string"), F.lit("-b")))
    return events.failing_checks(_events(spark, sf).withColumn("checks", named))


@query(f"WITH {EV}, m AS (SELECT unit, 'graded' AS metric, CAST(count(*) FILTER (kind IN ('fail', 'pass')) AS DOUBLE) AS value FROM ev GROUP BY unit UNION ALL SELECT unit, 'hints', CAST(count(*) FILTER (kind = 'hint') AS DOUBLE) FROM ev GROUP BY unit), b AS (SELECT unit, unnest(['graded', 'hints', 'lost']) AS metric, unnest([2.0, 400.0, 1.0]) AS threshold, unnest(['at_least', 'at_most', 'at_least']) AS direction FROM (SELECT DISTINCT unit FROM ev)), c AS (SELECT * FROM b WHERE metric <> 'lost' OR unit % 4 = 0), g AS (SELECT c.unit, count(*) AS n_bars, count(*) FILTER (CASE WHEN direction = 'at_least' THEN value >= threshold ELSE value <= threshold END) AS n_passed FROM c LEFT JOIN m USING (unit, metric) GROUP BY c.unit) SELECT unit, n_bars, n_passed, unit % 3 <> 0 AND n_bars = n_passed AS passed FROM g")
def grade_bars(spark, sf):
    e = kept(_events(spark, sf))
    per = e.groupBy("unit").agg(F.count_if(F.col("kind").isin("fail", "pass")).cast("double").alias("graded"), F.count_if(F.col("kind") == "hint").cast("double").alias("hints"))
    units = e.select("unit").distinct()
    bars = units.crossJoin(F.broadcast(spark.createDataFrame([("graded", 2.0, "at_least"), ("hints", 400.0, "at_most"), ("lost", 1.0, "at_least")], "metric string, threshold double, direction string"))).filter("metric <> 'lost' OR unit % 4 = 0")
    return events.graded(per.unpivot(["unit"], ["graded", "hints"], "metric", "value"), bars, units.withColumn("ok", F.col("unit") % 3 != 0))


@query("SELECT n_nationkey AS unit FROM nation WHERE NOT n_nationkey % 4 = 0 AND (n_nationkey = 0 OR CAST(floor(n_nationkey / 3) AS INTEGER) % 4 = 0)")
def unlocked_units(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("unit"))
    return events.unlocked(n, n.filter("unit > 0").select("unit", F.floor(F.col("unit") / 3).cast("int").alias("needs")), n.filter("unit % 4 = 0"))


# --- sources ------------------------------------------------------------------------------------------


@query(f"WITH {C}, x AS (SELECT unnest([['source', source], ['tenant', tenant]]) AS p, source FROM c) SELECT p[1] AS \"of\", p[2] AS value, count(*) AS n, count(*) FILTER (source = 'src0') AS n_public FROM x GROUP BY ALL")
def corpus_statistics(spark, sf):
    return corpora.corpus_stats(chunks(spark, sf), ["source", "tenant"], public="src0")


@query(f"{BASE}, {GOLD}, f AS (SELECT chunk_id AS fact_id, doc_id % 97 AS doc_id, title AS anchor FROM c), a AS (SELECT qid, 0 AS nth, qid AS fact_id FROM q UNION ALL SELECT qid, 1, qid + 3 FROM q), j AS (SELECT qid, nth, doc_id, anchor FROM a JOIN f USING (fact_id)) SELECT qid, md5(string_agg(anchor, '|' ORDER BY nth, doc_id, anchor)) AS anchors, array_to_string(list_sort(list(DISTINCT doc_id)), ',') AS doc_ids FROM j GROUP BY qid")
def evidence_lookup(spark, sf):
    facts = chunks(spark, sf).select(F.col("chunk_id").alias("fact_id"), (F.col("doc_id") % 97).alias("doc_id"), F.col("title").alias("anchor"))
    asked = questions(spark, sf).select("qid", F.explode(F.array(F.struct(F.lit(0).alias("nth"), F.col("qid").alias("fact_id")), F.struct(F.lit(1).alias("nth"), (F.col("qid") + 3).alias("fact_id")))).alias("x")).select("qid", "x.nth", "x.fact_id")
    found = corpora.evidence_of(asked, facts)
    return found.select("qid", F.md5(F.encode(F.array_join("anchors", "|"), "UTF-8")).alias("anchors"), F.array_join(F.transform("doc_ids", lambda d: d.cast("string")), ",").alias("doc_ids"))


@query("WITH e AS (SELECT user_id AS trace_id, ts AS created_at, event_type, value, event_id, event_id % 2 AS new FROM events) SELECT trace_id, created_at, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY created_at DESC, new DESC, event_type DESC, value DESC) AS r FROM e) WHERE r = 1")
def trace_store(spark, sf):
    """The last write of each trace, in a store and in what is put into it."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("trace_id"), F.col("ts").alias("created_at"), "event_type", "value", "event_id")
    return corpora.put_traces(e.filter("event_id % 2 = 0").drop("event_id"), e.filter("event_id % 2 = 1").drop("event_id"))


@query(f"WITH {EV} SELECT login, thread, ts, kind, CAST(unit AS VARCHAR) AS unit FROM ev UNION ALL SELECT login, thread, ts, 'seen', 'u-' || unit FROM ev")
def tagged_comments(spark, sf):
    """Events read back from the tags in comments."""
    e = _events(spark, sf)
    body = F.concat(F.lit("so ["), "kind", F.lit(":"), F.col("unit").cast("string"), F.lit("] and [seen:u-"), F.col("unit").cast("string"), F.lit("] [not a tag]"))
    return corpora.tagged_events(e.select("login", "thread", "ts", body.alias("body")))


@query("SELECT CASE WHEN n_regionkey = 0 THEN '' ELSE r_name END AS area, array_to_string(list_sort(list(DISTINCT CASE WHEN n_regionkey = 0 THEN n_name ELSE r_name || '/' || n_name END)), ',') AS paths FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def content_areas(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    files = n.select(F.when(F.col("n_regionkey") == 0, F.col("n_name")).otherwise(F.concat("r_name", F.lit("/"), "n_name")).alias("path"))
    return corpora.areas(files.unionByName(files)).select("area", F.array_join("paths", ",").alias("paths"))


@query("WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS a, regexp_extract_all(lower(coalesce(lang || ' ' || source || ' the of and la de', '')), '[a-z]+') AS b FROM documents) SELECT doc_id, round(CASE WHEN len(list_distinct(list_concat(a, b))) > 0 THEN len(list_intersect(list_distinct(a), list_distinct(b))) / len(list_distinct(list_concat(a, b))) ELSE 0.0 END, 6) AS jaccard, round(CASE WHEN len(b) > 0 THEN len(list_intersect(list_distinct(b), a)) / len(list_distinct(b)) ELSE 0.0 END, 6) AS containment FROM t")
def overlap_scalars(spark, sf):
    words = lambda x: F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    d = table(spark, sf, "documents").select("doc_id", words(F.col("text")).alias("a"), words(F.concat("lang", F.lit(" "), "source", F.lit(" the of and la de"))).alias("b"))
    return d.select("doc_id", F.round(T.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"), F.round(T.containment(F.col("b"), F.col("a")), 6).alias("containment"))


@query()
def trace_ids(spark, sf):
    """Name-based identifiers of the events."""
    return table(spark, sf, "events").select("event_id", T.uuid5("6ba7b811-9dad-11d1-80b4-00c04fd430c8", F.concat(F.lit("trace/"), F.col("event_id").cast("string"))).alias("trace_id"))


@query()
def synthetic_corpus(spark, sf):
    """Documents and facts made from numbers, as many as there are documents."""
    docs, facts = corpora.synthetic(spark, table(spark, sf, "documents").count())
    return docs.join(facts.drop("doc_id"), "fact_id")


# --- chunking and evidence ----------------------------------------------------------------------------


def _strategies(spark, sf) -> dict[str, DataFrame]:
    d = _docs(spark, sf)
    return {name: chunk.chunk(d, name, size_tokens=64) for name in ("fixed", "structural")}


CUT = f"{BASE}, {FIXED}, {LINES}, sz AS (SELECT 'fixed' AS strategy, text FROM f UNION ALL SELECT 'structural', text FROM s), nm AS (SELECT strategy, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM sz), an AS (SELECT DISTINCT lower(trim(regexp_replace(a, '\\s+', ' ', 'g'))) AS a, a AS raw FROM (SELECT unnest([anchor, also]) AS a FROM q) WHERE a IS NOT NULL), wh AS (SELECT raw FROM an WHERE EXISTS (SELECT 1 FROM c WHERE contains(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), a))), ke AS (SELECT DISTINCT strategy, raw FROM an JOIN nm ON contains(t, a))"


@query(f"{CUT}, st2(strategy) AS (VALUES ('fixed'), ('structural')), r AS (SELECT strategy, (SELECT count(*) FROM wh) AS in_documents, (SELECT count(*) FROM wh WHERE raw IN (SELECT raw FROM ke WHERE ke.strategy = st2.strategy)) AS in_chunks FROM st2) SELECT *, round(CASE WHEN in_documents > 0 THEN 1 - in_chunks / in_documents ELSE 0.0 END, 6) AS damage FROM r")
def boundary_damage(spark, sf):
    """How much evidence the boundaries of chunks cut, by strategy."""
    d = chunks(spark, sf).select("doc_id", "text")
    return chunk.boundary_damages(anchors(spark, sf), d, _strategies(spark, sf))


@query(f"{CUT}, z AS (SELECT strategy, CAST(greatest(1, ceil(length(text) / 4.0)) AS BIGINT) AS n FROM sz), t AS (SELECT strategy, count(*) AS chunks, CAST(floor(median(n)) AS BIGINT) AS median, list_sort(list(n))[CAST(floor(count(*) * 0.9) AS INTEGER) + 1] AS p90, max(n) AS largest, CAST(sum(n) AS BIGINT) AS total FROM z GROUP BY strategy) SELECT *, round(total / (SELECT total FROM t WHERE strategy = 'fixed'), 6) AS storage_x, (SELECT count(*) FROM an) - (SELECT count(*) FROM ke WHERE ke.strategy = t.strategy) AS unresolved FROM t")
def chunking_bakeoff(spark, sf):
    """Strategies side by side: sizes, storage against the first, and evidence that no chunk holds."""
    found = {name: kept(c) for name, c in _strategies(spark, sf).items()}
    asked = anchors(spark, sf).select("anchor").distinct().withColumn("qid", F.xxhash64("anchor"))
    n = kept(asked).count()
    parts = []
    for name, c in found.items():
        resolved = retrieve.resolve_gold(asked, c).select("qid").distinct().agg((F.lit(n) - F.count("*")).alias("unresolved"))
        parts.append(chunk.chunk_stats(c, found["fixed"]).crossJoin(resolved).select(F.lit(name).alias("strategy"), "*"))
    return functools.reduce(DataFrame.unionByName, parts)
