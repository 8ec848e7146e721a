"""Queries on packing, prompts, answers and their judgement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import context, judge, pack
from lodestone.plans.base import BASE, GOLD, TERMS, any_gold, bm, chunks, gold_of, lexical, query, questions, sents, tok

TOKENS = "CAST(greatest(1, ceil(length({x}) / 4.0)) AS INTEGER)"


def hits_with(spark: SparkSession, sf: str, n: int) -> DataFrame:
    """BM25 hits with what a prompt shows of them."""
    c = chunks(spark, sf)
    shown = c.select("chunk_id", "doc_id", "text", "title", "source", "published", F.lit(0).alias("ordinal"), F.lit(1).alias("n_chunks"))
    return lexical(spark, sf, n).join(shown, "chunk_id")


def prompts(spark: SparkSession, sf: str, **parameters) -> DataFrame:
    return context.build_prompt(questions(spark, sf).select("qid", "query"), hits_with(spark, sf, 10), cap=1500, **parameters)


# a fold over the places of a question's hits, as SQL has it
PROMPT = f"""{BASE}, {TERMS}, {bm('la', 10)}, rd AS (SELECT qid, rank AS place, chunk_id, '[S' || rank || '] title: "' || title || '"' || chr(10) || 'source: ' || source || ' · published: ' || published || chr(10) || 'doc_id: ' || doc_id || ' · chunk: 1/1 · score: ' || CAST(round(score, 3) AS VARCHAR) || chr(10) || '---' || chr(10) || trim(text) AS rendered FROM la JOIN c USING (chunk_id) WHERE rank <= 8),
rt AS (SELECT *, {TOKENS.format(x='rendered')} AS n FROM rd), fold AS (WITH RECURSIVE z AS (SELECT qid, 0 AS pos, CAST(0 AS BIGINT) AS used, CAST([] AS INTEGER[]) AS places FROM (SELECT DISTINCT qid FROM rt) UNION ALL SELECT z.qid, pos + 1, CASE WHEN used + n <= 1500 THEN used + n ELSE used END, CASE WHEN used + n <= 1500 THEN list_append(places, CAST(pos + 1 AS INTEGER)) ELSE places END FROM z JOIN rt ON rt.qid = z.qid AND rt.place = z.pos + 1) SELECT * FROM z),
fin AS (SELECT qid, used, places FROM fold JOIN (SELECT qid, max(pos) AS pos FROM fold GROUP BY qid) USING (qid, pos)), bk AS (SELECT qid, count(*) AS n_blocks, string_agg(rendered, chr(10) || chr(10) ORDER BY place) AS evidence, string_agg('S' || place || '=' || chunk_id, ',' ORDER BY place) AS source_map FROM rt JOIN fin USING (qid) WHERE list_contains(places, place) GROUP BY qid),
pr AS (SELECT q.qid, CAST(coalesce(n_blocks, 0) AS INTEGER) AS n_blocks, coalesce((SELECT count(*) FROM la WHERE la.qid = q.qid), 0) - coalesce(n_blocks, 0) AS n_dropped, CAST(coalesce(used, 0) AS INTEGER) AS evidence, {TOKENS.format(x='query')} AS question, coalesce(source_map, '') AS source_map,
'{context.SYSTEM}' || chr(10) || chr(10) || 'EVIDENCE' || chr(10) || coalesce(bk.evidence, '{context.NONE}') || chr(10) || chr(10) || 'QUESTION' || chr(10) || query || chr(10) || chr(10) || 'Answer the QUESTION above from EVIDENCE alone.' || chr(10) || chr(10) || '{context.CONTRACT}' AS prompt FROM q LEFT JOIN bk USING (qid) LEFT JOIN fin USING (qid))"""
STABLE = -(-len(context.SYSTEM) // 4) + -(-len(context.CONTRACT) // 4)


@query(f"{PROMPT} SELECT qid, n_blocks, n_dropped, evidence, question, source_map, md5(prompt) AS prompt_md5 FROM pr")
def build_prompt(spark, sf):
    named = F.array_join(F.transform("blocks", lambda b: F.concat(F.lit("S"), b["place"].cast("string"), F.lit("="), b["chunk_id"].cast("string"))), ",")
    p = prompts(spark, sf)
    return p.select("qid", F.size("blocks").alias("n_blocks"), "n_dropped", F.col("tokens")["evidence"].alias("evidence"), F.col("tokens")["question"].alias("question"), named.alias("source_map"), F.md5(F.encode("prompt", "UTF-8")).alias("prompt_md5"))


@query(f"{PROMPT} SELECT qid, place, n, md5(rendered) AS block_md5 FROM rt")
def evidence_blocks(spark, sf):
    blocks = hits_with(spark, sf, 8).withColumn("place", F.col("rank")).withColumn("rendered", context.evidence_block())
    return blocks.select("qid", "place", T.approx_tokens(F.col("rendered")).alias("n"), F.md5(F.encode("rendered", "UTF-8")).alias("block_md5"))


@query(f"{PROMPT} SELECT qid, {STABLE} AS stable_tokens, evidence + question AS volatile_tokens, round({STABLE} / (evidence + question + {STABLE}), 6) AS stable_share FROM pr")
def cacheable_prefix(spark, sf):
    return context.cacheable_prefix(prompts(spark, sf))


@query(f"{PROMPT}, u(part, used) AS (SELECT 'system', {STABLE}.0 UNION ALL SELECT 'evidence', round(avg(evidence), 3) FROM pr UNION ALL SELECT 'question', round(avg(question), 3) FROM pr), b(part, cap) AS (VALUES {', '.join(f"('{k}', {v})" for k, v in context.BUDGET.items())}) SELECT part, cap, CAST(coalesce(used, 0) AS DOUBLE) AS used, round(coalesce(used, 0) / cap, 6) AS utilisation FROM b LEFT JOIN u USING (part)")
def budget_table(spark, sf):
    return context.budget_use(spark, prompts(spark, sf))


PLACED = "CASE WHEN gg THEN {late} + 0.5 ELSE nth END"


@query(
    f"{BASE}, {TERMS}, {bm('la', 8)}, {GOLD}, mk AS (SELECT la.*, g.qid IS NOT NULL AS gg FROM la LEFT JOIN g USING (qid, chunk_id)), nt AS (SELECT *, count(*) FILTER (NOT gg) OVER (PARTITION BY qid) AS others, row_number() OVER (PARTITION BY qid, gg ORDER BY rank, chunk_id) AS nth FROM mk) "
    + " UNION ALL ".join(f"SELECT '{w}' AS position, qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY {PLACED.format(late=late)}, rank, chunk_id) AS place FROM nt" for w, late in (("first", "0"), ("middle", "floor(others / 2)"), ("last", "others")))
)
def gold_positions(spark, sf):
    """Where the gold stands in a context when it is moved to its beginning, middle or end."""
    hits, gold = lexical(spark, sf, 8), any_gold(gold_of(spark, sf))
    parts = [context.place_gold(hits, gold, w).select(F.lit(w).alias("position"), "*") for w in ("first", "middle", "last")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


REPLY = """raw AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Here: {"answer": "a' || conv_id || '", "citations": ["S1", "S' || turn || '"], "sufficient": false} ok' WHEN 1 THEN 'It is so [S2] and so [S12]. ' WHEN 2 THEN '{"answer": "no citations"}' ELSE 'INSUFFICIENT_EVIDENCE {broken' END AS raw FROM conversations WHERE turn IS NOT NULL)"""


@query(f"WITH {REPLY} SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'a' || conv_id WHEN 1 THEN 'It is so [S2] and so [S12].' WHEN 2 THEN 'no citations' ELSE 'INSUFFICIENT_EVIDENCE {{broken' END AS answer, CASE turn % 4 WHEN 0 THEN 'S1,S' || turn WHEN 1 THEN 'S2,S12' ELSE '' END AS citations, turn % 4 IN (1, 2) AS sufficient FROM raw")
def parse_model_json(spark, sf):
    """Replies of four shapes: an object within text, text that cites, an object with gaps, a broken one."""
    from lodestone.sources import table

    table(spark, sf, "conversations").createOrReplaceTempView("conversations")
    raw = spark.sql(f"WITH {REPLY} SELECT * FROM raw")
    got = raw.select("conv_id", "turn", context.parse_reply(F.col("raw")).alias("p"))
    return got.select("conv_id", "turn", "p.answer", F.array_join("p.citations", ",").alias("citations"), "p.sufficient")


def extract_sql(blocks: str) -> str:
    """SQL of the extractive answers ex (qid, answer, cites, sufficient) from a relation of blocks."""
    return f"""xb AS (SELECT qid, rank, text, list_distinct({tok('text')}) AS t FROM {blocks}), xn AS (SELECT qid, count(*) AS n FROM xb GROUP BY qid), xd AS (SELECT qid, term, count(*) AS df FROM (SELECT qid, unnest(t) AS term FROM xb) GROUP BY ALL),
xw AS (SELECT z.qid, z.term, CASE WHEN df IS NULL THEN 1.6 ELSE ln((1 + n) / (1 + df)) + 1.0 END AS w FROM (SELECT qid, unnest(list_distinct({tok('query')})) AS term FROM q) z JOIN xn USING (qid) LEFT JOIN xd USING (qid, term)), xt AS (SELECT qid, sum(w) AS total FROM xw GROUP BY qid),
xs AS (SELECT qid, rank, unnest(s) AS s, generate_subscripts(s, 1) AS ix FROM (SELECT qid, rank, {sents('text')} AS s FROM xb)), xc AS (SELECT e.qid, rank, ix, s, round(sum(w) / any_value(total), 6) AS cov FROM (SELECT *, unnest(list_distinct({tok('s')})) AS term FROM xs WHERE length(s) >= 20) e JOIN xw USING (qid, term) JOIN xt USING (qid) GROUP BY ALL),
xr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(cov + 0.14 / rank + CASE WHEN regexp_matches(query, '{judge.QUANTITY}') AND regexp_matches(s, '[0-9]') THEN 0.10 ELSE 0.0 END, 6) DESC, rank, ix) AS r FROM xc JOIN q USING (qid) WHERE cov >= 0.15), xu AS (SELECT qid, s, min(r) AS r, arg_min(rank, r) AS rank FROM xr WHERE r <= 2 GROUP BY qid, s),
ex AS (SELECT q.qid, coalesce(a, 'INSUFFICIENT_EVIDENCE') AS answer, coalesce(cs, '') AS citations, a IS NOT NULL AS sufficient FROM q LEFT JOIN (SELECT qid, string_agg(s || ' [S' || rank || ']', ' ' ORDER BY r) AS a, array_to_string(list_filter(list('S' || rank ORDER BY r), lambda x, i: list_position(list('S' || rank ORDER BY r), x) = i), ',') AS cs FROM xu GROUP BY qid) USING (qid))"""


BLOCKS = f"{BASE}, {TERMS}, {bm('la', 4)}, bl AS (SELECT qid, rank, text FROM la JOIN c USING (chunk_id))"


def blocks_of(spark, sf, n: int = 4) -> DataFrame:
    c = chunks(spark, sf)
    return lexical(spark, sf, n).join(c.select("chunk_id", "text"), "chunk_id")


@query(f"{BLOCKS}, {extract_sql('bl')} SELECT * FROM ex")
def extractive_answer(spark, sf):
    return judge.extractive(questions(spark, sf), blocks_of(spark, sf)).withColumn("citations", F.array_join("citations", ","))


def claims_sql(answers: str) -> str:
    """SQL of the judgement jc on the citations of (qid, answer) against the blocks bl."""
    return f"""cp AS (SELECT qid, unnest(p) AS part FROM (SELECT qid, regexp_extract_all(answer, '\\[S\\d+\\][^\\[]*') AS p FROM {answers})), cc AS (SELECT qid, CAST(regexp_extract(part, '\\[S(\\d+)\\]', 1) AS INTEGER) AS rank, list_distinct({tok("regexp_replace(part, '\\[S\\d+\\]', '', 'g')")}) AS ct FROM cp),
cs AS (SELECT cc.qid, bl.qid IS NULL AS un, CASE WHEN len(ct) = 0 THEN 1.0 ELSE coalesce(len(list_intersect(ct, list_distinct({tok('bl.text')}))) / len(ct), 0.0) END AS share FROM cc LEFT JOIN bl ON bl.qid = cc.qid AND bl.rank = cc.rank),
jc AS (SELECT x.qid, count(un) AS n_cited, count(*) FILTER (un) AS n_unresolved, count(*) FILTER (share < 0.5) AS n_weak FROM {answers} x LEFT JOIN cs USING (qid) GROUP BY x.qid)"""


@query(f"{BLOCKS}, {extract_sql('bl')}, an AS (SELECT qid, CASE WHEN qid % 3 = 0 THEN answer || ' [S9] and nothing else' ELSE answer END AS answer FROM ex), {claims_sql('an')} SELECT *, CASE WHEN n_cited = 0 THEN 0.0 ELSE round(1 - (n_unresolved + n_weak) / n_cited, 6) END AS score, CASE WHEN n_cited > 0 AND n_unresolved + n_weak = 0 THEN 'pass' ELSE 'fail' END AS label FROM jc")
def judge_citations(spark, sf):
    """Citations of extracted answers, some of which cite a block that isn't there."""
    b = blocks_of(spark, sf)
    said = judge.extractive(questions(spark, sf), b)
    odd = F.when(F.col("qid") % 3 == 0, F.concat("answer", F.lit(" [S9] and nothing else"))).otherwise(F.col("answer"))
    return judge.citations(said.select("qid", odd.alias("answer")), b)


def faith_sql(answers: str, name: str, threshold: float) -> str:
    """SQL of the faithfulness labels of (qid, answer)."""
    return f"""{name}_s AS (SELECT qid, generate_subscripts(s, 1) AS i, unnest(s) AS claim FROM (SELECT qid, list_filter({sents("regexp_replace(answer, '\\[S\\d+\\]', '', 'g')")}, lambda s: length(s) > 12) AS s FROM {answers})), {name}_b AS (SELECT y.qid, i, max(CASE WHEN len(list_distinct({tok('claim')})) = 0 THEN 1.0 ELSE coalesce(len(list_intersect(list_distinct({tok('claim')}), list_distinct({tok('bl.text')}))) / len(list_distinct({tok('claim')})), 0.0) END) AS best FROM {name}_s y LEFT JOIN bl USING (qid) GROUP BY ALL),
{name} AS (SELECT x.qid, CASE WHEN count(*) FILTER (best < {threshold}) = 0 THEN 'pass' ELSE 'fail' END AS label FROM {answers} x LEFT JOIN {name}_b USING (qid) GROUP BY x.qid)"""


@query(f"{BLOCKS}, an AS (SELECT qid, anchor AS answer FROM q), {faith_sql('an', 'j1', 0.35)}, {faith_sql('an', 'j2', 0.5)}, {faith_sql('an', 'j3', 0.7)} " + " UNION ALL ".join(f"SELECT {t} AS threshold, count(*) FILTER (label = 'pass') AS passes, count(*) AS n FROM {j}" for j, t in (("j1", 0.35), ("j2", 0.5), ("j3", 0.7))))
def judge_drift(spark, sf):
    """How many answers pass when nothing but the judge's threshold changes."""
    b, answers = blocks_of(spark, sf), questions(spark, sf).select("qid", F.col("anchor").alias("answer"))
    parts = [judge.faithfulness(answers, b, t).agg(F.count_if(F.col("label") == "pass").alias("passes"), F.count("*").alias("n")).select(F.lit(t).alias("threshold"), "*") for t in (0.35, 0.5, 0.7)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"{BLOCKS}, an AS (SELECT qid, anchor AS answer FROM q), pad AS (SELECT qid, answer || ' As said before, this is what has been said. ' || answer AS answer FROM an), {faith_sql('an', 'j1', 0.5)}, {faith_sql('pad', 'j2', 0.5)}, {faith_sql('an', 'j3', 0.5)}, m AS (SELECT 'verbosity' AS probe, count(*) AS n, count(*) FILTER (j1.label <> j2.label) AS n_moved FROM j1 JOIN j2 USING (qid) UNION ALL SELECT 'position', count(*), count(*) FILTER (j1.label <> j3.label) FROM j1 JOIN j3 USING (qid)) SELECT *, CASE WHEN n_moved = 0 THEN 'stable' ELSE 'biased' END AS verdict FROM m")
def judge_probes(spark, sf):
    """Whether padding an answer, or turning the order of its blocks around, moves the verdict."""
    b, q = blocks_of(spark, sf), questions(spark, sf)
    answers = q.select("qid", F.col("anchor").alias("answer"))
    padded = answers.select("qid", F.concat("answer", F.lit(" As said before, this is what has been said. "), "answer").alias("answer"))
    turned = b.withColumn("rank", -F.col("rank"))
    plain = judge.faithfulness(answers, b)
    return judge.moved(plain, judge.faithfulness(padded, b)).select(F.lit("verbosity").alias("probe"), "*").unionByName(judge.moved(plain, judge.faithfulness(answers, turned)).select(F.lit("position").alias("probe"), "*"))


@query(f"{BASE}, u AS (SELECT qid, 'From what is known, ' || regexp_replace(rtrim(array_to_string(list_slice(string_split(query, ' '), 2, 6), ' ')), '\\?+$', '') || ' is confirmed by the sources. [S1]' AS answer FROM q), bl AS (SELECT qid, 1 AS rank, anchor AS text FROM q), {faith_sql('u', 'j', 0.5)} SELECT qid, md5(answer) AS answer_md5, label FROM u JOIN j USING (qid)")
def ungrounded_answers(spark, sf):
    """What the judge makes of answers that ignore the evidence."""
    q = questions(spark, sf)
    said = context.ungrounded(q)
    judged = judge.faithfulness(said, q.select("qid", F.lit(1).alias("rank"), F.col("anchor").alias("text")))
    return said.join(judged, "qid").select("qid", F.md5(F.encode("answer", "UTF-8")).alias("answer_md5"), "label")


def entities(spark, sf) -> DataFrame:
    """(qid, entity): the longest tokens of the one or two texts that a question asks for."""
    def longest(text):
        return F.sort_array(F.transform(T.tokens(text), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))[0]["t"]

    found = questions(spark, sf).select("qid", F.explode(F.array(longest(F.col("anchor")), longest(F.col("also")))).alias("entity"))
    return found.filter(F.col("entity").isNotNull()).distinct()


LONGEST = "(SELECT t FROM (SELECT unnest({x}) AS t) ORDER BY length(t) DESC, t LIMIT 1)"
ENT = f"en AS (SELECT DISTINCT qid, entity FROM (SELECT qid, {LONGEST.format(x=tok('anchor'))} AS entity FROM q UNION ALL SELECT qid, {LONGEST.format(x=tok('also'))} FROM q WHERE also IS NOT NULL) WHERE entity IS NOT NULL)"


@query()
def quota_pack(spark, sf):
    c = chunks(spark, sf)
    hits = lexical(spark, sf, 20).join(c.select("chunk_id", "text", T.approx_tokens(F.col("text")).alias("n_tokens")), "chunk_id")
    return pack.quota(hits, entities(spark, sf), 8, 4000)


@query(f"{BASE}, {TERMS}, {bm('la', 8)}, {ENT}, ov AS (SELECT entity, count(*) AS m FROM (SELECT DISTINCT entity FROM en) JOIN c ON contains(lower(text), lower(entity)) GROUP BY entity), me AS (SELECT en.qid, en.entity, count(*) AS n FROM en JOIN la USING (qid) JOIN c USING (chunk_id) WHERE contains(lower(text), lower(entity)) GROUP BY ALL), pv AS (SELECT en.qid, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM en LEFT JOIN me USING (qid, entity) LEFT JOIN ov USING (entity)) SELECT qid, round(CASE WHEN sum(n) > 0 THEN min(n) / sum(n) END, 6) AS weakest, round(max(m) / greatest(1, min(m)), 6) AS prevalence FROM pv GROUP BY qid")
def comparison_starvation(spark, sf):
    c = chunks(spark, sf)
    return pack.entity_shares(lexical(spark, sf, 8), c, entities(spark, sf))
