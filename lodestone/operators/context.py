"""Prompts from packed evidence: rendered blocks, budgets, cacheable beginnings, places of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import approx_tokens
from lodestone.operators import pack

SYSTEM = "Answer from the evidence alone and cite every claim by its block."
CONTRACT = 'Reply with JSON: {"answer": text, "citations": [blocks], "sufficient": true or false}.'
NONE = "(none)"
#: Tokens that each part of a context may take.
BUDGET = {"system": 2200, "tools": 1600, "question": 1000, "evidence": 18000, "output": 4500, "headroom": 4700}
#: Parts of a prompt from the one that changes least often to the one that always does.
VOLATILITY = {"system": "per release", "tools": "per release", "examples": "per release", "tenant": "per tenant", "conversation": "per turn", "evidence": "per query", "question": "per query"}


def evidence_block() -> Column:
    """A hit (place, title, source, published, doc_id, ordinal, n_chunks, score, text) as a block with its origin.

    Fixed value: the layout of a block.
    """
    nth = F.concat((F.col("ordinal") + 1).cast("string"), F.lit("/"), F.col("n_chunks").cast("string"))
    head = F.concat(
        F.lit("[S"), F.col("place").cast("string"), F.lit('] title: "'), F.col("title"), F.lit('"\nsource: '), F.col("source"), F.lit(" · published: "), F.col("published"),
        F.lit("\ndoc_id: "), F.col("doc_id").cast("string"), F.lit(" · chunk: "), nth, F.lit(" · score: "), F.round("score", 3).cast("string"),
    )
    return F.concat(head, F.lit("\n---\n"), F.trim("text"))


def build_prompt(questions: DataFrame, hits: DataFrame, k: int = 8, cap: int = 6000, system: str = SYSTEM, contract: str = CONTRACT, tools: str = "", tenant: str = "", restate: bool = True) -> DataFrame:
    """(qid, prompt, blocks, n_dropped, tokens, source_map) of (qid, query) and ranked hits.

    Of the first ``k`` hits each block that still fits under the cap is taken, later ones may fit where an
    earlier one did not; all others are dropped whole. Parts go from what changes least to what always does.
    """
    placed = hits.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("rank", "chunk_id")))
    counts = placed.groupBy("qid").agg(F.count("*").alias("n_hits"))
    rendered = placed.filter(F.col("place") <= k).withColumn("rendered", evidence_block()).withColumn("n_tokens", approx_tokens(F.col("rendered")))
    taken = pack.pack(rendered.select("qid", F.col("place").alias("rank"), "chunk_id", "n_tokens"), k, cap).select("qid", "chunk_id", "used")
    block = F.struct("place", "chunk_id", "rendered", "n_tokens")
    blocks = rendered.join(taken, ["qid", "chunk_id"]).groupBy("qid").agg(F.sort_array(F.collect_list(block)).alias("blocks"))
    rows = questions.select("qid", "query").join(blocks, "qid", "left").join(counts, "qid", "left").withColumn("blocks", F.coalesce("blocks", F.array().cast(blocks.schema["blocks"].dataType)))
    evidence = F.when(F.size("blocks") > 0, F.array_join(F.transform("blocks", lambda b: b["rendered"]), "\n\n")).otherwise(NONE)
    parts = [F.lit(system), *([F.lit("TOOLS\n" + tools)] if tools else []), *([F.lit("TENANT\n" + tenant)] if tenant else []), F.concat(F.lit("EVIDENCE\n"), evidence), F.concat(F.lit("QUESTION\n"), "query")]
    parts += [F.lit("Answer the QUESTION above from EVIDENCE alone.")] if restate else []
    fixed = approx_tokens(F.lit(system)) + approx_tokens(F.lit(contract))
    tokens = F.create_map(
        F.lit("system"), fixed, F.lit("tools"), approx_tokens(F.lit(tools)) if tools else F.lit(0), F.lit("tenant"), approx_tokens(F.lit(tenant)) if tenant else F.lit(0),
        F.lit("evidence"), F.aggregate("blocks", F.lit(0), lambda n, b: n + b["n_tokens"]), F.lit("question"), approx_tokens(F.col("query")),
    )
    named = F.map_from_entries(F.transform("blocks", lambda b: F.struct(F.concat(F.lit("S"), b["place"].cast("string")), b["chunk_id"])))
    return rows.select("qid", F.concat_ws("\n\n", *parts, F.lit(contract)).alias("prompt"), "blocks", (F.coalesce("n_hits", F.lit(0)) - F.size("blocks")).alias("n_dropped"), tokens.alias("tokens"), named.alias("source_map"))


def total_tokens(tokens: Column) -> Column:
    return F.aggregate(F.map_values(tokens), F.lit(0), lambda n, x: n + x)


def cacheable_prefix(prompts: DataFrame) -> DataFrame:
    """(qid, stable_tokens, volatile_tokens, stable_share) of a prompt's part that no question changes."""
    stable = F.col("tokens")["system"] + F.col("tokens")["tools"] + F.col("tokens")["tenant"]
    total = total_tokens(F.col("tokens"))
    return prompts.select("qid", stable.alias("stable_tokens"), (total - stable).alias("volatile_tokens"), F.round(F.when(total > 0, stable / total).otherwise(0.0), 6).alias("stable_share"))


def budget_use(spark: SparkSession, prompts: DataFrame, budget: dict[str, int] | None = None) -> DataFrame:
    """(part, cap, used, utilisation): mean tokens of each part of the prompts against its budget."""
    caps = spark.createDataFrame([(k, v) for k, v in (budget or BUDGET).items()], "part string, cap int")
    used = prompts.select(F.explode("tokens").alias("part", "n")).groupBy("part").agg(F.round(F.avg("n"), 3).alias("used"))
    return caps.join(used, "part", "left").select("part", "cap", F.coalesce("used", F.lit(0.0)).alias("used"), F.round(F.coalesce("used", F.lit(0.0)) / F.col("cap"), 6).alias("utilisation"))


def place_gold(hits: DataFrame, gold: DataFrame, where: str) -> DataFrame:
    """(qid, chunk_id, place): the hits with those that are gold moved to the first, middle or last places."""
    if where not in ("first", "middle", "last"):
        raise KeyError(f"no place {where!r}; there are first, middle, last")
    marked = hits.join(gold.select("qid", "chunk_id").distinct().withColumn("g", F.lit(True)), ["qid", "chunk_id"], "left").withColumn("g", F.coalesce("g", F.lit(False)))
    others = F.count_if(~F.col("g")).over(Window.partitionBy("qid"))
    nth = F.row_number().over(Window.partitionBy("qid", "g").orderBy("rank", "chunk_id"))
    late = F.lit(0) if where == "first" else others if where == "last" else F.floor(others / 2).cast("int")
    key = marked.withColumn("key", F.when(F.col("g"), late + 0.5).otherwise(nth))
    return key.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("key", "rank", "chunk_id"))).select("qid", "chunk_id", "place")


def parse_reply(raw: Column, abstain: str = "INSUFFICIENT_EVIDENCE") -> Column:
    """(answer, citations, sufficient) of a model's reply: its JSON object, or the text and the blocks it names."""
    found = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    schema = "answer string, citations array<string>, sufficient boolean"
    got = F.from_json(found, schema + ", _corrupt_record string", {"mode": "PERMISSIVE"})
    good = (found != "") & got["_corrupt_record"].isNull()
    sids = F.transform(F.regexp_extract_all(raw, F.lit(r"\[(S\d+)\]"), F.lit(1)), lambda s: s)
    return F.struct(
        F.when(good, F.coalesce(got["answer"], F.lit(""))).otherwise(F.trim(raw)).alias("answer"),
        F.when(good, F.coalesce(got["citations"], F.array().cast("array<string>"))).otherwise(sids).alias("citations"),
        F.when(good, F.coalesce(got["sufficient"], F.lit(True))).otherwise(~F.contains(raw, F.lit(abstain))).alias("sufficient"),
    )


def ungrounded(questions: DataFrame, priors: dict[str, str] | None = None) -> DataFrame:
    """(qid, answer): confident answers that ignore the evidence, to prove that judges notice them."""
    subject = F.rtrim(F.array_join(F.slice(F.split("query", " "), 2, 5), " "))
    answer = F.concat(F.lit("From what is known, "), F.regexp_replace(subject, r"\?+$", ""), F.lit(" is confirmed by the sources. [S1]"))
    for key, value in reversed((priors or {}).items()):
        answer = F.when(F.contains(F.lower("query"), F.lit(key.lower())), F.lit(f"{value} [S1]")).otherwise(answer)
    return questions.select("qid", answer.alias("answer"))
