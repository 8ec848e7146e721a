"""Answers and their judgement: extraction, faithfulness, completeness, correctness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import normalized, sentences, tokens

ABSTAIN = "INSUFFICIENT_EVIDENCE"
#: What a question says that asks for a quantity.
QUANTITY = r"(?i)\b(how much|how many|revenue|growth|price|rate|percentage|consideration|paid|cost|amount|sales|top line)\b"


def extractive(questions: DataFrame, blocks: DataFrame, threshold: float = 0.15, most: int = 2, prior: float = 0.14, bonus: float = 0.10, least_score: float | None = None) -> DataFrame:
    """(qid, answer, citations, sufficient): the best supported sentences of (qid, rank, text), with their places.

    A question's terms are weighted by how rare they are among its blocks; earlier blocks get a prior, and
    sentences with a number a bonus where the question asks for a quantity. With ``least_score`` a question
    whose blocks (score) all score below it is not answered.
    """
    if least_score is not None:
        enough = blocks.groupBy("qid").agg(F.max("score").alias("top")).filter(F.col("top") >= least_score).select("qid")
        blocks = blocks.join(enough, "qid", "left_semi")
    tok = blocks.select("qid", "rank", "text", F.array_distinct(tokens(F.col("text"))).alias("t"))
    n = tok.groupBy("qid").agg(F.count("*").alias("n"))
    terms = questions.select("qid", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    df = tok.select("qid", F.explode("t").alias("term")).groupBy("qid", "term").agg(F.count("*").alias("df"))
    weights = terms.join(df, ["qid", "term"], "left").join(n, "qid").select("qid", "term", F.when(F.col("df").isNull(), 1.6).otherwise(F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1.0).alias("w"))
    total = weights.groupBy("qid").agg(F.sum("w").alias("total"))
    asks = questions.select("qid", F.regexp_like("query", F.lit(QUANTITY)).alias("asks"))
    parts = tok.select("qid", "rank", F.posexplode(sentences(F.col("text"))).alias("at", "s")).filter(F.length("s") >= 20)
    found = parts.withColumn("term", F.explode(F.array_distinct(tokens(F.col("s"))))).join(weights, ["qid", "term"]).groupBy("qid", "rank", "at", "s").agg(F.sum("w").alias("w")).join(total, "qid").join(asks, "qid")
    extra = F.when(F.col("asks") & F.col("s").rlike("[0-9]"), bonus).otherwise(0.0)
    scored = found.select("qid", "rank", "at", "s", F.round(F.col("w") / F.col("total"), 6).alias("cov"), extra.alias("extra")).withColumn("score", F.round(F.col("cov") + F.lit(prior) / F.col("rank") + F.col("extra"), 6))
    best = scored.filter(F.col("cov") >= threshold).withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "rank", "at"))).filter(F.col("r") <= most)
    best = best.groupBy("qid", "s").agg(F.min(F.struct("r", "rank")).alias("at")).select("qid", "s", "at.r", "at.rank")
    ordered = best.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("r", "s", "rank"))).alias("x"))
    sid = lambda v: F.concat(F.lit("S"), v["rank"].cast("string"))
    said = ordered.select("qid", F.array_join(F.transform("x", lambda v: F.concat(v["s"], F.lit(" ["), sid(v), F.lit("]"))), " ").alias("answer"), F.array_distinct(F.transform("x", sid)).alias("citations"))
    return questions.select("qid").join(said, "qid", "left").select("qid", F.coalesce("answer", F.lit(ABSTAIN)).alias("answer"), F.coalesce("citations", F.array().cast("array<string>")).alias("citations"), F.col("answer").isNotNull().alias("sufficient"))


def abstained(answer: Column) -> Column:
    return F.contains(F.lower(answer), F.lit(ABSTAIN.lower()))


def citations(answers: DataFrame, blocks: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(qid, n_cited, n_unresolved, n_weak, score, label): blocks (qid, rank, text) that an answer cites in vain.

    Each [S#] that no block has is unresolved; a claim is the text behind one citation up to the next, and is
    weak if the block that it opens with covers too little of it. An answer without citations fails.
    """
    cited = answers.select("qid", F.posexplode(F.regexp_extract_all("answer", F.lit(r"\[S\d+\][^\[]*"), F.lit(0))).alias("i", "part"))
    claims = cited.select("qid", "i", F.regexp_extract("part", r"\[S(\d+)\]", 1).cast("int").alias("rank"), F.array_distinct(tokens(F.regexp_replace("part", r"\[S\d+\]", ""))).alias("ct"))
    against = claims.join(blocks.select("qid", "rank", F.array_distinct(tokens(F.col("text"))).alias("bt")), ["qid", "rank"], "left")
    share = F.when(F.size("ct") == 0, 1.0).otherwise(F.coalesce(F.size(F.array_intersect("ct", "bt")) / F.size("ct"), F.lit(0.0)))
    per = against.groupBy("qid").agg(F.count("*").alias("n_cited"), F.count_if(F.col("bt").isNull()).alias("n_unresolved"), F.count_if(share < threshold).alias("n_weak"))
    out = answers.select("qid").join(per, "qid", "left").na.fill(0, ["n_cited", "n_unresolved", "n_weak"])
    bad = F.col("n_unresolved") + F.col("n_weak")
    return out.withColumns({"score": F.when(F.col("n_cited") == 0, 0.0).otherwise(F.round(1 - bad / F.col("n_cited"), 6)), "label": F.when((F.col("n_cited") > 0) & (bad == 0), "pass").otherwise("fail")})


def moved(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (n, n_moved, verdict): whether two judgements (qid, label) of what should be alike differ."""
    both = a.select("qid", F.col("label").alias("la")).join(b.select("qid", F.col("label").alias("lb")), "qid")
    out = both.agg(F.count("*").alias("n"), F.count_if(F.col("la") != F.col("lb")).alias("n_moved"))
    return out.withColumn("verdict", F.when(F.col("n_moved") == 0, "stable").otherwise("biased"))


def faithfulness(answers: DataFrame, blocks: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(qid, n_claims, n_bad, score, label): claims of (qid, answer) that no block of (qid, text) supports."""
    stripped = F.regexp_replace("answer", r"\[S\d+\]", "")
    claims = answers.select("qid", F.posexplode(F.filter(sentences(stripped), lambda s: F.length(s) > 12)).alias("c", "claim")).withColumn("ct", F.array_distinct(tokens(F.col("claim"))))
    against = claims.join(blocks.select("qid", F.array_distinct(tokens(F.col("text"))).alias("bt")), "qid", "left")
    share = F.when(F.size("ct") == 0, 1.0).otherwise(F.coalesce(F.size(F.array_intersect("ct", "bt")) / F.size("ct"), F.lit(0.0)))
    best = against.groupBy("qid", "c").agg(F.max(share).alias("best"))
    per = best.groupBy("qid").agg(F.count("*").alias("n_claims"), F.count_if(F.col("best") < threshold).alias("n_bad"))
    out = answers.select("qid").join(per, "qid", "left").na.fill(0, ["n_claims", "n_bad"])
    score = F.when(F.col("n_claims") == 0, 1.0).otherwise(F.round(1 - F.col("n_bad") / F.col("n_claims"), 6))
    return out.select("qid", "n_claims", "n_bad", score.alias("score"), F.when(F.col("n_bad") == 0, "pass").otherwise("fail").alias("label"))


def completeness(answers: DataFrame) -> DataFrame:
    """(qid, n_parts, n_missing, score): parts of a question that (qid, query, answer) doesn't speak of."""
    parts = F.filter(F.split(F.regexp_replace("query", r"\band\b|,|;", "\x01"), "\x01"), lambda p: F.length(F.trim(p)) > 8)
    keys = F.transform(parts, lambda p: F.slice(F.filter(tokens(p), lambda t: F.length(t) > 3), 1, 6))
    rows = answers.select("qid", keys.alias("keys"), tokens(F.col("answer")).alias("a"))
    missing = F.size(F.filter("keys", lambda k: (F.size(k) > 0) & (F.size(F.filter(k, lambda t: F.array_contains(F.col("a"), t))) < 0.25 * F.size(k))))
    return rows.select("qid", F.size("keys").alias("n_parts"), missing.alias("n_missing")).withColumn("score", F.round(1 - F.col("n_missing") / F.greatest(F.lit(1), F.col("n_parts")), 6))


def answer_correct(rows: DataFrame, exact: bool = False) -> DataFrame:
    """(qid, correct): whether (answer) has six tenths of the first six longer tokens of (gold), or equals it."""
    if exact:
        return rows.select("qid", (normalized(F.col("answer")) == normalized(F.col("gold"))).cast("double").alias("correct"))
    keys = F.slice(F.filter(F.split(F.lower("gold"), r"[^a-z0-9$%.]+"), lambda t: F.length(t) > 2), 1, 6)
    have = F.size(F.filter("k", lambda t: F.contains(F.lower("answer"), t)))
    return rows.select("qid", "answer", keys.alias("k")).select("qid", F.when(F.size("k") > 0, F.when(have / F.size("k") >= 0.6, 1.0).otherwise(0.0)).otherwise(0.0).alias("correct"))
