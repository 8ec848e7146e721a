"""Reranking of (qid, chunk_id, score, rank) by pair features and a logistic model, or by token vectors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import IDENTIFIER, tokens
from lodestone.operators._state import kept, ship, sized
from lodestone.operators.embed import dot, hashed_vectors, maxsim

#: Weights of the default model.
WEIGHTS = {"coverage": 1.1148, "proximity": 0.1382, "phrase": -0.5067, "title": 0.5836, "maxsim": -0.0590, "doc_cosine": 1.2589, "exact_id": 0.6051, "length": -0.7266, "bias": -0.7722}


#: Tokens of a text that late interaction looks at, as a feature and as a reranker of its own.
FEATURE_TOKENS, LATE_TOKENS = 64, 48


def pair_features(hits: DataFrame, queries: DataFrame, chunks: DataFrame, length_b: float = 0.55) -> DataFrame:
    """Features of each (qid, chunk_id, rank): coverage, proximity, phrase, title, maxsim, doc_cosine, exact_id, length.

    Vectors are made for the texts of the hits only, by hashing.
    """
    q = queries.select("qid", "query", tokens(F.col("query")).alias("qt")).withColumn("qs", F.array_distinct("qt"))
    # the hits find their texts, and only those are cut, once for all that reads them
    few, _ = sized(kept(hits.select("qid", "chunk_id", "rank")), 32)
    rows = kept(chunks.select("chunk_id", "text", "title").join(few, "chunk_id").join(q, "qid").withColumn("dt", tokens(F.col("text"))))
    rows = rows.withColumns({"dl": F.size("dt"), "avgdl": F.avg(F.size("dt")).over(Window.partitionBy("qid")), "present": F.filter("qs", lambda t: F.array_contains(F.col("dt"), t))})
    n = F.size("present")
    share = F.when((F.size("qs") > 0) & (F.col("dl") > 0), n / F.size("qs") / (1 - length_b + length_b * F.col("dl") / F.greatest(F.lit(1.0), F.col("avgdl")))).otherwise(0.0)
    first = F.array_min(F.transform("present", lambda t: F.array_position(F.col("dt"), t)))
    last = F.col("dl") + 1 - F.array_min(F.transform("present", lambda t: F.array_position(F.reverse("dt"), t)))
    near = F.when(n >= 2, n / F.greatest(n, last - first + 1)).when(n == 1, 0.3).otherwise(0.0)

    def has_phrase(size: int):
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("qt") - size + 1))
        return (F.size("qt") >= size) & F.exists(starts, lambda i: F.contains(F.lower("text"), F.array_join(F.slice("qt", i, size), " ")))

    best = F.lit(0)
    for size in range(2, 7):
        best = F.when(has_phrase(size), size).otherwise(best)
    head = F.array_distinct(tokens(F.coalesce("title", F.lit(""))))
    titled = F.when(F.size("qs") > 0, F.size(F.array_intersect("qs", head)) / F.size("qs")).otherwise(0.0)
    ids = F.regexp_extract_all("query", F.lit(IDENTIFIER), F.lit(0))
    exact = F.exists(ids, lambda i: F.contains(F.col("text"), i)).cast("double")
    close = maxsim(F.slice("qt", 1, FEATURE_TOKENS), F.slice("dt", 1, FEATURE_TOKENS))
    rows = rows.join(hashed_vectors(q, "qid", "query").withColumnRenamed("vector", "qv"), "qid")
    texts = rows.select("chunk_id", "text").dropDuplicates(["chunk_id"])
    rows = rows.join(hashed_vectors(texts).withColumnRenamed("vector", "dv"), "chunk_id").withColumn("close", close)
    named = {"coverage": share, "proximity": near, "phrase": best / F.greatest(F.lit(2), F.size("qt")), "title": titled, "maxsim": F.col("close"), "doc_cosine": dot(F.col("qv"), F.col("dv")), "exact_id": exact, "length": F.log1p("dl") / 8}
    return rows.select("qid", "chunk_id", "rank", *(F.round(v, 6).alias(k) for k, v in named.items()))


def logistic(features: DataFrame, weights: dict[str, float] | None = None, depth: int = 50) -> DataFrame:
    """(qid, chunk_id, score, rank) by the logistic score of the first ``depth``; the tail keeps its order."""
    weights = weights or WEIGHTS
    missing = weights.keys() - {"bias"} - set(features.columns)
    if missing:
        raise KeyError(f"no feature for the weights of {sorted(missing)}")
    z = F.lit(weights["bias"])
    for name, w in weights.items():
        if name != "bias":
            z = z + w * F.col(name)
    pool = F.col("rank") <= depth
    scored = features.withColumns({"in_pool": pool, "score": F.round(1 / (1 + F.exp(-z)), 6)})
    order = Window.partitionBy("qid").orderBy(F.desc("in_pool"), F.when(F.col("in_pool"), -F.col("score")), F.col("rank"))
    return scored.withColumn("new", F.row_number().over(order)).select("qid", "chunk_id", "score", F.col("new").alias("rank"))


def fit_logistic(pairs: DataFrame, names: list[str], label: str = "label", l2: float = 0.02) -> dict[str, float]:
    """Weights of a class-weighted logistic regression over pair features."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    share = pairs.agg(F.avg(F.col(label).cast("double")).alias("p")).first().p
    weighted = pairs.withColumn("_w", F.when(F.col(label) == 1, 0.5 / max(share, 1e-9)).otherwise(0.5 / max(1 - share, 1e-9)))
    ready = VectorAssembler(inputCols=names, outputCol="_x").transform(weighted.withColumn(label, F.col(label).cast("double")))
    model = LogisticRegression(featuresCol="_x", labelCol=label, weightCol="_w", regParam=l2).fit(ready)
    return dict(zip(names, model.coefficients.toArray().tolist(), strict=True)) | {"bias": float(model.intercept)}


def ceiling(questions: DataFrame, gold: DataFrame, hits: DataFrame, depth: int = 100) -> DataFrame:
    """Share of a question's gold chunks among its candidates: what no reranker can exceed; 1 without gold."""
    near = hits.filter(F.col("rank") <= depth).select("qid", "chunk_id").distinct().withColumn("in", F.lit(1.0))
    found = gold.select("qid", "chunk_id").distinct().join(near, ["qid", "chunk_id"], "left").groupBy("qid").agg(F.avg(F.coalesce("in", F.lit(0.0))).alias("c"))
    return questions.select("qid").join(found, "qid", "left").select("qid", F.round(F.coalesce("c", F.lit(1.0)), 6).alias("ceiling"))


def late_interaction(hits: DataFrame, queries: DataFrame, chunks: DataFrame, depth: int = 50) -> DataFrame:
    """(qid, chunk_id, score, rank) by the mean over the query's tokens of the best cosine with a hit's tokens;
    beyond ``depth`` hits keep their scores and places."""
    pool = F.col("rank") <= depth
    q = queries.select("qid", F.slice(tokens(F.col("query")), 1, LATE_TOKENS).alias("qt"))
    d = chunks.select("chunk_id", F.slice(tokens(F.col("text")), 1, LATE_TOKENS).alias("dt"))
    near = hits.filter(pool).select("qid", "chunk_id").join(q, "qid").join(d, "chunk_id").select("qid", "chunk_id", F.round(maxsim(F.col("qt"), F.col("dt")), 6).alias("late"))
    scored = hits.select("qid", "chunk_id", "score", "rank").join(near, ["qid", "chunk_id"], "left")
    order = Window.partitionBy("qid").orderBy(F.desc(pool), F.when(pool, -F.col("late")), F.col("rank"))
    return scored.withColumn("new", F.row_number().over(order)).select("qid", "chunk_id", F.coalesce("late", "score").alias("score"), F.col("new").alias("rank"))


def reranker(name: str):
    """What reorders hits, by name: a function of hits, queries and chunks."""
    ways = {
        "none": lambda hits, queries, chunks: hits,
        "cross": lambda hits, queries, chunks: logistic(pair_features(hits, queries, chunks)),
        "late": late_interaction,
    }
    if name not in ways:
        raise KeyError(f"no reranker {name!r}; there are {sorted(ways)}")
    return ways[name]


def external(hits: DataFrame, queries: DataFrame, chunks: DataFrame, judge, depth: int = 50) -> DataFrame:
    """Reorders the first ``depth`` hits by ``judge(queries, texts)``, a function of two lists that returns scores.

    It is called with batches, on the workers; a model of one's own goes in here.
    """

    ship()

    @F.pandas_udf("double")
    def scored(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(list(judge(q.tolist(), t.tolist())), dtype="float64")

    pool = F.col("rank") <= depth
    near = hits.filter(pool).join(queries.select("qid", "query"), "qid").join(chunks.select("chunk_id", "text"), "chunk_id").select("qid", "chunk_id", F.round(scored("query", "text"), 6).alias("given"))
    order = Window.partitionBy("qid").orderBy(F.desc(pool), F.when(pool, -F.col("given")), F.col("rank"))
    out = hits.select("qid", "chunk_id", "score", "rank").join(near, ["qid", "chunk_id"], "left")
    return out.withColumn("new", F.row_number().over(order)).select("qid", "chunk_id", F.coalesce("given", "score").alias("score"), F.col("new").alias("rank"))
