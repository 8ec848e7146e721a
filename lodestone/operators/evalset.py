"""Making of evaluation sets: candidate questions from passages, filters, a sample for review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import tokens


def _drawn(seed: int) -> list[Column]:
    """An order that any engine draws alike."""
    return [F.md5(F.encode(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), "UTF-8")), F.col("doc_id")]


def stratified(docs: DataFrame, by: str, share: float = 0.1, least: int = 3, seed: int = 7) -> DataFrame:
    """(doc_id, by): a share of each stratum, ``least`` of it at least."""
    w = Window.partitionBy(by)
    rows = docs.select("doc_id", by).withColumns({"r": F.row_number().over(w.orderBy(*_drawn(seed))), "n": F.count("*").over(w)})
    return rows.filter(F.col("r") <= F.greatest(F.lit(least), F.floor(F.col("n") * share))).select("doc_id", by)


def candidates(docs: DataFrame, least_words: int = 14) -> DataFrame:
    """(doc_id, source, hops, query, answer, evidence) from the first passages of (doc_id, source, text): one of
    each document whose passage is long enough, and one of each source's first two such documents together."""
    passage = F.split("text", "\n")[0]
    n_words = F.size(F.filter(F.split(F.regexp_replace(passage, r"\s+", " "), " "), lambda w: w != ""))
    rows = docs.filter(n_words >= least_words).select("doc_id", "source", passage.alias("passage"))
    said = F.split("passage", r"\.")[0]
    asked = F.concat(F.lit("According to "), "source", F.lit(", what is stated about "), F.substring("passage", 1, 40), F.lit("?"))
    single = rows.select("doc_id", "source", F.lit(1).alias("hops"), asked.alias("query"), said.alias("answer"), F.substring("passage", 1, 60).alias("evidence"))
    numbered = rows.withColumn("rk", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).filter("rk <= 2")
    first = numbered.filter("rk = 1").select("doc_id", "source", "passage")
    second = numbered.filter("rk = 2").select("source", F.col("passage").alias("other"))
    answer = F.concat(said, F.lit("; "), F.split("other", r"\.")[0])
    evidence = F.concat(F.substring("passage", 1, 60), F.lit(" "), F.substring("other", 1, 60))
    pairs = first.join(second, "source").select("doc_id", "source", F.lit(2).alias("hops"), F.concat(F.lit("Combining two records of "), "source", F.lit(", what is known?")).alias("query"), answer.alias("answer"), evidence.alias("evidence"))
    return single.unionByName(pairs)


def judged(found: DataFrame, review: float = 0.15, seed: int = 11) -> DataFrame:
    """(doc_id, hops, verdict, review): candidates that their own question answers, or whose evidence doesn't
    support the answer, are dropped; a share of the others is marked for review."""
    a, q, e = (F.array_distinct(tokens(F.col(c))) for c in ("answer", "query", "evidence"))
    rows = found.select("doc_id", "hops", a.alias("a"), q.alias("q"), e.alias("e"))
    n = F.greatest(F.lit(1), F.size("a"))
    verdict = F.when((F.size("a") - F.size(F.array_intersect("a", "q"))) / n < 0.35, "self-answerable").when(F.size(F.array_intersect("a", "e")) / n < 0.30, "evidence does not entail").otherwise("kept")
    w = Window.partitionBy("hops", "verdict")
    rows = rows.withColumn("verdict", verdict).withColumns({"r": F.row_number().over(w.orderBy(*_drawn(seed))), "n": F.count("*").over(w)})
    chosen = (F.col("verdict") == "kept") & (F.col("r") <= F.greatest(F.lit(1), F.floor(F.col("n") * review)))
    return rows.select("doc_id", "hops", "verdict", chosen.alias("review"))
