"""A corpus pipeline of five stages; part of the subpackage lodestone.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe_codec, decontamination, ngram_join, quality_rules, queries, toxicity
from lodestone.llm.common import durable, shared_folder, tokenizer_path, unused, within


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labelled rows that aren't held out, doesn't call toxic.

    Null and empty texts are scored as texts without terms; repeated rows and null ids like any others.
    """
    scored = toxicity.score(docs, queries.toxicity_model(spark, sf_dir))
    return scored.filter(F.col("predicted") == 0).select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and aren't depleted, without the lines that are frequent in their source.

    Null and empty texts fail the base rules; rows with equal texts of a source fare alike.
    """
    judged = quality_rules.quality(docs).filter("kept").withColumn("text", F.col("cleaned"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        judged = judged.withColumn("n_chars", F.when(F.col("removed_words") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return judged.select(*docs.columns)


def join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near-duplicates, rows without an id last.

    Rows are told apart by id and text, so rows of one id are judged each for itself. Of equal ones, which
    only partial aggregates bring together, one stays; rows without words are no near-duplicates.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("text"))
    at = unused("key", docs)
    keyed = docs.withColumn(at, key)
    classes = durable(ngram_join.similar(keyed.select(at, "text"), at))
    gone = classes.filter(F.col("class_id") != F.col(at)).select(at).distinct()
    stays = classes.filter((F.col("class_id") == F.col(at)) & (F.col("n_links") > 0))
    repeated = within(durable(stays.groupBy(at).agg(F.count("*").alias("n")).filter("n > 1").select(at)), F.lit(48))
    once = keyed.join(gone.unionByName(repeated), at, "left_anti").select(*docs.columns)
    one = keyed.join(repeated, at, "left_semi").groupBy(at).agg(F.min(F.struct(*docs.columns)).alias("row"))
    return once.unionByName(one.select("row.*"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule leaves; few hits in a long text don't matter, null texts stay."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.decontaminate(docs, benchmark).filter(~F.col("contaminated")).select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left; null and empty texts have no tokens, repeated rows stay."""
    coded = bpe_codec.digests(docs.select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", join_stage),
    ("benchmark decontamination", decontamination_stage),
    ("BPE encoding and decoding", encoding_stage),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents; results are kept in the shared folder.

    Texts of any length are taken whole; an empty table passes all stages and stays empty.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
