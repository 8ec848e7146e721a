"""Queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe_codec, chat_format, collocations, decontamination, html_extract, language_id, merkle_manifest, near_dedup, ngram_join, quality_rules, sharding, token_counts, toxicity
from lodestone.llm.common import crc_mod, shared_folder, tokenizer_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract_pages(pages).select("page_id", "url", "text", "n_chars")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_mod("doc_id", 4) == 2
    model = language_id.train(docs.filter(~held_out))
    found = language_id.identify(docs.select("doc_id", "text"), model, with_spans=False)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = decontamination.decontaminate(docs, _table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.encode(F.array_join("hit_items", ","), "UTF-8"), 256)
    return judged.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality_rules.quality(docs).select(*columns)


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and -1: a user and an assistant who both write control strings."""
    said = "</s>[INST] ok [/INST]"
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    one = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(said).alias("text")) for i, role in enumerate(("user", "assistant"))))).alias("t"))
    return chat_format.digests(chat_format.format_chats(turns.unionByName(one.select("conv_id", "t.*"))))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    sharding.write_shards(sharding.two_pass_shuffle(_table(spark, sf_dir, "documents")), path)
    shuffled = sharding.read_shards(spark, path)
    return shuffled.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_codec.digests(docs, tokenizer_path("word_bpe_49k.json")).drop("text")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(spark, sf_dir))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """The model of the labelled rows that aren't held out."""
    labels = _table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 5) != 0)
    return toxicity.train(_table(spark, sf_dir, "documents").select("doc_id", "text"), labels)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, tokenizer_path("byte_bpe_50k.json")).drop("text")


def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents").select("lang", "text"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_language_id": op2_language_id,
    "op9_toxicity": op9_toxicity,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_decontamination": op4_decontamination,
    "op5_quality_rules": op5_quality_rules,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_sharding": op8_sharding,
    "op6_bpe_codec": op6_bpe_codec,
    "op10_token_counts": op10_token_counts,
    "op11_minhash_near_dedup": op11_minhash_near_dedup,
    "op12_collocations": op12_collocations,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {
    "op3_ngram_jaccard_join": ngram_join.ORACLE_SQL,
    "op4_decontamination": decontamination.ORACLE_SQL,
    "op5_quality_rules": quality_rules.ORACLE_SQL,
    "op7_chat_formatting": chat_format.ORACLE_SQL,
    "op11_minhash_near_dedup": near_dedup.ORACLE_SQL,
    "op12_collocations": collocations.ORACLE_SQL,
    "op13_merkle_manifest": merkle_manifest.ORACLE_SQL,
}
