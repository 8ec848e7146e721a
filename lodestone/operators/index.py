"""Life cycle of a versioned index, as set algebra over immutable tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["chunk_id", "index_version"]


def upsert(index: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace those of their key and come alive again; all others stay."""
    fresh = new.withColumn("tombstoned", F.lit(False)).select(*index.columns)
    return index.join(fresh.select(*KEY), KEY, "left_anti").select(*index.columns).unionByName(fresh)


def tombstone(index: DataFrame, ids: DataFrame, version: str) -> DataFrame:
    """Soft deletion of (chunk_id) in one version."""
    marked = ids.select("chunk_id").distinct().withColumn("_gone", F.lit(True))
    dead = F.col("tombstoned") | (F.coalesce("_gone", F.lit(False)) & (F.col("index_version") == version))
    return index.join(marked, "chunk_id", "left").withColumn("tombstoned", dead).select(*index.columns)


def compact(index: DataFrame, version: str) -> DataFrame:
    """The index without the version's dead rows."""
    return index.filter(~(F.col("tombstoned") & (F.col("index_version") == version)))


def live(index: DataFrame, version: str) -> DataFrame:
    return index.filter((F.col("index_version") == version) & ~F.col("tombstoned"))


def resolve(aliases: DataFrame, name: str) -> DataFrame:
    """(index_version) an alias points to; an unknown alias is its own version."""
    found = aliases.filter(F.col("alias") == name).agg(F.max("index_version").alias("v"))
    return found.select(F.coalesce("v", F.lit(name)).alias("index_version"))


def set_alias(aliases: DataFrame, name: str, version: str) -> DataFrame:
    """The alias table with one pointer swapped."""
    row = aliases.sparkSession.range(1).select(F.lit(name).alias("alias"), F.lit(version).alias("index_version"))
    return aliases.filter(F.col("alias") != name).select("alias", "index_version").unionByName(row)


def index_stats(index: DataFrame) -> DataFrame:
    return index.groupBy("index_version").agg(F.count("*").alias("n_rows"), F.count_if("tombstoned").alias("n_dead"), F.countDistinct("doc_id").alias("n_docs"), F.countDistinct("embedder_tag").alias("n_tags"))


def mixed_versions(index: DataFrame, version: str) -> DataFrame:
    """Live rows by encoder; the version is sound if there is one encoder at most."""
    tags = live(index, version).groupBy("embedder_tag").agg(F.count("*").alias("n"))
    return tags.withColumn("ok", F.count("*").over(Window.partitionBy()) <= 1)


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(chunk_id, state): stable, new or orphaned, by the ids of two versions."""
    both = old.select("chunk_id", F.lit(1).alias("o"), F.lit(0).alias("n")).unionByName(new.select("chunk_id", F.lit(0).alias("o"), F.lit(1).alias("n"))).groupBy("chunk_id").agg(F.max("o").alias("o"), F.max("n").alias("n"))
    return both.select("chunk_id", F.when((F.col("o") == 1) & (F.col("n") == 1), "stable").when(F.col("n") == 1, "new").otherwise("orphaned").alias("state"))


def duplicates(chunks: DataFrame, tokens_of) -> DataFrame:
    """Groups of chunks with one set of tokens: (n, first_id)."""
    return chunks.select("chunk_id", F.array_join(F.array_sort(F.array_distinct(tokens_of)), " ").alias("set")).groupBy(F.sha1(F.encode("set", "UTF-8")).alias("set")).agg(F.count("*").alias("n"), F.min("chunk_id").alias("first_id")).filter(F.col("n") > 1).select("n", "first_id")


def create_version(versions: DataFrame, name: str, tag: str, chunker: str = "", note: str = "", created_at: str = "") -> DataFrame:
    """The table of versions (index_version, embedder_tag, chunker, created_at, note) with one row put in or replaced."""
    row = versions.sparkSession.range(1).select(F.lit(name).alias("index_version"), F.lit(tag).alias("embedder_tag"), F.lit(chunker).alias("chunker"), F.lit(created_at).alias("created_at"), F.lit(note).alias("note"))
    return versions.filter(F.col("index_version") != name).select(*row.columns).unionByName(row)


def get(index: DataFrame, chunk_id, version: str) -> DataFrame:
    """The row of a chunk in a version, dead or alive."""
    return index.filter((F.col("chunk_id") == chunk_id) & (F.col("index_version") == version))


def document_changes(old: DataFrame, new: DataFrame, metadata: list[str]) -> DataFrame:
    """(doc_id, state) of two states of documents (doc_id, text, metadata): a document whose body is the same needs no
    new vectors, whatever else of it changed."""
    def signed(docs: DataFrame, side: str) -> DataFrame:
        rest = F.sha1(F.encode(F.to_json(F.struct(*metadata)), "UTF-8"))
        return docs.select("doc_id", F.substring(F.sha1(F.encode("text", "UTF-8")), 1, 12).alias(f"{side}_body"), rest.alias(f"{side}_meta"))

    both = signed(old, "o").join(signed(new, "n"), "doc_id", "full")
    state = F.when(F.col("o_meta").isNull(), "new").when(F.col("n_meta").isNull(), "gone").when(~F.col("o_body").eqNullSafe(F.col("n_body")), "body").when(F.col("o_meta") != F.col("n_meta"), "metadata only").otherwise("same")
    return both.select("doc_id", state.alias("state"))


def swap_if_better(aliases: DataFrame, name: str, scores: DataFrame) -> DataFrame:
    """(alias, index_version, delta) after a shadow evaluation (index_version, score) of the live version and another
    one: the alias moves if the other is no worse."""
    live_ = aliases.filter(F.col("alias") == name).select("index_version", F.lit(True).alias("live"))
    rows = scores.join(F.broadcast(live_), "index_version", "left").withColumn("live", F.coalesce("live", F.lit(False)))
    both = rows.agg(F.max(F.when(F.col("live"), F.col("score"))).alias("a"), F.max(F.when(~F.col("live"), F.col("score"))).alias("b"), F.max(F.when(F.col("live"), F.col("index_version"))).alias("va"), F.max(F.when(~F.col("live"), F.col("index_version"))).alias("vb"))
    delta = F.col("b") - F.col("a")
    return both.select(F.lit(name).alias("alias"), F.when(delta >= 0, F.col("vb")).otherwise(F.col("va")).alias("index_version"), F.round(delta, 6).alias("delta"))


def validation(docs: DataFrame, index: DataFrame, version: str, tokens_of, required: list[str], recall: DataFrame, least_recall: float = 0.80) -> DataFrame:
    """(check_name, measured, verdict) before a release: documents that no live chunk has, groups of chunks of equal
    tokens, chunks without metadata, encoders mixed, and a probe of recall (recall)."""
    rows = live(index, version)
    covered = docs.join(rows.select("doc_id").distinct(), "doc_id", "left_anti").agg(F.count("*").cast("double").alias("m"))
    copies = duplicates(rows, tokens_of).agg(F.count("*").cast("double").alias("m")).crossJoin(rows.agg(F.count("*").alias("n")))
    empty = F.lit(False)
    for name in required:
        empty = empty | F.col(name).isNull() | (F.col(name) == "")
    lacking = rows.agg(F.count_if(empty).cast("double").alias("m"))
    tags = rows.agg(F.countDistinct("embedder_tag").cast("double").alias("m"))

    def check(name: str, of: DataFrame, good, bad: str) -> DataFrame:
        return of.select(F.lit(name).alias("check_name"), F.round("m", 6).alias("measured"), F.when(good, "PASS").otherwise(bad).alias("verdict"))

    parts = [
        check("coverage", covered, F.col("m") == 0, "FAIL"),
        check("duplicates", copies, F.col("m") < 0.02 * F.col("n"), "WARN"),
        check("metadata", lacking, F.col("m") == 0, "FAIL"),
        check("encoders", tags, F.col("m") <= 1, "FAIL"),
        check("recall", recall.select(F.col("recall").alias("m")), F.col("m") > least_recall, "WARN"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def case_groups(docs: DataFrame, key: str) -> DataFrame:
    """Documents merged by a key: earliest date, number, and the groups that may read every part.

    A group that all of a case's documents name is found by counting, so a large case meets in no one row.
    """
    heads = docs.groupBy(key).agg(F.count("*").alias("n"), F.min("published").alias("published"))
    named = docs.select(key, "doc_id", F.explode(F.array_distinct("acl")).alias("g")).groupBy(key, "g").agg(F.count("*").alias("of"))
    everyone = named.join(heads.select(key, "n"), key).filter(F.col("of") == F.col("n")).groupBy(key).agg(F.array_sort(F.collect_set("g")).alias("acl"))
    return heads.join(everyone, key, "left").select(key, "n", "published", F.coalesce("acl", F.array().cast("array<string>")).alias("acl"))


def case_passages(passages: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """(key, ordinal, doc_id, text): the passages (doc_id, passage, text) of a case's documents as those of one
    document, in the order of their ids. A case's passages stay rows; only numbers are handed on."""
    of = docs.select("doc_id", key)
    counts = passages.groupBy("doc_id").agg(F.count("*").alias("n")).join(of, "doc_id")
    before = F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return passages.join(counts.select("doc_id", key, before.alias("before")), "doc_id").select(key, (F.col("before") + F.col("passage")).alias("ordinal"), "doc_id", "text")
