"""Sharding by a two-pass external shuffle, with DataFrame functions only.

Pass one scatters whole records uniformly into memory-sized buckets by a seeded hash. Pass two brings
each bucket's records together, one bucket a task, puts them into a fixed order, permutes them with a
seeded Fisher-Yates shuffle, and writes them. The buckets' permutations in a row are one random order of
all records; it is cut into shards whose counts differ by one row at most, so a bucket's records are
written as a piece of one shard, or of two where a cut falls into it.

Everything depends on hashes and seeds alone: a bucket that a lost executor held is made again as it was.
Records that are repeated in full are told apart by a copy number, so that they spread over buckets too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import durable, within

#: Bytes of records that a bucket holds on average; a task holds one bucket at a time.
BUCKET_BYTES = 8_000_000
#: Copies of a repeated record that are made in one place, and buckets whose offsets are summed together.
TOGETHER = 1_000
ADDED = ("size", "text_crc32", "law", "shard", "slot")


def record_size(text: Column) -> Column:
    """UTF-8 bytes of a text, none for null, plus 1."""
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")


def _numbered(sized: DataFrame, key: str) -> DataFrame:
    """(record, copy): rows as structs; those repeated in full are numbered from 0.

    Repeated rows are few, or one of them is hot: they are counted from partial counts and spelled out
    again by TOGETHER from each place.
    """
    record = F.struct(*(F.col(f"`{c}`") for c in sized.columns))
    marks = [F.col(f"`{key}`").alias("_k"), F.col("text_crc32").alias("_c"), F.col("size").alias("_z")]
    repeated = durable(sized.groupBy(*marks).agg(F.count("*").alias("_n")).filter("_n > 1").select("_k", "_c", "_z"))
    if repeated.isEmpty():
        return sized.select(record.alias("r"), F.lit(0).cast("long").alias("copy"))
    repeated = within(repeated, F.coalesce(F.octet_length(F.col("_k").cast("string")), F.lit(0)) + 24)
    same = sized[f"`{key}`"].eqNullSafe(repeated["_k"]) & (sized["text_crc32"] == repeated["_c"]) & (sized["size"] == repeated["_z"])
    once = sized.join(repeated, same, "left_anti").select(record.alias("r"), F.lit(0).cast("long").alias("copy"))
    counted = sized.join(repeated, same, "left_semi").groupBy(record.alias("r")).agg(F.count("*").alias("n"))
    parts = counted.select("r", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / TOGETHER))).alias("part"))
    spread = parts.repartition(F.xxhash64("r"), "part")
    copies = F.sequence(F.col("part") * TOGETHER, F.least(F.col("n"), (F.col("part") + 1) * TOGETHER) - 1)
    return once.unionByName(spread.select("r", F.explode(copies).alias("copy")))


def two_pass_shuffle(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 8, seed: int = 20240501, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``df`` in a random order: size, text_crc32, law, shard and slot beside its own columns.

    Under the law ``rows`` shard counts differ by one at most and slots of a shard run from 0 without a
    gap. Null keys and texts are hashed like values; equal texts and hot keys do not share a bucket, and
    rows repeated in full stay separate rows and are spread as well. A very long text makes its own bucket
    as large as it is. An empty table stays empty. Existing columns of these names are replaced.
    """
    own = [c for c in df.columns if c not in ADDED]
    whole = F.coalesce(F.col(text), F.lit(""))
    sized = df.select(*(df[f"`{c}`"] for c in own), record_size(F.col(text)).alias("size"), F.crc32(whole).alias("text_crc32"))
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    buckets = max(1, math.ceil(total.bytes / bucket_bytes))
    place = F.xxhash64(F.lit(seed), F.col("r")[key], F.col("r")["text_crc32"], F.col("r")["size"], F.col("copy"))
    scattered = _numbered(sized, key).withColumns({"order": place, "bucket": F.pmod(place, F.lit(buckets)).cast("int")})

    # offsets of the buckets, summed in groups: no window holds more than TOGETHER of them, or one row a group
    counts = durable(scattered.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("of", F.floor(F.col("bucket") / TOGETHER)))
    behind = Window.unboundedPreceding
    groups = counts.groupBy("of").agg(F.sum("n").alias("n"))
    groups = groups.select("of", F.coalesce(F.sum("n").over(Window.orderBy("of").rowsBetween(behind, -1)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("of").orderBy("bucket").rowsBetween(behind, -1)), F.lit(0))
    offsets = counts.withColumn("inside", inside).join(F.broadcast(groups), "of").select("bucket", (F.col("base") + F.col("inside")).alias("before"))

    gathered = (
        scattered.repartitionById(buckets, "bucket")
        .groupBy("bucket")
        .agg(F.sort_array(F.collect_list(F.struct("order", "copy", "r"))).alias("records"))
        .sortWithinPartitions("bucket")  # a seeded shuffle draws row by row, so rows need a fixed order
        .withColumn("records", F.shuffle("records", F.lit(seed)))
    )
    placed = gathered.join(within(offsets, F.lit(16)), "bucket")
    dealt = placed.select("before", F.posexplode("records").alias("at", "x")).select((F.col("before") + F.col("at")).alias("place"), F.col("x.r").alias("r"))
    shard = F.expr(f"((place + 1) * {shards} + {max(total.n, 1)} - 1) div {max(total.n, 1)} - 1")
    start = F.expr(f"shard * {total.n} div {shards}")
    dealt = dealt.withColumn("shard", shard).withColumn("slot", F.col("place") - start)
    columns = [F.col("r")[c].alias(c) for c in [*own, "size", "text_crc32"]]
    return dealt.select(*columns, F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Writes what ``two_pass_shuffle`` returns as Parquet, one folder a shard, from the tasks that hold the buckets.

    Rows of a file are in slot order, and the files of a shard hold successive slots in the order of their
    names. Nothing that is there already is overwritten.
    """
    shuffled.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def read_shards(spark, path: str, shards: int | None = None) -> DataFrame:
    """The written shards; ``shards`` reads the first ones alone."""
    rows = spark.read.parquet(path)
    return rows if shards is None else rows.filter(F.col("shard") < shards)
