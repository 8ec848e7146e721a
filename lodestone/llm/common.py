"""What several operators of this subpackage share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that Python code holds in work arrays at a time.
SLICE_CHARS = 500_000
#: Rows that a Python worker receives at a time, if the session has not chosen otherwise. Whole texts of
#: Spark's default of 10,000 rows would take a worker hundreds of MB.
BATCH_ROWS = 1_000


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, and bounds their batches.

    On a cluster the package is installed on every node and the path changes nothing that matters.
    """
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(batch) == "10000":
        spark.conf.set(batch, str(BATCH_ROWS))
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file; the default of the operators' path parameters."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only a session without one that runs on one machine (tests) gets a folder of its own; on a cluster a
    folder of one machine would lose what other machines need, so that is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        configured = sc.getConf().get("spark.checkpoint.dir", None)
        if not configured:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
            import tempfile

            configured = tempfile.mkdtemp(prefix="lodestone-checkpoints-")
        sc.setCheckpointDir(configured)
    return sc._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, made once and read from there.

    Shuffle files that only its making needs go when it is made, not when the driver collects its garbage.
    """
    spark, unneeded = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}", spark.conf.get(unneeded)
    spark.conf.set(unneeded, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(unneeded, before)
    return spark.read.schema(df.schema).parquet(path)


def slices(lengths: list[int], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of runs of consecutive texts that hold at most ``most`` characters, or one text."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def unused(name: str, df: DataFrame) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    return next(n for i in range(len(taken) + 1) if (n := f"_{name}{'_' * i}").lower() not in taken)


def crc_mod(column: str, modulus: int):
    """crc32 of the decimal form of a column, modulo ``modulus``; null for null."""
    return F.crc32(F.col(column).cast("string")) % modulus


def bounded_sample(df: DataFrame, key: str, strata: list[str], most: int) -> DataFrame:
    """About ``most`` keys of each stratum (all, if it has fewer rows), the same ones in every run.

    Rows are counted by stratum, from partial counts, and a row is taken if the hash of its key falls into
    the first ``most / count`` of all hashes. So rows are judged where they are read, however hot a stratum
    is; a key that many rows share is returned once.
    """
    counts = df.groupBy(*strata).agg(F.count("*").alias("_count"))
    counts = within(durable(counts), sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in strata), F.lit(24)))
    place = F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(1 << 40)) / float(1 << 40)
    taken = df.select(key, *strata, place.alias("_place")).join(counts, strata).filter(F.col("_place") * F.col("_count") < most)
    return taken.select(key, *strata).distinct()


def within(df: DataFrame, row_bytes, most: int = 32_000_000) -> DataFrame:
    """``df`` marked for broadcast if its rows' bytes, summed up first, are within ``most``."""
    total = df.agg(F.coalesce(F.sum(row_bytes), F.lit(0)).alias("n")).first().n
    return F.broadcast(df) if total <= most else df
