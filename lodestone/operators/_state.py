"""State of loops, cut from its lineage."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession | None = None) -> None:
    """Lets Python workers import this package from where the driver has it.

    On a cluster the package is installed on every node and the path changes nothing that matters.
    """
    spark = spark or SparkSession.active()
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of its own for a session on one machine that names none."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
            import tempfile

            named = tempfile.mkdtemp(prefix="lodestone-state-")
        sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a table in the folder of spark.checkpoint.dir, made once and read from there.

    Shuffle files that only its making needs go when it is made.
    """
    spark, unneeded = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = f"{folder(spark)}/state-{uuid.uuid4().hex}", spark.conf.get(unneeded)
    spark.conf.set(unneeded, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(unneeded, before)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, row_bytes: int, most: int = 64_000_000) -> tuple[DataFrame, bool]:
    """``df``, marked for broadcast if its rows at ``row_bytes`` each are within ``most``, and whether they are."""
    from pyspark.sql import functions as F

    small = df.count() * row_bytes <= most
    return (F.broadcast(df) if small else df), small
