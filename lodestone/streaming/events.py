"""Windows over an event stream, and the state of a prompt cache."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unit_digest(events: DataFrame, window: str = "7 days", late: str = "1 day") -> DataFrame:
    """Per window and unit of (ts, unit, kind): graded, cleared and hints; events later than ``late`` are dropped."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", window), "unit")
        .agg(F.count_if(F.col("kind").isin("fail", "pass")).alias("graded"), F.count_if(F.col("kind") == "pass").alias("cleared"), F.count_if(F.col("kind") == "hint").alias("hints"))
        .select(F.col("window.start").alias("start"), "unit", "graded", "cleared", "hints")
    )


def prompt_cache_stream(requests: DataFrame, ttl: int) -> DataFrame:
    """(seq, prefix, hit) of a stream (seq, prefix): whether a prefix came within ``ttl`` requests before."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("seq")
        hits = []
        for seq in rows["seq"]:
            hits.append(last is not None and seq - last <= ttl)
            last = int(seq)
        state.update((last,))
        yield pd.DataFrame({"seq": rows["seq"], "prefix": rows["prefix"], "hit": hits})

    return requests.groupBy("prefix").applyInPandasWithState(step, "seq long, prefix string, hit boolean", "last long", "append", "NoTimeout")
