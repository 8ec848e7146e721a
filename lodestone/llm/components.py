"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import durable, within

#: Neighbours beyond which a node's edges are not brought together in one task.
HOT = 500
#: Parts that the edges of hot nodes are dealt to if there are too many such nodes to send them everywhere.
SALTS = 64


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with ``m``, the least v of their u.

    Minima come from partial ones. Those of nodes with many edges are few; they are sent to where the edges
    are, or, if their rows are too many for that, met by them in parts. So no task gets all edges of a node.
    """
    least = durable(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
    hot = least.filter(F.col("n") > HOT).select("u", "m")
    sent = within(hot, F.lit(32))
    if hot.isEmpty():
        return edges.join(least.select("u", "m"), "u")
    cold = edges.join(sent.select("u"), "u", "left_anti").join(least.filter(F.col("n") <= HOT).select("u", "m"), "u")
    parts = sent.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    parted = edges.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(F.broadcast(parts) if sent is not hot else parts, ["u", "part"])
    return cold.select("u", "v", "m").unionByName(parted.select("u", "v", "m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = _with_least(edges.filter(F.col("u") > F.col("v")))
    moved = down.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(down.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the edges (u, v): the least node of its component.

    Large-star and small-star steps alternate until a round changes nothing; each round is written to the
    checkpoint folder. Loops and repeated edges are allowed; no edges give no rows.
    """
    current = durable(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter(F.col("u") != F.col("v")).distinct())
    seen = None
    for _ in range(rounds):
        state = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen or not state.n:
            break
        seen = state
        current = durable(_small_star(durable(_large_star(current).filter(F.col("u") != F.col("v")).distinct())))
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    roots = current.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
