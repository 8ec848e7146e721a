"""Similarity self-join of documents by the Jaccard index of their word shingles.

1. Every document gets a fingerprint of its shingle set, MinHash values, and band keys made of them.
   Documents of one fingerprint are one node from here on, so exact copies are never paired.
2. Nodes that share a band key are candidates. A pair is looked at in its first common band only.
3. Bayesian pruning: MinHash values of a pair are compared in steps; with a uniform prior the similarity
   after m matches of n is Beta(m + 1, n - m + 1) distributed, and the pair is dropped when the
   probability that it reaches the threshold falls below the tolerance.
4. What is left of a group joins its nodes to clusters (edges to a root, not pairs). Within a cluster the
   Jaccard index of all pairs is computed exactly from the shingle sets, in blocks: counts of links and
   edges to a root come out, never the pairs.

Large band groups and clusters are dealt in blocks to many tasks, every block meeting every other one.
With 26 bands of 4 values a pair at the threshold of 0.8 shares no band with probability 1e-6, the same
order as the tolerance; more similar pairs are missed far more rarely still.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import durable, ship, slices, within
from lodestone.llm.components import components
from lodestone.llm.shingles import mix, shingle_sets

SIZE = 5
THRESHOLD = 0.8
TOLERANCE = 1e-6
BANDS, ROWS = 26, 4
HASHES = BANDS * ROWS
STEPS = (16, 32, 64, HASHES)
#: Nodes of a band group, and nodes and shingles of a cluster, that meet in one block.
GROUP_BLOCK = 1500
CLUSTER_BLOCK = 500
SHINGLE_BLOCK = 400_000
#: Pairs whose band keys or MinHash values are held at a time.
PAIRS = 100_000

_U = np.uint64
_FACTORS = mix(np.arange(1, HASHES + 1, dtype=_U) * _U(0xD1342543DE82EF95)) | _U(1)


def signatures(texts: list[str], size: int = SIZE) -> pd.DataFrame:
    """n_shingles, node, bands and sketch of each text; node is null for a text without words."""
    parts = []
    for start, stop in slices([len(t) for t in texts]):
        hashes, counts = shingle_sets(texts[start:stop], size)
        n = stop - start
        has = np.flatnonzero(counts)
        node = np.zeros(n, np.int64)
        least = np.zeros((n, HASHES), np.uint32)
        if len(has):
            at = np.r_[0, np.cumsum(counts[has])[:-1]]
            node[has] = mix(np.add.reduceat(mix(hashes + _U(1)), at) + counts[has].astype(_U)).view(np.int64)
            for j, factor in enumerate(_FACTORS):
                least[has, j] = np.minimum.reduceat(hashes * factor >> _U(32), at)
        bands = np.zeros((n, BANDS), np.uint32)
        for b in range(BANDS):
            key = np.full(n, b + 1, _U)
            for j in range(ROWS):
                key = mix(key + least[:, b * ROWS + j])
            bands[:, b] = key >> _U(32)
        sketch = least.astype(np.uint8)
        parts.append(pd.DataFrame({"n_shingles": counts, "node": pd.array(node, "Int64"), "bands": [r.tobytes() for r in bands.astype("<u4")], "sketch": [r.tobytes() for r in sketch]}))
        parts[-1].loc[counts == 0, "node"] = pd.NA
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"n_shingles": [], "node": [], "bands": [], "sketch": []})


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For each of STEPS the fewest matches at which a pair is kept."""
    out = []
    for n in STEPS:
        chance, m = 0.0, -1
        while chance < tolerance:  # P(similarity >= t | m of n) = P(Binomial(n + 1, t) <= m)
            m += 1
            chance += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def _settle(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Gives nodes joined by edges (a, b) the least label of either, until nothing changes."""
    while len(a):
        low = np.minimum(label[a], label[b])
        apart = (label[a] != low) | (label[b] != low)
        if not apart.any():
            return
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label[:] = label[label]


def _pairs(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of each group, by about PAIRS at a time."""
    rows = np.arange(int(sizes.sum()))
    left = np.repeat(starts + sizes, sizes) - rows - 1  # partners behind each row
    rows, left = rows[left > 0], left[left > 0]
    ends = np.cumsum(left)
    at = 0
    while at < len(rows):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        n = left[at:stop]
        a = np.repeat(rows[at:stop], n)
        yield a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        at = stop


def prune(batches: Iterator[pd.DataFrame], least: list[int]) -> Iterator[pd.DataFrame]:
    """Edges (u, v) between nodes that the Bayesian test keeps; rows come sorted by group."""

    def groups() -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            frame = pd.concat(held, ignore_index=True)
            open_ = (frame["g"] != frame["g"].iloc[-1]).to_numpy().nonzero()[0]
            done = open_[-1] + 1 if len(open_) else 0
            if done:
                yield frame.iloc[:done]
            held = [frame.iloc[done:]]
        if held:
            yield pd.concat(held, ignore_index=True)

    for frame in groups():
        g = frame["g"].to_numpy()
        starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        node, band, side = frame["node"].to_numpy(), frame["band"].to_numpy(), frame["side"].to_numpy()
        keys = np.frombuffer(b"".join(frame["bands"]), "<u4").reshape(-1, BANDS)
        sketch = np.frombuffer(b"".join(frame["sketch"]), np.uint8).reshape(-1, HASHES)
        label = np.arange(len(frame))
        for a, b in _pairs(starts, np.diff(np.r_[starts, len(g)])):
            # sides 0 and 1 meet each other only; 2 is a block that meets itself
            meet = (side[a] == 2) | (side[a] != side[b])
            a, b = a[meet], b[meet]
            first = (keys[a] == keys[b]).argmax(1) == band[a]
            a, b = a[first], b[first]
            done, matches = 0, np.zeros(len(a), np.int64)
            for step, fewest in zip(STEPS, least, strict=True):
                matches += (sketch[a, done:step] == sketch[b, done:step]).sum(1)
                kept = matches >= fewest
                a, b, matches, done = a[kept], b[kept], matches[kept], step
            _settle(label, a, b)
        moved = np.flatnonzero(label != np.arange(len(label)))
        yield pd.DataFrame({"u": node[moved], "v": node[label[moved]]})


def exact_links(sets: list[np.ndarray], weights: np.ndarray, side: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Summed weights of the sets that each one is linked to in this block, and labels of joined sets."""
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    owner = np.repeat(np.arange(n), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    column = (np.cumsum(shared) - 1)[column] * shared[column] - ~shared[column]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((n, n), np.float32)
    width = 2048
    for low in range(0, int(shared.sum()), width):
        of = slice(*np.searchsorted(column, (low, low + width)))
        has = np.zeros((n, width), np.float32)
        has[owner[of], column[of] - low] = 1
        common += has @ has.T
    # whole numbers up to here; in single precision the threshold itself would be blurred
    linked = common.astype(np.float64) * (1 + threshold) >= threshold * (sizes[:, None] + sizes[None, :]) - 1e-6
    np.fill_diagonal(linked, False)
    linked &= (side[:, None] == 2) | (side[:, None] != side[None, :])
    label = np.arange(n)
    _settle(label, *np.nonzero(np.triu(linked)))
    return linked @ weights, label


def verify(batches: Iterator[pd.DataFrame], size: int, threshold: float) -> Iterator[pd.DataFrame]:
    """Rows (node, n, root): links found and the root joined, for the blocks of clusters, sorted by block."""
    held: list[tuple] = []
    block = None

    def judged() -> pd.DataFrame:
        hashes, counts = shingle_sets([r[3] for r in held], size)
        bounds = np.cumsum(counts)[:-1]
        sets = np.split(hashes, bounds)
        # a row whose text is another one under a repeated id is not this node's text
        mine = [i for i, (r, s) in enumerate(zip(held, sets, strict=True)) if len(s) and int(mix(np.array([mix(s + _U(1)).sum() + _U(len(s))], _U)).view(np.int64)[0]) == r[0]]
        mine = list({held[i][0]: i for i in mine}.values())
        node = np.array([held[i][0] for i in mine], np.int64)
        if len(mine) < 2:
            return pd.DataFrame({"node": node[:0], "n": node[:0], "root": node[:0]})
        links, label = exact_links([sets[i] for i in mine], np.array([held[i][1] for i in mine], np.int64), np.array([held[i][2] for i in mine]), threshold)
        out = pd.DataFrame({"node": node, "n": links, "root": node[label]})
        return out[(out["n"] > 0)]

    for batch in batches:
        for g, *row in zip(batch["g"], batch["node"], batch["w"], batch["side"], batch["text"], strict=True):
            if g != block:
                if held:
                    yield judged()
                held, block = [], g
            held.append(tuple(row))
    if held:
        yield judged()


def _blocked(df: DataFrame, node: str, blocks: str, key: list[str]) -> DataFrame:
    """Each row once for every other block its own one meets: g, the meeting's number, and its side in it."""
    own = F.pmod(F.xxhash64(F.lit(3), F.col(node)), F.col(blocks))
    met = df.withColumn("_own", own).withColumn("_other", F.explode(F.expr(f"sequence(0L, cast({blocks} AS BIGINT) - 1)")))
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    side = F.when(low == high, 2).when(F.col("_own") == low, 0).otherwise(1)
    return met.withColumns({"g": F.xxhash64(*key, low, high), "side": side.cast("int")}).drop("_own", "_other")


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row a document: ``key``, class_id and n_links.

    ``class_id`` is the least key of the documents that a document is joined with over any number of
    links, itself included; ``n_links`` is how many documents it is linked to directly, copies included.
    A pair exactly at ``threshold`` is linked. Texts of fewer than ``size`` words are one shingle, very long
    ones are compared whole. Texts that are null or have no words, and rows without a key, are linked to
    nothing and are their own class (null without a key). Repeated rows are documents of their own. An empty
    table stays empty; other columns don't matter.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    @F.pandas_udf("n_shingles long, node long, bands binary, sketch binary")
    def signed(texts: pd.Series) -> pd.DataFrame:
        return signatures(texts.tolist(), size)

    signs = durable(rows.withColumn("_s", signed("text")).select("key", F.xxhash64("text").alias("t"), "_s.*"))
    able = signs.filter(F.col("key").isNotNull() & F.col("node").isNotNull())
    nodes = able.groupBy("node").agg(F.min(F.struct("key", "t")).alias("of"), F.count("*").alias("w"), F.max("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = durable(nodes.select("node", F.col("of.key").alias("rep"), F.col("of.t").alias("t"), "w", "n_shingles", "bands", "sketch"))

    # numbers of the bands with their keys, read from the packed form
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(b.alias("band"), F.substring(F.col("bands"), b * 4 + 1, F.lit(4)).alias("k")))
    banded = nodes.select("node", F.explode(keys).alias("b")).select("node", F.col("b.band").alias("band"), F.hex("b.k").alias("k"))
    # kept apart from the join that follows, so that a hot band key's nodes need not meet in one task
    groups = within(durable(banded.groupBy("band", "k").agg(F.count("*").alias("size")).filter(F.col("size") > 1)), F.lit(32))
    candidates = banded.join(groups, ["band", "k"]).withColumn("blocks", F.ceil(F.col("size") / GROUP_BLOCK))
    dealt = _blocked(candidates, "node", "blocks", ["band", "k"]).select("g", "node", "band", "side")
    dealt = dealt.join(nodes.select("node", "bands", "sketch"), "node")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fewest = least_matches(threshold, tolerance)
    edges = dealt.repartition(parts, "g").sortWithinPartitions("g").mapInPandas(lambda it: prune(it, fewest), "u long, v long")
    clusters = components(edges)

    sized = durable(clusters.join(nodes.select("node", "rep", "t", "w", "n_shingles"), "node"))
    totals = sized.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / CLUSTER_BLOCK), F.ceil(F.sum("n_shingles") / SHINGLE_BLOCK)).alias("blocks"))
    totals = within(durable(totals), F.lit(32))
    members = _blocked(sized.join(totals, "root"), "node", "blocks", ["root"]).select("g", "node", "w", "side", "rep", "t")
    # the texts of representatives only, one for each, however often its row is repeated
    chosen = within(sized.select(F.col("rep").alias("key"), "t").distinct(), F.coalesce(F.octet_length(F.col("key").cast("string")), F.lit(0)) + 32)
    of_rep = rows.withColumn("t", F.xxhash64("text")).join(chosen, ["key", "t"], "left_semi").groupBy(F.col("key").alias("rep"), "t").agg(F.first("text").alias("text"))
    texts = members.join(of_rep, ["rep", "t"]).select("g", "node", "w", "side", "text")
    found = durable(texts.repartition(parts, "g").sortWithinPartitions("g").mapInPandas(lambda it: verify(it, size, threshold), "node long, n long, root long"))

    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    joined = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    placed = nodes.select("node", "rep", "w").join(links, "node", "left").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = placed.groupBy("root").agg(F.min("rep").alias("class_id"))
    of_node = placed.join(classes, "root").select("node", "class_id", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    known = signs.select("key", F.when(F.col("key").isNotNull(), F.col("node")).alias("node"))
    out = known.join(of_node, "node", "left")
    return out.select(F.col("key").alias(key), F.coalesce("class_id", "key").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


#: The same in DuckDB, by comparing the shingle sets of all documents that share a shingle.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(array_to_string(list_slice(w, i, i + k - 1), ' ')) AS h
  FROM (SELECT doc_id, w, least(5, len(w)) AS k, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), l AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 9 * c >= 4 * (na.n + nb.n)
), r AS (
  SELECT doc_id AS node, doc_id AS reached FROM documents
  UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reached
)
SELECT d.doc_id, (SELECT min(reached) FROM r WHERE r.node = d.doc_id) AS class_id,
       (SELECT count(*) FROM l WHERE l.a = d.doc_id) AS n_links
FROM d
"""
