"""Approximate nearest neighbours that look at less as the vectors grow, and a neighbour graph made by joins.

Search: about as many cells as the square root of the number of vectors, in two levels so that fitting and placing
take the root of that; what is left of a vector beside its cell's centre is kept as a product code of one byte for a
few dimensions. A query looks into the codes of the cells nearest to it, and only the best of them are scored
exactly. Fitting takes a bounded sample; every vector is in the index.

Graph: all vectors meet, block by block, however many they are, which is exact and moves a vector once a block. ``nn_descent``
is a guess that callers ask for by its name: every vector keeps a bounded pool of neighbours, starts with some drawn by hashes,
and is told of neighbours of its neighbours, in both directions, until few pools change. Rows of a node never outnumber the pools.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators._state import kept, ship, sized
from lodestone.operators.embed import dot
from lodestone.operators.retrieve import _cut, best_of, knn, merged, top, width

#: Vectors that fitting looks at: on the driver for the first level and the codes, and in each cell of it.
SAMPLE = 20_000
#: Dimensions of a byte of a code, and values of the byte.
SUB, WORDS = 2, 256
#: Queries that are sent to all workers at a time, and coded candidates of a query for each hit wanted.
QUERY_BLOCK = 1_000
RESCORED = 10
#: Vectors of a block of the graph at most, of a tile of its scores, and partitions that pairs of blocks are dealt to at most.
BLOCK, TILE, DEALT = 32_768, 1_024, 4_096


@dataclass(frozen=True)
class Codebook:
    """Centres of the cells, sorted by their cell of the first level, and the words of each part of a code."""

    tops: np.ndarray  # (first, d)
    centers: np.ndarray  # (cells, d)
    of_top: np.ndarray  # (cells,) the first-level cell of each
    words: np.ndarray  # (parts, words, SUB)


def _means(x: np.ndarray, k: int, rounds: int, seed: int, spherical: bool) -> np.ndarray:
    """k-means from hashed starts; a cell without vectors keeps its centre."""
    k = max(1, min(k, len(x)))
    centers = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = _nearest(x, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
        if spherical:
            centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
    return centers


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (x @ centers.T - 0.5 * (centers**2).sum(1)).argmax(1)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64) if len(column) else np.zeros((0, 1))


def _share(vectors: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Vectors whose hash falls into the first ``fraction`` of all, the same ones in every run."""
    place = F.pmod(F.xxhash64("chunk_id", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return vectors.filter(place < fraction)


def fit(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, rounds: int = 12) -> Codebook:
    """The cells and codes of (chunk_id, vector), from about ``sample`` of them and as many in each first-level cell.

    The second level is fitted by tasks, a first-level cell each. An empty table has one cell at nought.
    """
    spark, n = vectors.sparkSession, vectors.count()
    cells = cells or max(1, round(math.sqrt(n)))
    first = max(1, round(math.sqrt(cells)))
    second = -(-cells // first)
    x = _matrix(pd.Series([r.vector for r in _share(vectors, sample / max(1, n), 5).select("vector").collect()]))
    if not len(x):
        return Codebook(x[:0] if x.size else np.zeros((1, 1)), np.zeros((1, x.shape[1])), np.zeros(1, np.int64), np.zeros((1, 1, x.shape[1])))
    tops = _means(x, first, rounds, 1, True)
    ship(spark)

    def fitted(frame: pd.DataFrame) -> pd.DataFrame:
        centers = _means(_matrix(frame["vector"]), second, rounds, 2, True)
        return pd.DataFrame({"top": frame["top"].iloc[0], "center": centers.tolist()})

    of = F.pandas_udf(lambda v: pd.Series(_nearest(_matrix(v), tops)) if len(v) else pd.Series([], dtype="int64"), "long")
    placed = _share(vectors, min(1.0, sample * len(tops) / max(1, n)), 6).select("vector", of("vector").alias("top"))
    rows = sorted((r.top, tuple(r.center)) for r in placed.groupBy("top").applyInPandas(fitted, "top long, center array<double>").collect())
    centers, of_top = np.array([c for _, c in rows]), np.array([t for t, _ in rows])
    rest = x - centers[_nearest(x, centers)]
    rest = np.pad(rest, ((0, 0), (0, -rest.shape[1] % SUB)))
    words = [_means(rest[:, i : i + SUB], WORDS, rounds, 3 + i, False) for i in range(0, rest.shape[1], SUB)]
    return Codebook(tops, centers, of_top, np.stack(words))


def _placed(x: np.ndarray, book: Codebook, spill: int) -> np.ndarray:
    """The ``spill`` nearest cells of each vector."""
    return np.argsort(0.5 * (book.centers**2).sum(1) - x @ book.centers.T, axis=1, kind="stable")[:, :spill]


def index(vectors: DataFrame, book: Codebook, spill: int = 1) -> DataFrame:
    """(cell, chunk_id, code) of every vector in its ``spill`` nearest cells; a code is a byte for each SUB dimensions."""
    spark = vectors.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(book)
    kind = vectors.schema["chunk_id"].dataType.simpleString()

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book = shared.value
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch["vector"])
            cell = _placed(x, book, spill)
            for j in range(cell.shape[1]):
                rest = x - book.centers[cell[:, j]]
                rest = np.pad(rest, ((0, 0), (0, -rest.shape[1] % SUB)))
                code = np.stack([_nearest(rest[:, i * SUB : (i + 1) * SUB], w) for i, w in enumerate(book.words)], axis=1).astype(np.uint8)
                yield pd.DataFrame({"cell": cell[:, j], "chunk_id": batch["chunk_id"].to_numpy(), "code": [c.tobytes() for c in code]})

    return vectors.select("chunk_id", "vector").mapInPandas(coded, f"cell long, chunk_id {kind}, code binary")


def tune(vectors: DataFrame, book: Codebook, target: float = 0.97, n: int = 10, asked: int = 100, spill: int = 1) -> int:
    """The fewest cells to look into so that ``target`` of the true neighbours of about ``asked`` vectors lie there."""
    rows = max(1, vectors.count())
    some = _share(vectors, asked / rows, 8).select(F.col("chunk_id").alias("qid"), "vector")
    true = knn(some, vectors, n).join(some.withColumnRenamed("vector", "qv"), "qid").join(vectors, "chunk_id").select("qv", "vector").collect()
    if not true:
        return len(book.centers)
    order = np.argsort(-(np.array([r.qv for r in true]) @ book.centers.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    needed = np.take_along_axis(place, _placed(np.array([r.vector for r in true]), book, spill), axis=1).min(1) + 1
    return int(np.quantile(needed, target, method="higher"))


def search(queries: DataFrame, vectors: DataFrame, coded: DataFrame, book: Codebook, probes: int, n: int = 10, rescored: int = RESCORED) -> tuple[DataFrame, DataFrame]:
    """(qid, chunk_id, score, rank) of the best ``n`` of (qid, vector), and (qid, coded, scored): what each query looked at.

    Scores are exact dot products of the ``rescored`` * ``n`` best by code in the ``probes`` nearest cells. Queries
    are the stated side, sent in blocks; a batch of codes passes on its own best of each query.
    """
    spark, k = queries.sparkSession, n * rescored
    ship(spark)
    total = queries.count()
    blocks = max(1, -(-total // QUERY_BLOCK))
    numbered = kept(queries.select("qid", "vector").withColumn("_b", F.pmod(F.xxhash64("qid"), F.lit(blocks))))
    kinds = queries.schema["qid"].dataType.simpleString(), vectors.schema["chunk_id"].dataType.simpleString()
    found = None
    for block in range(blocks):
        rows = numbered.filter(F.col("_b") == block).collect()
        if not rows:
            continue
        shared = spark.sparkContext.broadcast((book, [r.qid for r in rows], np.array([r.vector for r in rows], np.float64)))

        def best(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            book, qids, q = shared.value
            near = q @ book.centers.T
            asks = np.zeros(near.shape, bool)
            np.put_along_axis(asks, np.argsort(-near, axis=1, kind="stable")[:, :probes], True, axis=1)
            padded = np.pad(q, ((0, 0), (0, -q.shape[1] % SUB)))
            scores = np.stack([padded[:, i * SUB : (i + 1) * SUB] @ w.T for i, w in enumerate(book.words)])  # part, query, word
            for batch in batches:
                if not len(batch):
                    continue
                cell, ids = batch["cell"].to_numpy(), batch["chunk_id"].to_numpy()
                code = np.frombuffer(b"".join(batch["code"]), np.uint8).reshape(len(ids), -1)
                for i in np.flatnonzero(asks[:, np.unique(cell)].any(1)):
                    at = np.flatnonzero(asks[i, cell])
                    by_code = near[i, cell[at]] + sum(scores[p, i, code[at, p]] for p in range(code.shape[1]))
                    keep = np.argpartition(-by_code, min(k, len(at)) - 1)[:k]
                    yield pd.DataFrame({"qid": qids[i], "chunk_id": ids[at[keep]], "by_code": np.round(by_code[keep], 9), "coded": np.where(np.arange(len(keep)) == 0, len(at), 0)})

        part = coded.mapInPandas(best, f"qid {kinds[0]}, chunk_id {kinds[1]}, by_code double, coded long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        none = queries.select("qid", F.lit(None).cast(kinds[1]).alias("chunk_id"), F.lit(0.0).alias("by_code"), F.lit(0).cast("long").alias("coded"))
        found = none.limit(0)
    found = kept(found)
    once = found.groupBy("qid", "chunk_id").agg(F.max("by_code").alias("by_code"))
    candidates = kept(top(once, k, by="by_code").select("qid", "chunk_id"))
    few, _ = sized(candidates, 32)
    pairs = vectors.select("chunk_id", "vector").join(few, "chunk_id").join(queries.select("qid", F.col("vector").alias("qv")), "qid")
    hits = top(pairs.select("qid", "chunk_id", F.round(dot(F.col("qv"), F.col("vector")), 6).alias("score")), n)
    looked = found.groupBy("qid").agg(F.sum("coded").alias("coded")).join(candidates.groupBy("qid").agg(F.count("*").alias("scored")), "qid")
    return hits.select("qid", "chunk_id", "score", "rank"), looked


def nested(queries: DataFrame, vectors: DataFrame, dims: list[int], n: int = 10) -> DataFrame:
    """(dim, qid, chunk_id, score, rank): the best ``n`` by cosine of the first ``dim`` numbers, for each of ``dims``.

    One pass: products and norms of a prefix are those of the shorter one plus what it adds. A prefix of norm 0
    scores 0. Queries are the stated side, sent in blocks; a task scores a few
    of its vectors at a time and passes on its own best of each query and prefix once.
    """
    spark, dims = queries.sparkSession, sorted(dims)
    ship(spark)
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    numbered = kept(queries.select("qid", "vector").withColumn("_b", F.pmod(F.xxhash64("qid"), F.lit(blocks))))
    kinds = queries.schema["qid"].dataType.simpleString(), vectors.schema["chunk_id"].dataType.simpleString()
    found = queries.select(F.lit(0).alias("dim"), "qid", F.lit(None).cast(kinds[1]).alias("chunk_id"), F.lit(0.0).alias("score")).limit(0)
    for block in range(blocks):
        rows = numbered.filter(F.col("_b") == block).collect()
        if not rows:
            continue
        shared = spark.sparkContext.broadcast((np.array([r.qid for r in rows]), np.array([r.vector for r in rows], np.float64)))

        def best(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            qids, q = shared.value
            so_far, step = {}, width(len(qids))
            for batch in batches:
                for start in range(0, len(batch), step):
                    part = batch.iloc[start : start + step]
                    x, ids = _matrix(part["vector"]), part["chunk_id"].to_numpy()
                    products, of_q, of_x, low = np.zeros((len(q), len(x))), np.zeros(len(q)), np.zeros(len(x)), 0
                    for dim in dims:
                        products += q[:, low:dim] @ x[:, low:dim].T
                        of_q += (q[:, low:dim] ** 2).sum(1)
                        of_x += (x[:, low:dim] ** 2).sum(1)
                        norms, low = np.sqrt(of_q)[:, None] * np.sqrt(of_x)[None, :], dim
                        scores = np.round(np.divide(products, norms, out=np.zeros_like(products), where=norms > 0), 6)
                        found = best_of(scores, ids, n)
                        so_far[dim] = merged(so_far[dim], found, n) if dim in so_far else found
            for dim, (row, ids, scores) in so_far.items():
                yield pd.DataFrame({"dim": dim, "qid": qids[row], "chunk_id": ids, "score": scores})

        found = found.unionByName(vectors.select("chunk_id", "vector").mapInPandas(best, f"dim int, qid {kinds[0]}, chunk_id {kinds[1]}, score double"))
    order = Window.partitionBy("dim", "qid").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def ablation(ranked: DataFrame, whole: int) -> DataFrame:
    """(dim, overlap, top1): of ``nested``'s hits the share that the ``whole`` vectors find too, and of first ones."""
    full = ranked.filter(F.col("dim") == whole).select("qid", "chunk_id", F.col("rank").alias("r"))
    both = ranked.join(full, ["qid", "chunk_id"], "left")
    share = F.avg(F.col("r").isNotNull().cast("double"))
    first = F.avg(F.when(F.col("rank") == 1, F.coalesce(F.col("r") == 1, F.lit(False)).cast("double")))
    return both.groupBy("dim").agg(F.round(share, 6).alias("overlap"), F.round(first, 6).alias("top1"))


# --- graph --------------------------------------------------------------------------------------------


def _pooled(edges: DataFrame, pool: int) -> DataFrame:
    """The best ``pool`` rows (node, nb, score, fresh) of each node; a row met twice isn't fresh if either isn't."""
    once = edges.groupBy("node", "nb").agg(F.max("score").alias("score"), F.min("fresh").alias("fresh"))
    return top(once, pool, group="node", tie="nb").drop("rank")


def _bounded(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """At most ``most`` rows of each node, drawn by hashes."""
    order = Window.partitionBy("node").orderBy(F.xxhash64("node", "nb", F.lit(seed)), "nb")
    return rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most).drop("_r")


class _Best:
    """The best ``m`` of each of ``n`` rows, of scores that come tile by tile; what can't be among them isn't looked at again."""

    def __init__(self, n: int, m: int):
        self.m, self.floor, self.found = m, np.full(n, -np.inf), {}

    def add(self, low: int, scores: np.ndarray, ids: np.ndarray) -> None:
        at = slice(low, low + len(scores))
        floor = self.floor[at]
        if np.isinf(floor).any() and scores.shape[1] > self.m:
            floor = np.maximum(floor, np.partition(scores, -self.m, axis=1)[:, -self.m])
        row, col = np.nonzero(scores >= np.maximum(floor - 1e-6, np.finfo(np.float64).min)[:, None])
        new = row, ids[col], np.round(scores[row, col], 6)
        held = self.found[low] = merged(self.found[low], new, self.m) if low in self.found else _cut(*new, self.m)
        full = np.flatnonzero(np.bincount(held[0], minlength=len(scores)) == self.m)
        self.floor[low + full] = held[2][np.searchsorted(held[0], full, side="right") - 1]

    def rows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        return ((low + row, ids, scores) for low, (row, ids, scores) in self.found.items())


def _meet(a: np.ndarray, b: np.ndarray | None, of_a: np.ndarray, of_b: np.ndarray, m: int) -> Iterator[pd.DataFrame]:
    """(node, nb, score): the best ``m`` of ``b`` for each of ``a``, and the other way round; without ``b`` those of ``a`` itself."""
    one = b is None
    b = a if one else b
    no_a, no_b = np.isnan(a).any(1), np.isnan(b).any(1)
    best_a, best_b = _Best(len(a), m), _Best(len(b), m)
    for i in range(0, len(a), TILE):
        for j in range(0, len(b), TILE):
            scores = a[i : i + TILE] @ b[j : j + TILE].T
            scores[no_a[i : i + TILE]] = -np.inf
            scores[:, no_b[j : j + TILE]] = -np.inf
            if one and i == j:
                np.fill_diagonal(scores, -np.inf)
            best_a.add(i, scores, of_b[j : j + TILE])
            if not one:
                best_b.add(j, np.ascontiguousarray(scores.T), of_a[i : i + TILE])
    for best, own in ((best_a, of_a), (best_b, of_b)):
        for row, ids, scores in best.rows():
            yield pd.DataFrame({"node": own[row], "nb": ids, "score": scores})


def graph_by_blocks(vectors: DataFrame, m: int = 16, block: int = BLOCK) -> DataFrame:
    """(node, nb, score, rank): the ``m`` nearest vectors of each by dot product, exactly.

    Hashes deal the vectors into blocks; each two blocks meet in a task, once for both, and give the best of each
    vector there. A task holds two blocks and a tile of scores. Vectors of equal ids are taken once; a table of one
    vector has no rows. Products grow with the square of the vectors.
    """
    ship(vectors.sparkSession)
    nodes = kept(vectors.groupBy(F.col("chunk_id").alias("node")).agg(F.first("vector").alias("vector")))
    n = nodes.count()
    blocks = max(1, min(12, n // 2_048), -(-n // block))
    pairs = blocks * (blocks + 1) // 2
    dealt = nodes.withColumn("b", F.pmod(F.xxhash64("node", F.lit(23)), F.lit(blocks)).cast("int"))
    of_row = dealt.withColumn("c", F.explode(F.sequence("b", F.lit(blocks - 1)))).select((F.col("b") * blocks + F.col("c")).alias("pair"), "node", "vector")
    of_column = dealt.withColumn("r", F.explode(F.sequence(F.lit(0), "b"))).filter("r <> b").select((F.col("r") * blocks + F.col("b")).alias("pair"), "node", "vector")
    kind = nodes.schema["node"].dataType.simpleString()

    def met(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or (not len(right) and left["pair"].iloc[0] % (blocks + 1)):
            return pd.DataFrame({"node": [], "nb": [], "score": []})
        other = np.stack(right["vector"]).astype(np.float64) if len(right) else None
        own = left["node"].to_numpy()
        return pd.concat(_meet(np.stack(left["vector"]).astype(np.float64), other, own, right["node"].to_numpy() if len(right) else own, m))

    sides = [side.repartition(min(pairs, DEALT), "pair").groupBy("pair") for side in (of_row, of_column)]
    found = sides[0].cogroup(sides[1]).applyInPandas(met, f"node {kind}, nb {kind}, score double")
    return top(found, m, group="node", tie="nb").select("node", "nb", "score", "rank")


def neighbours(vectors: DataFrame, m: int = 16) -> DataFrame:
    """(node, nb, score, rank): the ``m`` nearest vectors of each, exactly, however many there are."""
    return graph_by_blocks(vectors, m)


def nn_descent(vectors: DataFrame, m: int = 16, pool: int = 32, rounds: int = 12, settled: float = 0.005) -> DataFrame:
    """(node, nb, score, rank): about the ``m`` nearest vectors of each by dot product.

    A round tells the members of each node's neighbourhood (``pool`` of its pool and ``pool`` that have it in theirs,
    drawn by hashes) of each other, if one of them is new there. It ends when fewer than a ``settled`` share of
    pool entries change. Vectors of equal ids are taken once; a table of one vector has no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    nodes = kept(vectors.groupBy(F.col("chunk_id").alias("node")).agg(F.first("vector").alias("vector")))
    n = nodes.count()
    kind = nodes.schema["node"].dataType.simpleString()

    def mates(seed: int) -> DataFrame:
        """Each node with those of its bucket, about half a pool."""
        buckets = max(1, n // max(1, pool // 2))
        dealt = nodes.select("node", F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(buckets)).alias("node_of"))
        few = _bounded(dealt.select(F.col("node_of").alias("node"), F.col("node").alias("nb")), pool, seed)
        return dealt.join(few.select(F.col("node").alias("node_of"), "nb"), "node_of").filter(F.col("node") != F.col("nb")).select("node", "nb")

    def told(groups: DataFrame) -> DataFrame:
        """Scored pairs among the members (nb, vector, fresh, floor) of each node's neighbourhood, if above a pool's floor."""

        def met(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["nb", "fresh"], ascending=[True, False]).drop_duplicates("nb")
            x, ids, fresh = _matrix(frame["vector"]), frame["nb"].to_numpy(), frame["fresh"].to_numpy(bool)
            scores = np.round(x @ x.T, 6)
            a, b = np.nonzero(fresh[:, None] | fresh[None, :])
            a, b = a[a != b], b[a != b]
            above = scores[a, b] > frame["floor"].to_numpy()[a]
            a, b = a[above], b[above]
            scores = scores[a, b]
            order = np.lexsort((b, -scores, a))
            a, b, scores = a[order], b[order], scores[order]
            place = np.arange(len(a)) - np.searchsorted(a, a)
            keep = place < m
            return pd.DataFrame({"node": ids[a[keep]], "nb": ids[b[keep]], "score": scores[keep]})

        return groups.groupBy("node").applyInPandas(met, f"node {kind}, nb {kind}, score double")

    of = nodes.select(F.col("node").alias("nb"), "vector")
    seeds = mates(1).unionByName(mates(2)).distinct().join(of, "nb").join(nodes.withColumnRenamed("vector", "own"), "node")
    start = seeds.select("node", "nb", F.round(dot(F.col("own"), F.col("vector")), 6).alias("score"), F.lit(True).alias("fresh"))
    state = kept(_pooled(start, pool))
    for step in range(rounds):
        ahead = _bounded(state.select("node", "nb", "fresh"), pool, 10 + step)
        back = _bounded(state.select(F.col("nb").alias("node"), F.col("node").alias("nb"), "fresh"), pool, 40 + step)
        # kept, as Spark takes a union of two windows over node for partitioned by it even where it has dealt them differently
        members = kept(ahead.unionByName(back)).groupBy("node", "nb").agg(F.max("fresh").alias("fresh"))
        full = state.groupBy(F.col("node").alias("nb")).agg(F.when(F.count("*") >= pool, F.min("score")).alias("floor"))
        grown = told(members.join(of.join(full, "nb", "left").fillna(-math.inf, ["floor"]), "nb")).withColumn("fresh", F.lit(True))
        # what is in a pool already comes back as seen; entries that took part are no longer new
        merged = kept(_pooled(state.withColumn("fresh", F.lit(False)).unionByName(grown), pool))
        changed = merged.filter("fresh").count()
        state = merged
        if changed <= settled * n * min(pool, max(1, n - 1)):
            break
    return top(state, m, group="node", tie="nb").select("node", "nb", "score", "rank")
