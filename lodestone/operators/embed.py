"""Encoders: signed hashing of character trigrams, latent spaces of tf-idf; inverted lists and graphs for search."""

from __future__ import annotations

import functools
import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import tokens
from lodestone.operators._state import kept, ship, sized
from lodestone.operators.retrieve import nearest, top

_WHITE = re.compile(r"[ \t\n\x0b\f\r]+")


def hashed(texts: DataFrame, dim: int = 192, key: str = "chunk_id") -> DataFrame:
    """(key, bucket, value): the non-zero parts of unit vectors of hashed character trigrams of ``text``."""
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower("text"), r"\s+", " "), F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))
    counted = texts.select(key, F.explode(grams).alias("g")).groupBy(key, "g").agg(F.count("*").alias("n"))
    h = F.conv(F.substring(F.md5(F.encode("g", "UTF-8")), 1, 8), 16, 10).cast("long")
    signed = counted.select(key, (h % dim).cast("int").alias("bucket"), (F.when(F.shiftright(h, 8).bitwiseAND(F.lit(1)) == 1, F.col("n")).otherwise(-F.col("n"))).alias("n"))
    summed = signed.groupBy(key, "bucket").agg(F.sum("n").alias("n")).filter(F.col("n") != 0)
    norms = summed.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return summed.join(norms, key).select(key, "bucket", F.round(F.col("n") / F.col("norm"), 6).alias("value"))


@functools.lru_cache(maxsize=300_000)
def _cell(trigram: str) -> int:
    return int(hashlib.md5(trigram.encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest()[:8], 16)


#: Letters whose trigrams a worker looks up in one table; texts with others are hashed trigram by trigram.
LETTERS = 128


class _Trigrams:
    """Signed buckets of trigrams of the first LETTERS letters met, from 1, in a table that is filled as they are met."""

    def __init__(self, dim: int):
        self.dim, self.n = dim, 0
        self.place = np.full(0x110000, -1, np.int16)
        self.known = np.zeros(LETTERS**3, np.int32)

    def of(self, text: str) -> np.ndarray:
        """How often each bucket comes, by the signs of its trigrams."""
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        at = self.place[code]
        if (at < 0).any():
            new = np.unique(code[at < 0])
            if self.n + len(new) > LETTERS:
                return self._slow(text, code.astype(np.int64))
            self.place[new] = np.arange(self.n, self.n + len(new))
            self.n += len(new)
            at = self.place[code]
        at = at.astype(np.int64)
        key = (at[:-2] * LETTERS + at[1:-1]) * LETTERS + at[2:]
        parts = self.known[key]
        if not parts.all():
            missing, first = np.unique(key[parts == 0], return_index=True)
            for k, i in zip(missing, np.flatnonzero(parts == 0)[first], strict=True):
                h = _cell(text[i : i + 3])
                self.known[k] = (h % self.dim + 1) * (1 if h >> 8 & 1 else -1)
            parts = self.known[key]
        return np.bincount(np.abs(parts) - 1, np.sign(parts), self.dim)

    def _slow(self, text: str, code: np.ndarray) -> np.ndarray:
        _, at, n = np.unique((code[:-2] << 42) | (code[1:-1] << 21) | code[2:], return_index=True, return_counts=True)
        h = np.array([_cell(text[i : i + 3]) for i in at], np.int64)
        return np.bincount(h % self.dim, np.where(h >> 8 & 1, n, -n), self.dim)


@functools.lru_cache(maxsize=2)
def _trigrams(dim: int) -> _Trigrams:
    """The table of a number of buckets, once in each worker."""
    return _Trigrams(dim)


def hashed_vectors(texts: DataFrame, key: str = "chunk_id", text: str = "text", dim: int = 192) -> DataFrame:
    """(key, vector): the unit vectors of ``hashed`` as arrays, made in batches; a null text's is all 0."""
    ship()

    @F.pandas_udf("array<double>")
    def encoded(values: pd.Series) -> pd.Series:
        out, table = [], _trigrams(dim)
        for value in values:
            total = np.zeros(dim) if value is None else table.of(" " + _WHITE.sub(" ", value.lower()) + " ")
            norm = np.sqrt((total * total).sum())
            out.append(np.round(total / (norm if norm else 1), 6))
        return pd.Series(out)

    return texts.select(key, encoded(F.col(text)).alias("vector"))


@functools.lru_cache(maxsize=200_000)
def _token_vector(token: str, dim: int = 192) -> np.ndarray:
    total = np.zeros(dim)
    padded = f" {token} "
    for i in range(len(padded) - 2):
        h = _cell(padded[i : i + 3])
        total[h % dim] += 1 if h >> 8 & 1 else -1
    norm = np.sqrt((total * total).sum())
    return np.round(total / (norm if norm else 1), 6)


def token_vectors(texts: DataFrame, key: str = "chunk_id", text: str = "text", most: int = 48) -> DataFrame:
    """(key, at, token, vector): hashed unit vectors of a text's first ``most`` tokens, at from 0.

    The bound is what late interaction stores of a text.
    """
    ship()

    @F.pandas_udf("array<double>")
    def encoded(found: pd.Series) -> pd.Series:
        return pd.Series([_token_vector(t) for t in found])

    found = texts.select(key, F.posexplode(F.slice(tokens(F.col(text)), 1, most)).alias("at", "token"))
    return found.withColumn("vector", encoded("token"))


def maxsim(query: Column, passage: Column) -> Column:
    """Mean over the tokens of a query of the best cosine with any token of a passage; 0 if either has none."""
    ship()

    @F.pandas_udf("double")
    def best(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for q, d in zip(left, right, strict=True):
            if not len(q) or not len(d):
                out.append(0.0)
                continue
            a, b = (np.array([_token_vector(t) for t in x]) for x in (q, d))
            out.append(float((a @ b.T).max(1).mean()))
        return pd.Series(out, dtype="float64")

    return best(query, passage)


def tag(name: str, version: str, dim: int) -> Column:
    """What a vector's encoder is called wherever it is stored."""
    return F.concat_ws(":", F.concat_ws("@", F.lit(name), F.lit(version)), F.concat(F.lit("d"), F.lit(dim).cast("string")))


#: Dimensions that a latent space is searched in; those beyond the ones asked for make it exact enough.
WIDTH = 128


#: Distinct terms of chunks, counted once a chunk, that a task multiplies at a time, and of them at a time in memory.
ENTRIES, SLICE = 2_000_000, 50_000


@dataclass
class Lsa:
    """A latent space: (t, idf, v), the weight and the direction of each term of the corpus, and ``_rows`` of its texts."""

    terms: DataFrame
    rows: tuple[DataFrame, int] | None = None


def _rows(texts: DataFrame) -> tuple[DataFrame, int]:
    """(block, chunk_id, h, x): the hashes of a text's distinct terms, ascending, and 1 + ln n of each; and the number
    of blocks, about ENTRIES terms each. Terms are counted where their text is.

    Two of 15 million terms have one hash of 64 bits with a chance of 1e-5, and would share a direction.
    """
    ship()

    @F.pandas_udf("struct<h:array<long>,x:array<float>>")
    def counted(hashes: pd.Series) -> pd.DataFrame:
        found = [np.unique(h, return_counts=True) for h in hashes]
        return pd.DataFrame({"h": [h.astype(np.int64) for h, _ in found], "x": [(1 + np.log(n)).astype(np.float32) for _, n in found]})

    hashes = F.transform(tokens(F.coalesce(F.col("text"), F.lit(""))), lambda t: F.xxhash64(t))
    rows = kept(texts.select("chunk_id", counted(hashes).alias("c")).select("chunk_id", "c.h", "c.x"))
    blocks = max(1, -(-(rows.agg(F.sum(F.size("h"))).first()[0] or 0) // ENTRIES))
    return rows.withColumn("block", F.pmod(F.xxhash64("chunk_id"), F.lit(blocks))), blocks


def _matrix(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and entry of a sparse matrix's rows (h, x)."""
    if not len(frame):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    row = np.repeat(np.arange(len(frame)), [len(h) for h in frame["h"]])
    return row, np.concatenate(list(frame["h"])).astype(np.int64), np.concatenate(list(frame["x"])).astype(np.float32)


def _summed(to: np.ndarray, of: np.ndarray, x: np.ndarray, vectors: np.ndarray, n: int) -> np.ndarray:
    """n rows: row ``to`` gets ``x`` times row ``of`` of the vectors, a slice of entries at a time."""
    out, order = np.zeros((n, vectors.shape[1])), np.argsort(to, kind="stable")
    for low in range(0, len(order), SLICE):
        at = order[low : low + SLICE]
        starts = np.flatnonzero(np.r_[True, to[at][1:] != to[at][:-1]])
        out[to[at][starts]] += np.add.reduceat(vectors[of[at]] * x[at, None], starts, axis=0)
    return out


def _known(sent: pd.DataFrame, hashes: np.ndarray) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """Terms (h, ...) by hash, which of ``hashes`` are among them, and where."""
    sent = sent.drop_duplicates("h").sort_values("h", ignore_index=True)
    if not len(sent):
        return sent, np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
    h = sent["h"].to_numpy()
    at = np.minimum(np.searchsorted(h, hashes), len(h) - 1)
    return sent, h[at] == hashes, at


def _added(parts: DataFrame) -> DataFrame:
    """(h, part, v): vectors of equal keys added up."""

    def total(batches):
        last = carried = None
        for batch in batches:
            if not len(batch):
                continue
            keys, v = batch[["h", "part"]].to_numpy(), np.stack(batch["v"].to_numpy()).astype(np.float64)
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])
            sums, found = np.add.reduceat(v, starts, axis=0), keys[starts]
            if carried is not None:
                if (found[0] == last).all():
                    sums[0] += carried
                else:
                    yield pd.DataFrame({"h": [last[0]], "part": [last[1]], "v": [carried.astype(np.float32)]})
            if len(found) > 1:
                yield pd.DataFrame({"h": found[:-1, 0], "part": found[:-1, 1], "v": list(sums[:-1].astype(np.float32))})
            last, carried = found[-1], sums[-1]
        if carried is not None:
            yield pd.DataFrame({"h": [last[0]], "part": [last[1]], "v": [carried.astype(np.float32)]})

    return parts.repartition("h", "part").sortWithinPartitions("h", "part").mapInPandas(total, "h long, part long, v array<float>")


def _round(rows: DataFrame, terms: DataFrame, vectors: DataFrame | None) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(h, v), the rows' matrix times itself, transposed, times the vectors (h, v) of terms, or signs that a hash
    of each gives; and the squared singular values and the directions of the rows in between, which are never written.

    A block of rows gets the vector of each of its terms once, and gives one partial sum for it. Its Gram matrix comes
    along as pairs of rounded numbers and their rests, so that sums of them are those of double numbers.
    """
    ship()
    sent = terms.select("h", "idf", "t", F.explode("blocks").alias("block"))
    if vectors is not None:
        sent = terms.join(vectors, "h").select("h", "idf", "v", F.explode("blocks").alias("block"))

    def multiplied(frame: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        row, hashes, x = _matrix(frame)
        sent, known, at = _known(sent, hashes)
        row, at, x = row[known], at[known], x[known]
        if not len(row):
            return pd.DataFrame({"h": [], "part": [], "v": []})
        h, idf = sent["h"].to_numpy(), sent["idf"].to_numpy(np.float32)
        if "v" in sent:
            v = np.stack(sent["v"].to_numpy())
        else:
            drawn = b"".join(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=WIDTH // 8).digest() for t in sent["t"])
            v = np.unpackbits(np.frombuffer(drawn, np.uint8)).reshape(len(h), WIDTH).astype(np.float32) * 2 - 1
        x = x * idf[at]
        y = _summed(row, at, x, v, len(frame))
        gram = y.T @ y
        high = gram.astype(np.float32)
        z = _summed(at, row, x, y.astype(np.float32), len(h)).astype(np.float32)
        block = frame["block"].iloc[0]
        place = 1 + np.arange(WIDTH)
        return pd.DataFrame({"h": np.r_[h, np.repeat(block, 2 * WIDTH)], "part": np.r_[np.zeros(len(h), np.int64), place, -place], "v": [*z, *high, *(gram - high).astype(np.float32)]})

    parts = rows.groupBy("block").cogroup(sent.groupBy("block")).applyInPandas(multiplied, "h long, part long, v array<float>")
    made = kept(_added(parts))
    grams = made.filter("part <> 0").select(F.abs("part").alias("i"), "v").groupBy("i").applyInPandas(lambda p: pd.DataFrame({"i": [p["i"].iloc[0]], "row": [np.sum(np.stack(p["v"]).astype(np.float64), 0)]}), "i long, row array<double>")
    matrix = np.zeros((WIDTH, WIDTH))
    for r in grams.toLocalIterator():
        matrix[r.i - 1] = r.row
    return (made.filter("part = 0").select("h", "v"), *_axes(matrix))


def _axes(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values, greatest first, and the directions they belong to."""
    values, directions = np.linalg.eigh((gram + gram.T) / 2)
    order = np.argsort(-values)
    order = order[values[order] > 1e-10 * max(1e-30, values.max())]
    return values[order], directions[:, order]


def _directions(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """``_axes`` of rows (v); WIDTH squared numbers of each task are summed up before they come to the driver."""
    ship()

    def gram(batches):
        total = np.zeros((WIDTH, WIDTH))
        for batch in batches:
            if len(batch):
                y = np.stack(batch["v"]).astype(np.float64)
                total += y.T @ y
        yield pd.DataFrame({"i": np.arange(WIDTH), "row": list(total)})

    parts = vectors.select("v").mapInPandas(gram, "i long, row array<double>").groupBy("i").applyInPandas(lambda p: pd.DataFrame({"i": [p["i"].iloc[0]], "row": [np.sum(np.stack(p["row"]), 0)]}), "i long, row array<double>")
    matrix = np.zeros((WIDTH, WIDTH))
    for r in parts.toLocalIterator():
        matrix[r.i] = r.row
    return _axes(matrix)


def _turned(vectors: DataFrame, by: str, matrix: np.ndarray, width: int = WIDTH) -> DataFrame:
    """(by, v): rows times a small matrix, padded to ``width``."""
    ship()
    shared = vectors.sparkSession.sparkContext.broadcast(np.pad(matrix, ((0, 0), (0, width - matrix.shape[1]))).astype(np.float32))

    @F.pandas_udf("array<float>")
    def turned(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(v) @ shared.value)) if len(v) else pd.Series([], dtype="object")

    return vectors.select(by, turned("v").alias("v"))


def lsa_fit(texts: DataFrame, dim: int = 96, min_df: int = 1, rounds: int = 2) -> Lsa:
    """A truncated SVD of tf-idf rows of (chunk_id, text) over the whole vocabulary of at least ``min_df`` chunks.

    Randomised subspace iteration: rows are projected by signs that a hash of each term gives, made orthonormal,
    and sent through the matrix and back ``rounds`` times. Vectors of terms stay tables; only WIDTH squared numbers at
    a time come to the driver, however many terms or texts there are. A vector is moved once for each block of texts
    that has its term, not once for each text.
    """
    if dim > WIDTH:
        raise ValueError(f"at most {WIDTH} dimensions are searched in")
    rows, blocks = _rows(texts)
    n_docs = texts.count()
    held = texts.select(F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)).alias("block"), F.explode(F.array_distinct(tokens(F.col("text")))).alias("t")).groupBy("t", "block").agg(F.count("*").alias("df"))
    df = held.groupBy("t").agg(F.sum("df").alias("df"), F.collect_list("block").alias("blocks"))
    terms = kept(df.filter(F.col("df") >= min_df).select("t", F.xxhash64("t").alias("h"), (F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1).alias("idf"), "blocks"))
    found = None
    for _ in range(rounds):
        back, values, directions = _round(rows, terms, found)
        found = _turned(back, "h", directions / np.sqrt(values))
    found = kept(found)
    values, directions = _directions(found)
    # what is kept and moved from here on is what was asked for, not all that was searched in
    vectors = _turned(found, "h", (directions / np.sqrt(values))[:, :dim], dim)
    return Lsa(kept(terms.join(vectors, "h").select("t", "idf", "v")), (rows, blocks))


def lsa_encode(texts: DataFrame, model: Lsa, dim: int = 96, rows: tuple[DataFrame, int] | None = None) -> DataFrame:
    """(chunk_id, vector): unit vectors of texts in the latent space; a text without known terms is all 0.

    The texts that a model was fitted on need not be cut and written again: their ``rows`` are the model's.
    """
    rows, _ = rows or _rows(texts)
    few, _ = sized(kept(rows.select("block", F.explode("h").alias("h")).distinct()), 48)
    sent = model.terms.withColumn("h", F.xxhash64("t")).join(few, "h").select("block", "h", "idf", "v")

    def unit(frame: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        row, hashes, x = _matrix(frame)
        sent, known, at = _known(sent, hashes)
        y = np.zeros((len(frame), dim))
        if known.any():
            row, at, x = row[known], at[known], x[known]
            y[:, : len(sent["v"].iloc[0])] = _summed(row, at, x * sent["idf"].to_numpy(np.float32)[at], np.stack(sent["v"].to_numpy())[:, :dim], len(frame))
        norms = np.linalg.norm(y, axis=1, keepdims=True)
        return pd.DataFrame({"chunk_id": frame["chunk_id"], "vector": list(y / np.where(norms == 0, 1, norms))})

    kind = texts.schema["chunk_id"].dataType.simpleString()
    return rows.groupBy("block").cogroup(sent.groupBy("block")).applyInPandas(unit, f"chunk_id {kind}, vector array<double>")


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def ivf_build(vectors: DataFrame, cells: int = 16, sample: int = 20_000, rounds: int = 10) -> np.ndarray:
    """Centroids of inverted lists, by spherical k-means over at most ``sample`` vectors of lowest hash."""
    rows = vectors.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).select("vector").collect()
    x = np.array([r.vector for r in rows], np.float64)
    centers = x[:: max(1, len(x) // cells)][:cells].copy()
    for _ in range(rounds):
        near = (x @ centers.T).argmax(1)
        for c in range(len(centers)):
            if (near == c).any():
                m = x[near == c].mean(0)
                centers[c] = m / max(np.linalg.norm(m), 1e-12)
    return centers


#: Cells that a vector is kept in, and cells that a query looks into.
SPILL, PROBES = 2, 8


def ivf_search(queries: DataFrame, vectors: DataFrame, centers: np.ndarray, probes: int = PROBES, n: int = 10, spill: int = SPILL) -> DataFrame:
    """Approximate nearest neighbours: every vector is in its ``spill`` nearest cells, and only those of the ``probes``
    cells nearest to a query count for it; with as many probes as cells the search is exact. Pairs are never rows."""

    def near(x: np.ndarray, most: int) -> np.ndarray:
        inside = np.zeros((len(x), len(centers)), np.float32)
        np.put_along_axis(inside, np.argsort(-(x @ centers.T), axis=1, kind="stable")[:, :most], 1, axis=1)
        return inside

    def scores(q: tuple[np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
        return np.where(near(x, spill) @ q[1].T > 0, np.round(x @ q[0].T, 6), -np.inf)

    return nearest(queries, vectors, n, lambda q: (q, near(q, probes)), scores)


def knn_graph(vectors: DataFrame, m: int = 16, long_links: int = 4) -> DataFrame:
    """(node, nb): for each vector its ``m`` nearest ones, and a few far ones drawn by hashes, by which a walk gets
    from one region to another."""
    from lodestone.operators.ann import neighbours

    near = neighbours(vectors, m).select("node", "nb")
    n = max(1, vectors.count() // 4)
    stands = vectors.groupBy(F.pmod(F.xxhash64("chunk_id", F.lit(17)), F.lit(n)).alias("b")).agg(F.min("chunk_id").alias("nb"))
    drawn = vectors.select(F.col("chunk_id").alias("node"), F.explode(F.sequence(F.lit(1), F.lit(long_links))).alias("i"))
    far = drawn.withColumn("b", F.pmod(F.xxhash64("node", "i"), F.lit(n))).join(stands, "b").select("node", "nb")
    return near.unionByName(far).filter(F.col("node") != F.col("nb")).distinct()


def graph_search(queries: DataFrame, vectors: DataFrame, edges: DataFrame | None, n: int = 10, ef: int = 128, beam: int = 4, entries: int = 4, allowed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Best-first walks over a graph for all queries at once: (qid, chunk_id, score, rank) and (qid, visits).

    Each round looks at the neighbours of every query's best ``beam`` nodes not looked at yet, until ``ef`` nodes
    are visited or none is left. Only vectors of (chunk_id) in ``allowed`` are visited. Without a graph the
    search is exact.
    """
    from lodestone.operators.retrieve import knn

    nodes = vectors if allowed is None else vectors.join(allowed.select("chunk_id").distinct(), "chunk_id", "left_semi")
    nodes = nodes.select("chunk_id", "vector")
    if edges is None or edges.isEmpty():
        return knn(queries, nodes, n), queries.select("qid").crossJoin(nodes.agg(F.count("*").alias("visits")))
    q = queries.select("qid", F.col("vector").alias("qv"))

    def scored(pairs: DataFrame) -> DataFrame:
        both = nodes.join(F.broadcast(pairs), "chunk_id").join(F.broadcast(q), "qid")
        return both.select("qid", "chunk_id", F.round(dot(F.col("qv"), F.col("vector")), 6).alias("score"))

    first = nodes.select("chunk_id").orderBy(F.xxhash64("chunk_id", F.lit(7)), "chunk_id").limit(entries)
    seen = kept(scored(q.select("qid").crossJoin(first)).withColumn("done", F.lit(False)))
    for _ in range(ef):
        counts = seen.groupBy("qid").agg(F.count("*").alias("visits"))
        order = Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")
        active = seen.filter(~F.col("done")).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= beam).join(counts.filter(F.col("visits") < ef), "qid")
        active = kept(active.select("qid", "chunk_id", "visits"))
        if active.isEmpty():
            break
        reached = edges.join(F.broadcast(active.withColumnRenamed("chunk_id", "node")), "node").select("qid", F.col("nb").alias("chunk_id"), "visits").distinct()
        new = scored(reached.join(seen.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti")).join(active.select("qid", "visits").distinct(), "qid")
        new = new.withColumn("r", F.row_number().over(order)).filter(F.col("visits") + F.col("r") <= ef).select("qid", "chunk_id", "score", F.lit(False).alias("done"))
        marked = seen.join(active.select("qid", "chunk_id", F.lit(True).alias("now")), ["qid", "chunk_id"], "left").select("qid", "chunk_id", "score", (F.col("done") | F.coalesce("now", F.lit(False))).alias("done"))
        seen = kept(marked.unionByName(new))
    return top(seen, n).select("qid", "chunk_id", "score", "rank"), seen.groupBy("qid").agg(F.count("*").alias("visits"))
