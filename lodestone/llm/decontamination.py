"""Benchmark decontamination as a prefix-filtered set join.

A window of an item is contained in a document only if all its three-word shingles are. So one shingle of
each window suffices as the necessary prefix of its set, and the rarest one over all documents is taken:
first a pass counts in how many documents each shingle of the benchmark occurs, then a second pass joins
the documents' shingles with those prefixes alone. A matching shingle fixes where its window would have to
lie (positional bound) and that it fits into the document (length bound); its words are then compared.

Words are 64-bit hashes of their bytes throughout, so a window is compared as 13 such numbers in order. The
benchmark is the stated, small side. It is taken in blocks of at most about BLOCK_BYTES of text; the arrays
of a block take about six times its text and are sent to the workers (48 MB for 8 MB); documents are never
shuffled and no text of theirs is gathered anywhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import durable, ship, slices
from lodestone.llm.shingles import mix, word_hashes

WINDOW = 13
SHINGLE = 3
#: Text of the benchmark that is sent to the workers at a time.
BLOCK_BYTES = 8_000_000
#: Pairs of a document's shingle and a window that are compared at a time.
PAIRS = 200_000

_U = np.uint64
_FOUND = "n_words long, n_hit long, starts array<int>, ends array<int>, items array<string>"


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of ``size`` words from each place on; the last ``size - 1`` places have none."""
    n = max(0, len(words) - size + 1)
    total = np.full(n, size, _U)
    for j in range(size):
        total = mix(total + words[j : j + n])
    return total


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, end to end."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


@dataclass
class Block:
    """Windows of some items: words end to end, and the place, size and item of each window."""

    items: list[str]
    words: np.ndarray
    start: np.ndarray
    size: np.ndarray
    item: np.ndarray
    shingles: dict[int, np.ndarray]  # by shingle size, sorted and distinct

    @classmethod
    def of(cls, rows: list[tuple[object, str | None]], window: int) -> Block:
        texts = [text or "" for _, text in rows]
        words, counts = word_hashes(texts)
        first = np.cumsum(counts) - counts
        sizes = np.minimum(counts, window)  # an item shorter than a window, but not empty, is one itself
        n = np.where(counts > 0, counts - sizes + 1, 0)
        start, item = _ranges(first, n), np.repeat(np.arange(len(texts)), n)
        start, size, item = (x.astype(np.int32) for x in (start, sizes[item], item))
        block = cls(["" if i is None else str(i) for i, _ in rows], words, start, size, item, {})
        for k in np.unique(np.minimum(block.size, SHINGLE)):
            of = np.minimum(block.size, SHINGLE) == k
            places = np.unique(_ranges(block.start[of], block.size[of] - k + 1))
            block.shingles[int(k)] = np.unique(shingle_hashes(words, int(k))[places])
        return block

    def prefixes(self, frequency: dict[int, np.ndarray]) -> Prefixes:
        """The rarest shingle of each window, the first of equally rare ones; windows are sorted by it."""
        out = {}
        for k, known in self.shingles.items():
            of = np.flatnonzero(np.minimum(self.size, SHINGLE) == k)
            hashes = shingle_hashes(self.words, k)
            # documents of the shingle at each place; places that begin none are never looked at
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            count = frequency[k][at]
            span = self.size[of] - k + 1
            offset = np.zeros(len(of), np.int64)
            for width in np.unique(span):
                same = np.flatnonzero(span == width)
                least = count[self.start[of[same]]]
                for j in range(1, int(width)):
                    here = count[self.start[of[same]] + j]
                    offset[same] = np.where(here < least, j, offset[same])
                    least = np.minimum(least, here)
            rarest = hashes[self.start[of] + offset]
            order = np.argsort(rarest, kind="stable")
            keys, first, n = np.unique(rarest[order], return_index=True, return_counts=True)
            out[k] = keys, *(x.astype(np.int32) for x in (first, n, of[order], offset[order]))
        return Prefixes(replace(self, shingles={}), out)


@dataclass
class Prefixes:
    """Prefix shingles with the windows that each stands for."""

    block: Block
    by_size: dict[int, tuple[np.ndarray, ...]]

    def search(self, words: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places, sizes and items of occurring windows, in the words of some documents end to end."""
        block = self.block
        stop = np.cumsum(counts)
        owner = np.repeat(np.arange(len(counts)), counts)
        begin, end = (stop - counts)[owner], stop[owner]
        for k, (keys, first, n, window, offset) in self.by_size.items():
            hashes = shingle_hashes(words, k)
            if not len(hashes):
                continue
            at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            places = np.flatnonzero(keys[at] == hashes)
            reach = np.cumsum(n[at[places]])
            done = 0
            while done < len(places):
                until = max(done + 1, int(np.searchsorted(reach, (reach[done - 1] if done else 0) + PAIRS, "right")))
                here = places[done:until]
                times = n[at[here]]
                which = _ranges(first[at[here]], times)
                w = window[which]
                start = np.repeat(here, times) - offset[which]
                size = block.size[w]
                fits = start >= np.repeat(begin[here], times)
                fits &= start + size <= np.repeat(end[here], times)
                w, start, size = w[fits], start[fits], size[fits]
                for j in range(int(size.max()) if len(size) else 0):
                    on = size > j
                    equal = ~on
                    equal[on] = words[start[on] + j] == block.words[block.start[w[on]] + j]
                    w, start, size = w[equal], start[equal], size[equal]
                yield start, size, block.item[w]
                done = until


def _frequencies(docs: DataFrame, text: str, block: Block) -> dict[int, np.ndarray]:
    """In how many documents each shingle of the block occurs. At most one row a shingle comes back."""
    shared = docs.sparkSession.sparkContext.broadcast(block.shingles)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = {k: np.zeros(len(known), np.int64) for k, known in shared.value.items()}
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            for low, high in slices([len(t) for t in texts]):
                words, sizes = word_hashes(texts[low:high])
                owner = np.repeat(np.arange(high - low), sizes)
                for k, known in shared.value.items():
                    hashes = shingle_hashes(words, k)
                    at = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
                    inside = (owner[: len(hashes)] == owner[k - 1 :]) & (known[at] == hashes)
                    both = np.unique(owner[: len(hashes)][inside] * len(known) + at[inside])
                    np.add.at(counts[k], both % len(known), 1)
        for k, n in counts.items():
            some = np.flatnonzero(n)
            yield pd.DataFrame({"k": k, "shingle": some, "n": n[some]}).astype("int64")

    parts = docs.select(F.col(text).alias("text")).mapInPandas(count, "k long, shingle long, n long")
    out = {k: np.zeros(len(known), np.int64) for k, known in block.shingles.items()}
    for r in parts.groupBy("k", "shingle").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.k][r.shingle] = r.n
    return out


def covered(starts, ends) -> int:
    """Words that lie in any of the spans."""
    total = reach = 0
    for start, stop in sorted(zip(starts, ends, strict=True)):
        total += max(0, stop - max(start, reach))
        reach = max(reach, stop)
    return total


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, item: str = "item_id", item_text: str = "text", share: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit, hit_starts, hit_ends, hit_items (sorted strings), n_items and contaminated.

    A document is contaminated if any of its words is hit and ``share * n_hit >= n_words``. Null and empty
    texts have no words and are clean; a null item id counts as the empty string; items without words have
    no window; equal item ids count once. Very long documents and items are taken whole. Repeated documents
    and null ids are judged like any others; an empty benchmark hits nothing and an empty table stays empty.
    Existing columns of these names are replaced, no others.
    """
    spark = docs.sparkSession
    ship(spark)
    bench = benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("text"))
    volume = bench.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("n")).first().n
    blocks = max(1, math.ceil(volume / block_bytes))
    kept = next(f"_found{'_' * i}" for i in range(len(docs.columns) + 1) if f"_found{'_' * i}" not in docs.columns)
    found = docs
    for b in range(blocks):
        rows = bench.filter(F.pmod(F.xxhash64(F.col("item").cast("string"), "text"), F.lit(blocks)) == b)
        block = Block.of([(r.item, r.text) for r in rows.collect()], window)  # about block_bytes
        shared = spark.sparkContext.broadcast(block.prefixes(_frequencies(docs, text, block)))
        before = [F.col(f"{kept}.{c}") if b else F.array().cast(f"array<{kind}>") for c, kind in (("starts", "int"), ("ends", "int"), ("items", "string"))]
        found = found.withColumn(kept, _searcher(shared)(F.col(text), *before))
        if blocks > 1:
            found = durable(found)

    out = found.withColumns({"n_words": F.col(f"{kept}.n_words"), "n_hit": F.col(f"{kept}.n_hit"), "hit_starts": F.col(f"{kept}.starts"), "hit_ends": F.col(f"{kept}.ends"), "hit_items": F.array_sort(F.array_distinct(F.col(f"{kept}.items")))})
    return out.withColumns({"n_items": F.size("hit_items").cast("long"), "contaminated": (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))}).drop(kept)


def _searcher(shared):
    """Adds what a block finds to what earlier ones found. One function does it all, as a task has a Python
    worker for each one it calls."""

    @F.pandas_udf(_FOUND)
    def search(texts: pd.Series, starts: pd.Series, ends: pd.Series, items: pd.Series) -> pd.DataFrame:
        prefixes = shared.value
        values = [t or "" for t in texts]
        out = []
        for low, high in slices([len(v) for v in values]):
            words, counts = word_hashes(values[low:high])
            stop = np.cumsum(counts)
            first = stop - counts
            spans: dict[int, tuple[set, set]] = {}
            for begun, sizes, of in prefixes.search(words, counts):
                docs = np.searchsorted(stop, begun, "right")
                for d, s, n, i in zip(docs.tolist(), (begun - first[docs]).tolist(), sizes.tolist(), of.tolist(), strict=True):
                    known = spans.setdefault(d, (set(), set()))
                    known[0].add((s, s + n))
                    known[1].add(prefixes.block.items[i])
            for d, (old, ended, was) in enumerate(zip(starts[low:high], ends[low:high], items[low:high], strict=True)):
                new, of = spans.get(d, ((), ()))
                both = sorted({*zip(old, ended, strict=True), *new})
                begun, stops = [s for s, _ in both], [e for _, e in both]
                out.append((int(counts[d]), covered(begun, stops), begun, stops, sorted({*was, *of})))
        return pd.DataFrame(out, columns=["n_words", "n_hit", "starts", "ends", "items"])

    return search


#: The same in DuckDB: all windows of documents and items, joined as text.
ORACLE_SQL = r"""
WITH low AS (
  SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS lo
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), up, lo), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents, low
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), up, lo), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark, low
), bw AS (
  SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win
  FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i
        FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT k FROM bw), dw AS (
  SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)
), hit AS (
  SELECT doc_id, k, i, item_id FROM dw JOIN bw USING (k, win)
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
