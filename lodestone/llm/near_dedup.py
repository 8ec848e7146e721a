"""Near-duplicate removal: universal hash minima, bands, signatures compared, and components of the links.

1. A document's set is that of its word shingles. Its signature holds the least value of each of HASHES functions of a
   strongly universal family, (a x + b) mod 2^64 by its upper 32 bits; bands of ROWS of them are its keys. Documents
   of one 128-bit fingerprint of the set are one node, so exact copies are never paired.
2. Nodes that share a band key are candidates; a pair whose signatures agree in fewer places than a pair at
   the threshold does, but for a chance of ``miss``, is dropped. What is left joins nodes to clusters.
3. Links are confirmed on the full sets, word by word: each cluster's members against its least member first, which
   grows as the cluster does, and only those that this leaves apart against all others, in blocks.
4. Components of the confirmed links come from alternating large-star and small-star steps.

Hot band keys and large clusters are dealt in blocks to many tasks. A pair at 0.8 shares no band with a
probability of 1e-6; more alike ones are missed far more rarely.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import SLICE_CHARS, ship, slices, within, written
from lodestone.llm.components import components

SIZE = 2
#: A link: SHARE[0] * common >= SHARE[1] * union of the two sets.
SHARE = (100, 80)
BANDS, ROWS = 26, 4
HASHES = BANDS * ROWS
#: Chance at which comparing signatures drops a pair at the threshold.
MISS = 1e-9
#: Nodes of a band group, and members of a cluster, that meet in one block; shingles of such a block.
GROUP_BLOCK = 1_500
CLUSTER_BLOCK = 500
SHINGLE_BLOCK = 400_000
#: Pairs whose signatures are held at a time.
PAIRS = 100_000

_U = np.uint64
_drawn = np.random.default_rng(11).integers(0, 1 << 64, (2, HASHES), _U)
#: Factors and summands of the hash functions.
_A, _B = _drawn[0] | _U(1), _drawn[1]
_PLAIN = bytes(32 if b in b"\t\n\v\f\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Two primes below 2^31 and the bases at which a word's bytes are evaluated as a polynomial modulo each.
_PRIMES, _BASES = (2147483647, 2147483629), (1164837151, 948701839)
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def words_of(text: str) -> list[bytes]:
    """What stands between white space of ASCII, A-Z lower-cased, as UTF-8."""
    return [w for w in text.encode("utf-8", "surrogatepass").translate(_PLAIN).split(b" ") if w]


def _spread(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers_to(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of both bases and of their inverses, at least ``n`` of each."""
    if not _powers or len(_powers[0][0]) < n:
        _powers.clear()
        for prime, base in zip(_PRIMES, _BASES, strict=True):
            pair = []
            for b in (base, pow(base, -1, prime)):
                out = np.ones(1, _U)
                while len(out) < n:
                    out = np.r_[out, out * _U(pow(b, len(out), prime)) % _U(prime)]
                pair.append(out)
            _powers.append((pair[0], pair[1]))
    return _powers


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """62-bit hashes of the words of some text and where they start. A hash depends on the word alone."""
    letters = np.frombuffer(data.translate(_PLAIN), np.uint8)
    edges = np.diff(np.r_[np.int8(0), (letters != 32).view(np.int8), np.int8(0)])
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    out = np.zeros(len(starts), _U)
    values = letters.astype(_U) + _U(1)  # so that leading zero bytes count
    for prime, (powers, inverses) in zip(_PRIMES, _powers_to(len(letters) + 1), strict=True):
        sums = np.r_[_U(0), np.cumsum(values * powers[: len(letters)])]
        out = (out << _U(31)) | (((sums[ends] - sums[starts]) % _U(prime)) * inverses[starts] % _U(prime))
    return out, starts


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, end to end, and how many each has; long texts are cut between words."""
    found, counts = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass").translate(_PLAIN)
        start = 0
        while start < len(data):
            stop = data.find(b" ", start + 2 * SLICE_CHARS) if len(data) - start > 2 * SLICE_CHARS else -1
            stop = stop if stop >= 0 else len(data)
            hashes, _ = _hashed(data[start:stop])
            found.append(hashes)
            counts[i] += len(hashes)
            start = stop
    return np.concatenate(found) if found else np.zeros(0, _U), counts


def shingles(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, end to end, and how many each has.

    A text of fewer than ``size`` words, but not none, has one shingle of all its words.
    """
    words, counts = word_hashes(texts)
    owner, n = np.repeat(np.arange(len(texts)), counts), len(words)
    padded, owners = np.r_[words, np.zeros(size, _U)], np.r_[owner, np.full(size, -1)]
    total = np.zeros(n, _U)
    for j in range(size):
        total = _spread(total * _U(3) + np.where(owners[j : j + n] == owner, padded[j : j + n] + _U(1), _U(0)))
    begin = np.r_[True, owner[1:] != owner[:-1]] if n else np.zeros(0, bool)
    valid = (owners[size - 1 : size - 1 + n] == owner) | (begin & (np.minimum(counts, size)[owner] < size))
    total, owner = total[valid], owner[valid]
    order = np.lexsort((total, owner))
    total, owner = total[order], owner[order]
    keep = np.r_[True, (total[1:] != total[:-1]) | (owner[1:] != owner[:-1])] if len(total) else np.zeros(0, bool)
    return total[keep], np.bincount(owner[keep], minlength=len(texts))


def signatures(texts: list[str], size: int = SIZE) -> pd.DataFrame:
    """n_shingles, node, bands and minima of each text; node is null for a text without words."""
    parts = [pd.DataFrame({"n_shingles": np.zeros(0, np.int64), "node": [], "bands": [], "minima": []})]
    for start, stop in slices([len(t) for t in texts]):
        hashes, counts = shingles(texts[start:stop], size)
        has = np.flatnonzero(counts)
        at = np.r_[0, np.cumsum(counts[has])].astype(np.int64)
        least = np.zeros((stop - start, HASHES), np.uint32)
        x = hashes >> _U(32)
        for j in range(HASHES if len(has) else 0):
            least[has, j] = np.minimum.reduceat((x * _A[j] + _B[j]) >> _U(32), at[:-1])
        bands = np.zeros((stop - start, BANDS), np.uint64)
        for b in range(BANDS):
            key = np.full(stop - start, b + 1, _U)
            for j in range(b * ROWS, (b + 1) * ROWS):
                key = _spread(key + least[:, j])
            bands[:, b] = key
        node: list[bytes | None] = [None] * (stop - start)
        for i, low, high in zip(has, at[:-1], at[1:], strict=True):
            node[i] = hashlib.blake2b(hashes[low:high].tobytes(), digest_size=16).digest()
        parts.append(pd.DataFrame({"n_shingles": counts, "node": node, "bands": [r.tobytes() for r in bands.astype("<u8")], "minima": [r.astype(np.uint8).tobytes() for r in least]}))
    return pd.concat(parts[1:] or parts, ignore_index=True)


def fewest_matches(miss: float = MISS, share: tuple[int, int] = SHARE) -> int:
    """Places at which the signatures of a pair at the threshold agree, or more, but for a chance of ``miss``."""
    t = share[1] / share[0]
    chance, m = 0.0, -1
    while chance < miss:
        m += 1
        chance += math.comb(HASHES, m) * t**m * (1 - t) ** (HASHES - m)
    return m


def settle(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Gives nodes joined by edges (a, b) the least label of either, until nothing changes."""
    while len(a):
        low = np.minimum(label[a], label[b])
        if (label[a] == low).all() and (label[b] == low).all():
            return
        for to in (label[a], label[b], a, b):
            np.minimum.at(label, to, low)
        label[:] = label[label]


def _gathered(batches: Iterator[pd.DataFrame], judge: Callable[[list[tuple]], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``judge`` of the rows of each group g; rows come sorted by it."""
    rows = (row for batch in batches for row in batch.itertuples(index=False, name=None))
    for _, group in groupby(rows, key=lambda r: r[0]):
        yield judge(list(group))


def compared(group: list[tuple], fewest: int) -> pd.DataFrame:
    """Edges (u, v) of a band group's block that the signatures leave; rows are (g, side, node, minima).

    Sides 0 and 1 meet each other only; 2 is a block that meets itself.
    """
    side = np.array([r[1] for r in group])
    sketch = np.frombuffer(b"".join(r[3] for r in group), np.uint8).reshape(-1, HASHES)
    label = np.arange(len(group))
    for i in range(len(group) - 1):
        rest = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        rest = rest[(side[i] == 2) | (side[rest] != side[i])]
        for low in range(0, len(rest), PAIRS):
            part = rest[low : low + PAIRS]
            part = part[(sketch[part] == sketch[i]).sum(1) >= fewest]
            settle(label, np.full(len(part), i), part)
    moved = np.flatnonzero(label != np.arange(len(label)))
    return pd.DataFrame({"u": [group[i][2] for i in moved], "v": [group[label[i]][2] for i in moved]})


def exact_sets(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' shingles by number, the texts they are in, and the sizes of the texts' sets; words themselves are compared."""
    ids: dict[bytes, int] = {}
    numbers: dict[tuple[int, ...], int] = {}
    sets = []
    for text in texts:
        words = [ids.setdefault(w, len(ids)) for w in words_of(text)]
        k = min(size, len(words))
        sets.append({numbers.setdefault(s, len(numbers)) for s in zip(*(words[i:] for i in range(k)), strict=False)} if k else set())
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.fromiter((x for s in sets for x in s), np.int64, int(sizes.sum()))
    return flat, np.repeat(np.arange(len(texts)), sizes), sizes


def _linked(common: np.ndarray, a: np.ndarray, b: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    return (share[0] * common >= share[1] * (a + b - common)) & (common > 0)


def to_hub(group: list[tuple], size: int, share: tuple[int, int]) -> pd.DataFrame:
    """(u, v): whether members (node u) of a cluster's block are linked to its hub (v = hub) or not (v null).

    Rows are (g, is_hub, node, text).
    """
    hubs = [r for r in group if r[1]]
    members = [r for r in group if not r[1]]
    if not hubs or not members:
        return pd.DataFrame({"u": [], "v": []})
    flat, owner, sizes = exact_sets([hubs[0][3], *(r[3] for r in members)], size)
    inside = np.zeros(int(flat.max(initial=0)) + 1, bool)
    inside[flat[owner == 0]] = True
    common = np.bincount(owner, inside[flat], minlength=len(sizes)).astype(np.int64)[1:]
    joined = _linked(common, sizes[1:], sizes[0], share)
    return pd.DataFrame({"u": [r[2] for r in members], "v": [hubs[0][2] if x else None for x in joined]})


def to_all(group: list[tuple], size: int, share: tuple[int, int]) -> pd.DataFrame:
    """Edges (u, v) of the links of a meeting; rows are (g, apart, node, text): nodes apart meet all others."""
    held: dict[bytes, tuple] = {}
    for row in group:
        if row[2] not in held or row[1]:
            held[row[2]] = row
    rows = list(held.values())
    flat, owner, sizes = exact_sets([r[3] for r in rows], size)
    by = np.argsort(flat, kind="stable")
    flat, owner = flat[by], owner[by]
    starts = np.r_[0, np.cumsum(np.bincount(flat))] if len(flat) else np.zeros(1, np.int64)
    label = np.arange(len(rows))
    each = np.split(np.arange(len(flat))[np.argsort(owner, kind="stable")], np.cumsum(np.bincount(owner, minlength=len(rows)))[:-1])
    for i, row in enumerate(rows):
        if row[1] and len(each[i]):
            mine = flat[each[i]]
            lengths = starts[mine + 1] - starts[mine]
            offset = np.repeat(starts[mine] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(int(lengths.sum()))
            common = np.bincount(owner[offset], minlength=len(rows))
            common[i] = 0
            found = np.flatnonzero(_linked(common, sizes, sizes[i], share))
            settle(label, np.full(len(found), i), found)
    moved = np.flatnonzero(label != np.arange(len(label)))
    return pd.DataFrame({"u": [rows[i][2] for i in moved], "v": [rows[label[i]][2] for i in moved]})


def _each_other(df: DataFrame, node: str, blocks: str, key: list[str]) -> DataFrame:
    """Each row once for every block that its own one meets: g, the meeting's number, and its side in it."""
    own = F.pmod(F.xxhash64(F.lit(3), F.col(node)), F.col(blocks))
    met = df.withColumn("_own", own).withColumn("_other", F.explode(F.expr(f"sequence(0L, cast({blocks} AS BIGINT) - 1)")))
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    side = F.when(low == high, 2).when(F.col("_own") == low, 0).otherwise(1)
    return met.withColumns({"g": F.xxhash64(*key, low, high), "side": side.cast("int")})


def _dealt(rows: DataFrame, judge: Callable[[list[tuple]], pd.DataFrame]) -> DataFrame:
    """(u, v) by ``judge`` of each group g of the rows."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "g").sortWithinPartitions("g").mapInPandas(lambda it: _gathered(it, judge), "u binary, v binary")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, share: tuple[int, int] = SHARE, miss: float = MISS) -> DataFrame:
    """One row a document: ``key``, n_shingles, component_id and kept.

    Documents whose sets of distinct ``size``-word shingles have share[0] * common >= share[1] * union are linked;
    ``component_id`` is the least key that links lead to, a document's own included, and ``kept`` marks those whose
    it is. Texts of fewer words are one shingle; texts that are null or have no words have none and are linked with
    nothing, like rows without a key, whose component is null and which are not kept. Repeated rows are
    documents of their own and share a component. Texts of any length are compared whole. An empty table stays
    empty; other columns don't matter.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    @F.pandas_udf("n_shingles long, node binary, bands binary, minima binary")
    def signed(texts: pd.Series) -> pd.DataFrame:
        return signatures(texts.tolist(), size)

    signs = written(rows.withColumn("_s", signed("text")).select("key", F.xxhash64("text").alias("t"), "_s.*"))
    able = signs.filter(F.col("key").isNotNull() & F.col("node").isNotNull())
    nodes = able.groupBy("node").agg(F.min(F.struct("key", "t")).alias("of"), F.max("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("minima").alias("minima"))
    nodes = written(nodes.select("node", F.col("of.key").alias("rep"), F.col("of.t").alias("t"), "n_shingles", "bands", "minima"))

    number = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(b.alias("band"), F.substring(F.col("bands"), b * 8 + 1, F.lit(8)).alias("k")))
    banded = nodes.select("node", F.explode(number).alias("b")).select("node", F.xxhash64("b.band", "b.k").alias("band"))
    # counted apart from the join that follows, so that a hot band's nodes need not meet in one task
    groups = written(banded.groupBy("band").agg(F.count("*").alias("size")).filter(F.col("size") > 1))
    groups = within(groups.withColumn("blocks", F.ceil(F.col("size") / GROUP_BLOCK)), F.lit(32))
    dealt = _each_other(banded.join(groups, "band"), "node", "blocks", ["band"]).select("g", "side", "node")
    fewest = fewest_matches(miss, share)
    edges = _dealt(dealt.join(nodes.select("node", "minima"), "node").select("g", "side", "node", "minima"), lambda group: compared(group, fewest))
    clusters = components(edges)

    # texts of the clusters' members, one for each node, however often its row is repeated
    members = written(clusters.join(nodes.select("node", "rep", "t", "n_shingles"), "node"))
    chosen = within(members.select(F.col("rep").alias("key"), "t").distinct(), F.coalesce(F.octet_length(F.col("key").cast("string")), F.lit(0)) + 32)
    said = rows.withColumn("t", F.xxhash64("text")).join(chosen, ["key", "t"], "left_semi").groupBy(F.col("key").alias("rep"), "t").agg(F.first("text").alias("text"))
    texts = written(members.join(said, ["rep", "t"]).select("node", "root", "n_shingles", "text"))

    totals = texts.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / CLUSTER_BLOCK), F.ceil(F.sum("n_shingles") / SHINGLE_BLOCK)).alias("blocks"))
    totals = within(written(totals), F.lit(32))
    g = lambda block: F.xxhash64("root", block).alias("g")
    of_block = F.pmod(F.xxhash64(F.lit(5), F.col("node")), F.col("blocks"))
    sized = texts.join(totals, "root")
    spokes = sized.filter(F.col("node") != F.col("root")).select(g(of_block), F.lit(False).alias("hub"), "node", "text")
    hubs = sized.filter(F.col("node") == F.col("root")).select("root", "node", "text", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"))
    hubs = hubs.select(g(F.col("block")), F.lit(True).alias("hub"), "node", "text")
    tried = written(_dealt(spokes.unionByName(hubs), lambda group: to_hub(group, size, share)))

    apart = written(tried.filter(F.col("v").isNull()).select(F.col("u").alias("node"), F.lit(True).alias("apart")))
    links = tried.filter(F.col("v").isNotNull())
    if not apart.isEmpty():
        marked = texts.join(apart, "node", "left").withColumn("apart", F.coalesce("apart", F.lit(False)))
        shape = marked.filter("apart").groupBy("root").agg(F.ceil(F.count("*") / CLUSTER_BLOCK).alias("few"))
        shape = within(written(shape.join(totals, "root")), F.lit(48))
        open_ = marked.join(shape, "root")
        few = F.pmod(F.xxhash64(F.lit(7), F.col("node")), F.col("few"))
        meet = lambda a, b: F.xxhash64("root", a, b).alias("g")
        ones = open_.filter("apart").withColumn("i", few).select("root", "i", "apart", "node", "text", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("j"))
        others = open_.withColumn("j", of_block).select("root", "j", F.lit(False).alias("apart"), "node", "text", F.explode(F.expr("sequence(0L, few - 1)")).alias("i"))
        meetings = ones.select(meet(F.col("i"), F.col("j")), "apart", "node", "text").unionByName(others.select(meet(F.col("i"), F.col("j")), "apart", "node", "text"))
        links = links.unionByName(_dealt(meetings, lambda group: to_all(group, size, share)))

    joined = components(links)
    placed = nodes.select("node", "rep").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of_node = placed.join(placed.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("node", "component_id")
    known = signs.select("key", "n_shingles", F.when(F.col("key").isNotNull(), F.col("node")).alias("node"))
    out = known.join(of_node, "node", "left").select(F.col("key").alias(key), "n_shingles", F.coalesce("component_id", "key").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))


#: The same in DuckDB, by comparing the shingle sets of all documents that share a shingle.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + k - 1), ' ') AS h
  FROM (SELECT doc_id, w, least(2, len(w)) AS k, unnest(range(1, len(w) - least(2, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), rare AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY f, h) AS place FROM (SELECT s.doc_id, s.h, n, count(*) OVER (PARTITION BY s.h) AS f FROM s JOIN n USING (doc_id))
), likely AS MATERIALIZED (
  SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM rare x JOIN rare y ON x.h = y.h AND x.doc_id < y.doc_id
  WHERE x.place <= x.n - (4 * x.n + 4) // 5 + 1 AND y.place <= y.n - (4 * y.n + 4) // 5 + 1 AND 5 * x.n >= 4 * y.n AND 5 * y.n >= 4 * x.n
), l AS MATERIALIZED (
  SELECT a, b FROM (SELECT a, b, count(*) AS c FROM likely JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND y.h = x.h GROUP BY a, b)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)
), edge AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (SELECT doc_id AS node, doc_id AS reached FROM documents UNION SELECT r.node, e.b FROM r JOIN edge e ON e.a = r.reached
), c AS (SELECT node AS doc_id, min(reached) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
