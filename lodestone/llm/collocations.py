"""Phrase collocations, mined from vertical positional inverted lists.

1. Texts are cut into blocks of about BLOCK words. A block's vertical lists hold, for every word of a language,
   the sorted positions it stands at. Separators and ends of texts take a position of their own, so that words on
   either side of one are never adjacent. A text longer than a block goes on in the next one: a block knows
   the LONGEST - 1 words that follow it, and counts what starts within it.
2. Frequent words are those whose lists hold ``least`` positions in all blocks together; no part of a frequent
   phrase is rarer than the phrase. Each gets a number, which is sent to the blocks that have it.
3. A level's phrases are extended by merge-joining their lists with those of the words that stand next to their
   ends, if the occurrence one word on is one of a frequent phrase too. The lengths of the lists found, summed
   over blocks, are the exact frequencies of the next level. A block keeps the words' lists, compressed; those
   of frequent phrases are joined again from them, level by level, when they are extended.

A block and its lists are bounded, so that the memory of a task is too, and a hot word or language is a list
in each block and never in one place. Lists stay with their block: blocks send the frequencies of their phrases,
packed, to parts that sum those of some phrases each and tell the blocks in return which are frequent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import ship, within, written

LEAST = 30
LONGEST = 4
TOP = 2_000
#: Words of a block, and bytes of text that are cut into words at a time.
BLOCK = 1_000_000
SLICE = 2_000_000
#: Phrases of blocks whose frequencies are summed in one place, on average at most.
TOGETHER = 2_000_000
#: Positions of a block end here; what follows it stands at this position and beyond.
END = 1 << 30
#: Separators become line feeds, tabs spaces, and A-Z a-z; all are bytes of their own in UTF-8.
_PLAIN = bytes(10 if chr(b) in ".,;:!?\n\v\f\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))

_WORDS = "block long, w long, lang string, word string, n long, lists binary"
#: What a block or a part says: whom it is for, and the frequencies or numbers of phrases, packed.
_SAID = "block long, part long, a long, b long, f long, id long, data binary"
_WORDS_ARROW = pa.schema([("block", pa.int64()), ("w", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("lists", pa.binary())])
_SAID_ARROW = pa.schema([*((c, pa.int64()) for c in ("block", "part", "a", "b", "f", "id")), ("data", pa.binary())])


class _Numbers(dict):
    """Numbers of a language's words in the order in which a block meets them; 0 for nothing, 1 for a separator."""

    def __init__(self, lang: str, words: list[tuple[str, bytes]]):
        super().__init__({b"": 0, b"\n": 1})
        self.lang, self.words = lang, words

    def __missing__(self, word: bytes) -> int:
        self.words.append((self.lang, word))
        self[word] = len(self.words) + 1
        return self[word]


def cut(text: str) -> Iterator[list[bytes]]:
    """Words and separators of a text, by SLICE bytes at a time, with a separator at its end."""
    data = text.encode("utf-8", "surrogatepass").translate(_PLAIN)
    start = 0
    while len(data) - start > SLICE:
        space, line = data.find(b" ", start + SLICE), data.find(b"\n", start + SLICE)
        stop = min((x for x in (space, line) if x >= 0), default=len(data))
        yield data[start:stop].replace(b"\n", b" \n ").split(b" ")
        start = stop
    yield (data[start:] + b"\n").replace(b"\n", b" \n ").split(b" ")


def _by(keys: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inverted: the distinct keys, how often each starts within the block, their lists end to end, and the lists' sizes."""
    order = np.argsort(keys, kind="stable")
    keys, positions = keys[order], positions[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    n = np.add.reduceat((positions < END).astype(np.int64), first) if len(first) else first
    return keys[first], n, positions, np.diff(np.r_[first, len(keys)])


def _squeezed(numbers: np.ndarray) -> bytes:
    """Whole numbers, byte by byte of all of them, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T)
    return len(numbers).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _numbers(value: bytes) -> np.ndarray:
    n = int.from_bytes(value[:8], "little")
    planes = np.frombuffer(pa.decompress(value[8:], 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<i8").astype(np.int64)


def packed(positions: np.ndarray, sizes: np.ndarray) -> bytes:
    """A block's lists as one value: their sizes, and the steps from position to position."""
    return _squeezed(np.r_[len(sizes), sizes, np.diff(positions, prepend=0)])


def unpacked(value: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions and sizes of the lists in ``value``."""
    numbers = _numbers(value)
    lists = 1 + int(numbers[0])
    return np.cumsum(numbers[lists:]), numbers[1:lists]


def packed_rows(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers as one value; the first had better ascend."""
    return _squeezed(np.concatenate([np.diff(columns[0], prepend=0), *columns[1:]]))


def unpacked_rows(values: list[bytes], columns: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns of several values end to end, and how many rows each value has."""
    parts = [_numbers(v).reshape(columns, -1) for v in values]
    whole = [np.concatenate([np.cumsum(p[0]) if c == 0 else p[c] for p in parts]) if parts else np.zeros(0, np.int64) for c in range(columns)]
    return whole, np.array([p.shape[1] for p in parts], np.int64)


def blocks(texts: Iterator[tuple[str, str]], number: int, most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The vertical lists of (lang, text) in blocks of at least ``most`` positions; ``number`` is the first block's."""
    words: list[tuple[str, bytes]] = []
    numbers: dict[str, _Numbers] = {}
    held: list[np.ndarray] = []
    size = 0
    ended: tuple | None = None  # a block that waits for the words that follow it in its last text

    def made(held: list[np.ndarray], size: int, words: list[tuple[str, bytes]], number: int, ahead: list[int]) -> pa.RecordBatch:
        ids = np.concatenate([*held, np.array(ahead, np.int32)])
        at = np.arange(END - size, END + len(ahead), dtype=np.int64)
        keys, n, positions, sizes = _by(ids[ids > 1], at[ids > 1])
        said = [words[k - 2] for k in keys]
        columns = [np.full(len(keys) + 1, number), np.r_[np.arange(len(keys)), -1], [*(x for x, _ in said), None], [*(x.decode("utf-8", "replace") for _, x in said), None], np.r_[n, 0], [*[None] * len(keys), packed(positions, sizes)]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _WORDS_ARROW, strict=True)], schema=_WORDS_ARROW)

    for lang, text in texts:
        for part, tokens in enumerate(cut(text)):
            if size >= most:
                ended, of, ahead = (held, size, words, number), numbers.get(lang), []
                words, numbers, held, size, number = [], {}, [], 0, number + 1
                if not part:
                    yield made(*ended, [])
                    ended = None
            if ended:
                ahead += [of[t] for t in islice(filter(None, tokens), LONGEST - 1 - len(ahead))]
                if len(ahead) == LONGEST - 1:
                    yield made(*ended, ahead)
                    ended = None
            if lang not in numbers:
                numbers[lang] = _Numbers(lang, words)
            ids = np.fromiter(map(numbers[lang].__getitem__, tokens), np.int32, len(tokens))
            held.append(ids[ids > 0])
            size += len(held[-1])
        if ended:
            yield made(*ended, ahead)
            ended = None
    if size:
        yield made(held, size, words, number, [])


def adjacent(starts: np.ndarray, words: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge join of ascending positions: the places in both lists where ``starts`` + ``shift`` meets ``words``."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(words, starts + shift), len(words) - 1)
    left = np.flatnonzero(words[at] == starts + shift)
    return left, at[left]


class Sent:
    """What a block is told: the numbers of the frequent ones among phrases (a, b) of a prefix and a word."""

    def __init__(self, values: list[bytes]):
        (a, b, self.ids), _ = unpacked_rows(values, 3)
        self.firsts, self.seconds = np.unique(a), np.unique(b)
        keys = self._key(a, b)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], self.ids[order]

    def _key(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        i, j = (np.minimum(np.searchsorted(of, x), len(of) - 1) for of, x in ((self.firsts, a), (self.seconds, b)))
        return np.where((self.firsts[i] == a) & (self.seconds[j] == b), i * len(self.seconds) + j, -1)

    def numbers(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The pairs' numbers; -1 for those that aren't frequent."""
        if not len(self.keys):
            return np.full(len(a), -1, np.int64)
        wanted = self._key(a, b)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ids[at], -1)


def extend(table: pa.Table, size: int, parts: int) -> pa.Table:
    """Frequencies in a block of what extends its frequent phrases of ``size`` words, dealt to parts by their hash.

    ``table`` has the block's lists (size 0), the numbers of its frequent words (size 1: local numbers and theirs in
    rows, or for all lists packed), and by size k what it is told of phrases of k words. Single words lead to
    their packed numbers being said as well.
    """
    block, of = table["block"][0].as_py(), table["size"].to_numpy()
    values = {k: [v for v in table["data"].filter(pa.array(of == k)).to_pylist() if v is not None] for k in range(size + 1)}
    positions, sizes = unpacked(values[0][0])
    if values[1]:
        ids = _numbers(values[1][0])
    else:
        ids = np.full(len(sizes), -1, np.int64)
        ids[table["a"].to_numpy()[of == 1]] = table["id"].to_numpy()[of == 1]
    frequent = np.repeat(ids, sizes)
    order = np.argsort(np.where(frequent >= 0, positions, 2 * END))[: int((frequent >= 0).sum())]
    words, word_ids = positions[order], frequent[order]
    starts, phrases_ = words, word_ids
    for k in range(2, size + 1):
        left, right = adjacent(starts, words, k - 1)
        found = Sent(values[k]).numbers(phrases_[left], word_ids[right])
        starts, phrases_ = starts[left][found >= 0], found[found >= 0]
    # the phrase one word on must be frequent as well, and its last word stands where the extension does
    on, _ = adjacent(starts, starts, 1)
    left, right = adjacent(starts[on], words, size)
    uses, number = np.unique(np.r_[phrases_[on][left], word_ids[right]], return_inverse=True)
    pairs, n, _, _ = _by(number[: len(left)] * len(uses) + number[len(left) :], starts[on][left])
    pairs, n = pairs[n > 0], n[n > 0]
    a, b = uses[pairs // max(len(uses), 1)], uses[pairs % max(len(uses), 1)]
    part = ((a * 1_000_003 + b) * 0x9E3779B97F4A7C1 >> 20) % parts
    said = [(-1, _squeezed(ids))] if size == 1 else []
    for p in np.unique(part):
        mine = part == p
        said.append((int(p), packed_rows(a[mine], b[mine], n[mine])))
    none = np.full(len(said), -1)
    return pa.table([pa.array(c, f.type) for c, f in zip((np.full(len(said), block), [p for p, _ in said], none, none, none, none, [d for _, d in said]), _SAID_ARROW, strict=True)], schema=_SAID_ARROW)


def count(table: pa.Table, least: int) -> pa.Table:
    """The frequent phrases (a, b) of a part with their frequencies and numbers, and what to tell each block of its own."""
    part, block_of = table["part"][0].as_py(), table["block"].to_numpy()
    (a, b, n), rows = unpacked_rows(table["data"].to_pylist(), 3)
    order = np.lexsort((b, a))
    first = np.flatnonzero(np.r_[True, (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)])
    f = np.add.reduceat(n[order], first)
    number = np.empty(len(a), np.int64)
    number[order] = np.repeat(np.where(f >= least, np.cumsum(f >= least) - 1, -1), np.diff(np.r_[first, len(a)]))
    found = order[first[f >= least]]
    out = [pa.table([pa.array(c, k.type) for c, k in zip((np.full(len(found), -1), np.full(len(found), part), a[found], b[found], f[f >= least], (part << 32) + np.arange(len(found)), [None] * len(found)), _SAID_ARROW, strict=True)], schema=_SAID_ARROW)]
    ends = np.cumsum(rows)
    told: list[tuple[int, bytes]] = []
    for block, low, high in zip(block_of, ends - rows, ends, strict=True):
        mine = low + np.flatnonzero(number[low:high] >= 0)
        if len(mine):
            told.append((int(block), packed_rows(a[mine], b[mine], (part << 32) + number[mine])))
    none = np.full(len(told), -1)
    out.append(pa.table([pa.array(c, k.type) for c, k in zip(([x for x, _ in told], none, none, none, none, none, [x for _, x in told]), _SAID_ARROW, strict=True)], schema=_SAID_ARROW))
    return pa.concat_tables(out)


def _extending(size: int, parts: int) -> Callable[[pa.Table], pa.Table]:
    return lambda table: extend(table, size, parts)


def _counting(least: int) -> Callable[[pa.Table], pa.Table]:
    return lambda table: count(table, least)


def _bytes(*columns: str) -> Column:
    return sum((F.octet_length(c) for c in columns), F.lit(32))


def phrases(docs: DataFrame, least: int = LEAST, lang: str = "lang", text: str = "text", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of every phrase of up to LONGEST words that occurs ``least`` times, and (lang, n) of all words."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        texts = ((x.as_py(), y.as_py()) for batch in batches for x, y in zip(batch["lang"], batch["text"], strict=True))
        yield from blocks(texts, TaskContext.get().partitionId() << 32, block)

    kept = written(rows.mapInArrow(inverted, _WORDS))
    postings = kept.filter(F.col("w") >= 0)
    totals = written(postings.groupBy("lang").agg(F.sum("n").alias("n")))
    parts = max(1, -(-(totals.agg(F.sum("n").alias("n")).first().n or 0) // TOGETHER))
    sums = postings.groupBy("lang", "word").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    words = written(sums.withColumn("id", F.monotonically_increasing_id()))
    levels = [words.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("k"), "f", "id")]
    of_word = within(words.select(F.col("id").alias("b"), F.col("word").alias("last")), _bytes("last"))

    def to_block(frame: DataFrame, size: int, a: str = "a", id: str = "id", data: str = "data") -> DataFrame:
        return frame.select("block", F.lit(size).alias("size"), F.col(a).alias("a"), F.col(id).alias("id"), F.col(data).alias("data"))

    nothing = F.lit(None).cast("binary")
    lists = to_block(kept.filter(F.col("w") < 0), 0, "w", "w", "lists")
    told = postings.select("block", "w", "lang", "word").join(within(words.select("lang", "word", "id"), _bytes("lang", "word")), ["lang", "word"])
    messages = [to_block(told.withColumn("data", nothing), 1, "w")]
    for size in range(2, LONGEST + 1):
        # blocks of which no word is frequent are told nothing and have nothing
        grown = written(reduce(DataFrame.unionByName, messages, lists).groupBy("block").applyInArrow(_extending(size - 1, parts), _SAID))
        counted = written(grown.filter(F.col("part") >= 0).groupBy("part").applyInArrow(_counting(least), _SAID))
        if size == 2:
            messages = [to_block(grown.filter(F.col("part") < 0), 1)]
        messages.append(to_block(counted.filter(F.col("block") >= 0), size))
        found = counted.filter(F.col("block") < 0).select("a", "b", "f", "id")
        of_prefix = within(levels[-1].select(F.col("id").alias("a"), "lang", F.col("phrase").alias("head")), _bytes("lang", "head"))
        named = found.join(of_prefix, "a").join(of_word, "b")
        levels.append(written(named.select("lang", F.concat_ws(" ", "head", "last").alias("phrase"), F.lit(size).alias("k"), "f", "id")))
    return reduce(DataFrame.unionByName, levels).drop("id"), totals


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, lang: str = "lang", text: str = "text", block: int = BLOCK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first ``top`` collocations.

    Words are what stands between spaces and tabs, A-Z lower-cased, and phrases lie between separators. Candidates
    are phrases of 2 to LONGEST words that occur a >= ``least`` times. A cut of one into parts of l and r
    occurrences scores floor(2,000,000 a / (l + r)); the lowest score counts, the first cut among equal ones.
    A candidate inside a longer one with 80 % of its occurrences or more is dropped. Ranks go by score, a and
    the phrase's bytes. Null languages are ``und``; null and empty texts have no words, repeated rows count each
    time, texts of any length are taken whole. An empty table gives no rows; other columns don't matter.
    """
    all_phrases, totals = phrases(docs, least, lang, text, block)
    frequencies = all_phrases.select("lang", "phrase", "f")
    longer = all_phrases.filter("k > 1").withColumn("words", F.split("phrase", " "))
    part = lambda start, size: F.array_join(F.slice("words", start, size), " ")

    cuts = longer.select("lang", "phrase", "k", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "k", "a", "cut", part(F.lit(1), F.col("cut")).alias("first"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    cuts = cuts.join(frequencies.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(frequencies.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("cast(2000000 AS decimal(7,0)) * cast(a AS decimal(20,0)) div (cast(l AS decimal(20,0)) + cast(r AS decimal(20,0)))")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("of"))

    inside = longer.filter("k > 2").select("lang", "f", "words", "k", F.explode(F.expr("sequence(2, k - 1)")).alias("m"))
    inside = inside.select("lang", "f", "words", "m", F.explode(F.expr("sequence(1, k - m + 1)")).alias("start"))
    inside = inside.groupBy("lang", part(F.col("start"), F.col("m")).alias("phrase")).agg(F.max("f").alias("most"))
    wide = lambda factor, column: F.lit(factor).cast("decimal(3,0)") * F.col(column).cast("decimal(20,0)")
    left = scored.join(inside, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (wide(100, "most") < wide(80, "a")))

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.select("lang", "phrase", "a", "of.l", "of.r", "of.score").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    out = ranked.join(within(totals, _bytes("lang")), "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same in DuckDB, by counting all phrases of all pieces.
ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), f AS MATERIALIZED (
  SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, 5) t(k)) GROUP BY ALL
), total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), candidate AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30
), cuts AS (
  SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a // (x.f + y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidate) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[:c.cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:], ' ')
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inside AS (
  SELECT lang, array_to_string(w[s:s + m - 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS s FROM (SELECT *, unnest(range(2, k)) AS m FROM candidate)) GROUP BY ALL
), ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank
  FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.most IS NULL OR 100::HUGEINT * i.most < 80::HUGEINT * b.a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
