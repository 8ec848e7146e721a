"""Token counts by rank-synchronous merging of ragged numpy arrays.

All distinct pre-tokens of a batch lie end to end in one array of symbol ids. In each step every
sequence finds its own lowest-rank pair and merges all its occurrences at once, left to right where
they overlap; sequences without a pair left are done, and their surviving symbols are counted. Steps
therefore number as many as the longest merge chain, not as many as there are symbols.

Merging all occurrences of a pair at once equals merging them one by one, because a pair that a merge
makes possible always ranks below (that is, after) the merge itself; the loader checks this property.
"""

from __future__ import annotations

import functools
import itertools
import json

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import SLICE_CHARS, ship, slices, unused

#: The pre-token pattern of byte-level BPE files.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pre-tokens whose counts a worker remembers; beyond that it starts anew.
REMEMBERED = 400_000
_NONE = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the others take the code points from 256 on, in order.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class RankMerger:
    """Counts byte-level BPE tokens of texts under one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        self.size = max(vocab.values()) + 1
        self.byte_ids = np.array([vocab[s] for s in byte_symbols()], np.int64)
        left, right, made = [], [], []
        rank_of: dict[int, int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            new = vocab[a + b]
            if max(rank_of.get(vocab[a], -1), rank_of.get(vocab[b], -1)) >= rank:
                raise ValueError(f"merge {rank} of {path} comes before a merge that makes one of its parts")
            rank_of.setdefault(new, rank)
            left.append(vocab[a])
            right.append(vocab[b])
            made.append(new)
        keys = np.array(left, np.int64) * self.size + np.array(right, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array(made, np.int64)
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.words = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def count_words(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each pre-token; no pre-token is empty."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        out = lengths.copy()
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        rank = np.full(len(symbols), _NONE)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = self._rank(symbols[inner], symbols[inner + 1])
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(symbols)])
            lowest = np.minimum.reduceat(rank, starts)
            out[owner[starts]] = sizes
            alive = np.repeat(lowest != _NONE, sizes)
            best = np.repeat(lowest, sizes)
            if not alive.all():
                symbols, owner, rank, best = symbols[alive], owner[alive], rank[alive], best[alive]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == best)
            joined = np.r_[False, np.diff(at) == 1]
            if joined.any():  # overlapping occurrences: from the left, every second one
                index = np.arange(len(at))
                first = np.maximum.accumulate(np.where(joined, 0, index))
                at = at[(index - first) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            at = place[at]
            rank[at] = _NONE
            for changed in (at[at + 1 < len(symbols)], at[at > 0] - 1):
                changed = changed[owner[changed] == owner[changed + 1]]
                rank[changed] = self._rank(symbols[changed], symbols[changed + 1])
        return out

    def _sum(self, words: list[str]) -> int:
        return sum(map(self.known.__getitem__, words))

    def _learn(self, words) -> None:
        new = list(set(words) - self.known.keys())
        if new:
            counts = self.count_words([w.encode("utf-8", "surrogatepass") for w in new])
            self.known.update(zip(new, counts.tolist(), strict=True))

    def _forget(self) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text. Work arrays hold SLICE_CHARS of text at a time, however long one is."""
        out: list[int] = []
        for start, stop in slices([len(t) for t in texts]):
            if stop == start + 1 and len(texts[start]) > SLICE_CHARS:
                out.append(self._count_long(texts[start]))
                continue
            split = []
            special = 0
            for text in texts[start:stop]:
                special = len(self.special.findall(text)) if self.special else 0
                parts = self.special.split(text) if special else [text]
                words = self.words.findall(parts[0]) if len(parts) == 1 else [w for p in parts for w in self.words.findall(p)]
                split.append((special, words))
            self._learn(itertools.chain.from_iterable(w for _, w in split))
            out.extend(s + self._sum(w) for s, w in split)
            self._forget()
        return out

    def _count_long(self, text: str) -> int:
        total = start = 0
        ends = [(m.start(), m.end()) for m in self.special.finditer(text)] if self.special else []
        for stop, after in [*ends, (len(text), None)]:
            found = (m.group() for m in self.words.finditer(text, start, stop))
            # a look-ahead sees past stop unless the part is cut out
            if stop < len(text):
                found = (m.group() for m in self.words.finditer(text[start:stop]))
            while words := list(itertools.islice(found, SLICE_CHARS // 8)):
                self._learn(words)
                total += self._sum(words)
                self._forget()
            total += after is not None
            start = after
        return total


@functools.lru_cache(maxsize=2)
def merger(path: str) -> RankMerger:
    """The merger of a file, once in each worker."""
    return RankMerger(path)


def token_count(text: Column, path: str) -> Column:
    """Number of tokens of ``text`` under the byte-level BPE file at ``path``; 0 for null or empty."""

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        return pd.Series(merger(path).count(texts.tolist()), dtype="int64")

    return counted(F.coalesce(text, F.lit("")))


def count_tokens(df: DataFrame, path: str, text: str = "text", limit: int = 1024, prefix: str = "") -> DataFrame:
    """``df`` with n_bytes, n_tokens and over_limit of its text column.

    Null and empty texts have 0 bytes and 0 tokens. Very long texts are counted piece by piece in bounded
    memory. Repeated rows and null ids are counted like any others; an empty table stays empty. Columns
    that ``df`` already has under the three names (with ``prefix`` before them) are replaced.
    """
    ship(df.sparkSession)
    whole = F.coalesce(F.col(text), F.lit(""))
    at = unused("n_tokens", df)
    return (
        df.withColumn(at, token_count(F.col(text), path))
        .withColumns({f"{prefix}n_bytes": F.octet_length(whole).cast("long"), f"{prefix}n_tokens": F.col(at)})
        .withColumn(f"{prefix}over_limit", F.col(at) > limit)
        .drop(at)
    )
