"""BPE encoding and decoding with an automaton compiled from the merges.

The automaton reads and writes sequences of vocabulary symbols. It starts as one state with a loop for
every base symbol, which accepts every spelling. The merges are then built in, one gadget after the
other. The gadget of ``u v -> uv`` takes the state that ``u`` arcs enter, clones it without its ``v`` arc,
sends the ``u`` arcs to the clone, and gives every state that has a ``u`` arc a ``uv`` arc to where ``v``
leads. After the last gadget it accepts of every word exactly the one spelling that the merges produce.

Where an arc leads depends on its label alone, so a state is named after the label that enters it. A
clone shares all arcs but one with its original, so gadgets are stored as differences, in order:
``cut[u, v]`` is the gadget that took the ``v`` arc out of ``u``'s state, ``made[t]`` the one that added
``t``, ``first[t]`` the arc ``t`` was copied from and ``last[t]`` the state that ``t``'s own was cloned
from. ``arc(p, t)`` reads a transition from these differences and keeps it in the transition table.

Encoding a pre-split word walks these transitions from the longest fitting label on, and returns from
dead ends; the accepted path is unique, so the first one found is the encoding. Decoding emits the
labels of the arcs.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import SLICE_CHARS, ship, unused
from lodestone.llm.token_counts import byte_symbols

#: Words and transitions that a worker remembers; beyond that it starts anew.
REMEMBERED = 150_000
#: Code points that the split's classes of letters and of numbers do not have, though later
#: versions of Unicode do, and letters that have a lower case there, with the distance to it.
LATER_LETTERS = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 "
    "10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 "
    "191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED "
    "1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
LATER_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"
LATER_LOWER = {"1C89": 1, "A7CB": -42343, "A7CC": 1, "A7CE": 1, "A7D2": 1, "A7D4": 1, "A7DA": 1, "A7DC": -42561, "10D50-10D65": 32, "16EA0-16EB8": 27}
_LATEST = 1 << 60
_SHORT = (3, 2, 1)

SCHEMA = "ids array<int>, n_tokens long, decoded string"


class MergeAutomaton:
    """The automaton of one vocabulary and its merges."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = ""):
        self.vocab, self.end = vocab, end
        self.label = {i: s for s, i in vocab.items()}
        self.size = max(vocab.values()) + 1
        self.cut: dict[int, int] = {}  # by label * size + next label, as the table is
        self.made: dict[int, int] = {}
        self.first: dict[int, int] = {}
        self.last: dict[int, int] = {}
        for gadget, (a, b) in enumerate(merges):
            self._add(gadget, vocab[a], vocab[b], vocab[a + b])
        self.table: dict[int, bool] = {}
        # the labels that some arc has: base symbols and what gadgets added; others are never written
        base = {t for t, s in self.label.items() if len(s) == 1 or (end and s.endswith(end) and len(s) == 1 + len(end))}
        usable = set(base)
        for t, gadget in self.made.items():  # in order; a gadget whose two arcs never meet adds none
            if self.first[t] in usable and self.last[t] in usable and self._resolve(self.first[t], self.last[t], gadget):
                usable.add(t)
        self.labelled = {s: t for s, t in vocab.items() if t in usable}
        #: by the first four characters of what is still to be spelled, the sizes to try, longest first
        sizes: dict[str, set[int]] = {}
        for s in self.labelled:
            plain = s.removesuffix(end) if end else s
            if len(plain) > 3:
                sizes.setdefault(plain[:4], {1, 2, 3}).add(len(plain))
        self.sizes = {k: tuple(sorted(v, reverse=True)) for k, v in sizes.items()}

    def _add(self, gadget: int, u: int, v: int, uv: int) -> None:
        self.cut.setdefault(u * self.size + v, gadget)
        if uv not in self.made:
            self.made[uv], self.first[uv], self.last[uv] = gadget, u, v

    def arc(self, p: int, t: int) -> bool:
        """Whether the state that ``p`` enters has a ``t`` arc."""
        key = p * self.size + t
        known = self.table.get(key)
        if known is None:
            known = self.table[key] = self._resolve(p, t)
        return known

    def _resolve(self, p: int, t: int, before: int = _LATEST) -> bool:
        """``before``: gadgets from this one on don't count, as p or t is a copy made by then."""
        while True:
            if self.cut.get(p * self.size + t, _LATEST) < before:
                return False
            of_p, of_t = self.made.get(p, -1), self.made.get(t, -1)
            if of_p < 0 and of_t < 0:
                return True
            if of_p > of_t:  # p's state is a clone of the state its second half enters
                before, p = of_p, self.last[p]
            else:  # t is a copy of its first half's arc, in states that this very gadget left that arc
                before, t = of_t + 1, self.first[t]

    def encode(self, word: str) -> list[int] | None:
        """Ids of the accepted path of a word; None if the vocabulary can't spell it."""
        labelled, end, sizes, table, n = self.labelled, self.end, self.sizes, self.table, len(word)
        width = self.size
        whole = labelled.get(word + end)
        if whole is not None:
            return [whole]
        path: list[int] = []
        ends: list[int] = []
        untried: list = []  # sizes left at each earlier place
        dead: set[tuple[int, int]] = set()  # labels and ends from which no path goes on
        pos, here, left = 0, None, iter(sizes.get(word[:4], _SHORT))
        while True:
            for size in left:
                stop = pos + size
                if stop > n:
                    continue
                token = labelled.get(word[pos:stop] if stop < n else word[pos:] + end)
                if token is None:
                    continue
                if here is not None:
                    allowed = table.get(here * width + token)
                    if not (self.arc(here, token) if allowed is None else allowed):
                        continue
                if dead and (token, stop) in dead:
                    continue
                path.append(token)
                if stop == n:
                    return path
                ends.append(pos)
                untried.append(left)
                pos, here, left = stop, token, iter(sizes.get(word[stop : stop + 4], _SHORT))
                break
            else:
                if not path:
                    return None
                dead.add((path.pop(), pos))
                pos, left, here = ends.pop(), untried.pop(), path[-1] if path else None


def _points(ranges: str) -> Iterator[range]:
    for part in ranges.split():
        low, _, high = part.partition("-")
        yield range(int(low, 16), int(high or low, 16) + 1)


def _class(ranges: str) -> str:
    """Ranges of code points as the inside of a character class."""
    return "".join(f"\\U{x[0]:08X}-\\U{x[-1]:08X}" for x in _points(ranges))


class Codec:
    """Encoder and decoder of one tokenizer file: its normalisation, splitting, automaton and labels."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = special
        self.labels = self.automaton.label | {i: s for s, i in special.items()}
        self.find_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        if self.steps != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"] or spec.get("decoder"):
            raise ValueError(f"{path} has other steps than this codec")
        # texts with code points that versions of Unicode tell apart are split by the classes of the file's own library
        letters, numbers = _class(LATER_LETTERS), _class(LATER_NUMBERS)
        self.lower = {c: c + step for ranges, step in LATER_LOWER.items() for part in _points(ranges) for c in part}
        self.later = regex.compile(f"[{letters}{numbers}{''.join(map(chr, self.lower))}]")
        other = split["pattern"]["Regex"].replace(r"[\p{L}]+", rf"[\p{{L}}--[{letters}]]+").replace(r"[^\s\p{L}\p{N}]+", rf"(?:[^\s\p{{L}}\p{{N}}]|[{letters}{numbers}])+")
        self.later_words = regex.compile(other.replace(r"|[\p{N}]|", rf"|[\p{{N}}--[{numbers}]]|"), regex.V1)
        self.space = regex.compile(r"\s+")
        self.symbol = dict(enumerate(byte_symbols()))
        self.known: dict[str, tuple] = {}

    def is_later(self, text: str) -> bool:
        """Whether a text has code points that versions of Unicode tell apart; most texts can't, by their encoding."""
        if text.isascii():
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.later.search(text) is not None
        return False

    def normal(self, text: str, later: bool = False) -> str:
        """NFC, runs of white space as one space, lower case letter by letter."""
        text = self.space.sub(" ", unicodedata.normalize("NFC", text))
        if later:
            text = text.translate(self.lower)
        return text.replace("Σ", "σ").lower()  # no final sigma: letters are lowered one at a time

    def _entries(self, words: list[str]) -> list[tuple]:
        """Ids of each word, and both the ids and what they decode to as text; words not met before are encoded first."""
        known = self.known
        if len(known) > REMEMBERED or len(self.automaton.table) > 2 * REMEMBERED:
            known.clear()
            self.automaton.table.clear()
        got = list(map(known.get, words))
        if None not in got:
            return got
        for word in {w for w, entry in zip(words, got, strict=True) if entry is None}:
            symbols = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.symbol)
            known[word] = self._entry(self.automaton.encode(symbols) or [])
        return list(map(known.__getitem__, words))

    def _entry(self, ids: list[int]) -> tuple:
        return tuple(ids), len(ids), " ".join(map(str, ids)), self.decode(ids)

    def walk(self, text: str) -> Iterator[list[tuple]]:
        """Entries of a text's words and of the special tokens written in it, some at a time."""
        for i, part in enumerate(self.find_special.split(text) if self.find_special else [text]):
            if i % 2:
                yield [self._entry([self.special[part]])]
                continue
            later = self.is_later(part)
            normal, split = self.normal(part, later), self.later_words if later else self.words
            if len(normal) <= SLICE_CHARS:
                yield self._entries(split.findall(normal))
                continue
            words = split.finditer(normal)
            while some := [found.group() for found in itertools.islice(words, 20_000)]:
                yield self._entries(some)

    def encode(self, text: str) -> list[int]:
        """Ids of a text, without begin or end tokens; special tokens written in the text are found."""
        return [i for entries in self.walk(text) for ids, *_ in entries for i in ids]

    def digest(self, text: str) -> tuple[int, str, str]:
        """How many ids a text has, and digests of them as decimal numbers and of what they decode to.

        Both are texts of words joined by a space, as ids and labels are, so words give them as well.
        """
        n, ids, labels = 0, [], []
        for entries in self.walk(text):
            for _, size, numbers, spelled in entries:
                if size:
                    n += size
                    ids.append(numbers)
                    labels.append(spelled)
        return n, *(hashlib.sha256(" ".join(x).encode("utf-8", "surrogatepass")).hexdigest() for x in (ids, labels))

    def decode(self, ids) -> str:
        """Labels of the arcs, special ones too, with a space between; the file names no other decoder."""
        return " ".join(map(self.labels.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """The codec of a file, once in each worker."""
    return Codec(path)


def encode_decode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``df`` with ``bpe``: a struct of ids, n_tokens and decoded for its text column.

    Null and empty texts have no ids and decode to the empty text. Very long texts are walked word by
    word. Repeated rows and null ids are encoded like any others; an empty table stays empty; a column
    that is already named ``bpe`` is replaced.
    """
    ship(df.sparkSession)

    @F.pandas_udf(SCHEMA)
    def coded(texts: pd.Series) -> pd.DataFrame:
        c = codec(path)
        ids = [c.encode(t) for t in texts]
        return pd.DataFrame({"ids": ids, "n_tokens": list(map(len, ids)), "decoded": list(map(c.decode, ids))}, columns=["ids", "n_tokens", "decoded"])

    return df.withColumn("bpe", coded(F.coalesce(F.col(text), F.lit(""))))


def digests(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``df`` with n_tokens, ids_sha256 and decoded_sha256 of its text column, made beside the codec.

    The digests are those of ``encode_decode``'s ids and decoded text; computing them in the worker spares
    the way of both back to the JVM.
    """
    ship(df.sparkSession)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digested(texts: pd.Series) -> pd.DataFrame:
        c = codec(path)
        return pd.DataFrame([c.digest(t) for t in texts], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    at = unused("bpe", df)
    coded = df.withColumn(at, digested(F.coalesce(F.col(text), F.lit(""))))
    return coded.withColumns({c: F.col(at)[c] for c in ("n_tokens", "ids_sha256", "decoded_sha256")}).drop(at)
