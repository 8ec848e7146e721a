"""Language identification of spans in mixed-language text.

Training counts character n-grams of words (with marks at both ends) for each language over a bounded
sample of labelled documents, and in which scripts each language is written. A word's score for a language
is its mean log-probability of n-grams under that language, times its length. The scripts of a word's
letters, found from character ranges, narrow the candidates to the languages that use all of them (to none
if no language does). Viterbi then labels the words
of a text with one language each, paying a penalty for each switch; runs of equal labels are the spans.

Viterbi runs over all texts of a slice at once: step i advances every text that has a word i. Texts whose
best path is one language throughout are recognised beforehand: no run of words gains more by any other
languages than one switch costs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import bounded_sample, durable, ship, slices, unused, within

#: Labelled documents that train a language, at most (about), and n-grams that it keeps.
SAMPLE = 640
GRAMS = 20_000
ORDERS = (1, 2, 3, 4)
PENALTY = 12.0
#: Share of a language's letters above which it is taken to use a script.
SCRIPT_SHARE = 0.01
#: Words whose scores a worker remembers; beyond that it starts anew.
REMEMBERED = 200_000
#: New words scored together.
TOGETHER = 10_000

#: Ranges of code points, and the script of each.
RANGES = [
    (0x0041, 0x024F, "latin"),
    (0x0370, 0x03FF, "greek"),
    (0x0400, 0x052F, "cyrillic"),
    (0x0530, 0x058F, "armenian"),
    (0x0590, 0x05FF, "hebrew"),
    (0x0600, 0x077F, "arabic"),
    (0x0900, 0x097F, "devanagari"),
    (0x0980, 0x09FF, "bengali"),
    (0x0B80, 0x0BFF, "tamil"),
    (0x0E00, 0x0E7F, "thai"),
    (0x10A0, 0x10FF, "georgian"),
    (0x1E00, 0x1EFF, "latin"),
    (0x1F00, 0x1FFF, "greek"),
    (0x3040, 0x309F, "hiragana"),
    (0x30A0, 0x30FF, "katakana"),
    (0x3400, 0x9FFF, "han"),
    (0xAC00, 0xD7AF, "hangul"),
]
_STARTS = np.array([a for a, _, _ in RANGES])
_WORD = regex.compile(r"\p{L}+")


def words_of(text: str) -> list[str]:
    """The words of a text, runs of letters, in lower case: as many as there are in the text itself.

    The one letter that becomes a letter and a mark of its own in lower case is taken without its dot.
    """
    return _WORD.findall(text.replace("İ", "i").lower())


def script_of(char: str) -> str:
    """Script of a letter; "other" outside the ranges."""
    code = ord(char)
    at = int(np.searchsorted(_STARTS, code, "right")) - 1
    return RANGES[at][2] if at >= 0 and code <= RANGES[at][1] else "other"


def grams(word: str) -> Iterator[str]:
    """n-grams of a word with marks at both ends."""
    marked = f"<{word}>"
    for n in ORDERS:
        for i in range(len(marked) - n + 1):
            yield marked[i : i + n]


@dataclass
class Model:
    """Log-probabilities of n-grams by language, and the languages that use each script."""

    langs: list[str]
    rows: dict[str, int]  # by n-gram: its row of the table
    table: np.ndarray  # log-probabilities; the last row is that of n-grams not known
    scripts: dict[str, np.ndarray]  # by script: which languages
    known: dict[str, int] = field(default_factory=dict, repr=False)
    scores: np.ndarray | None = field(default=None, repr=False)
    trie: tuple[np.ndarray, ...] | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "scores": None, "trie": None}

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Scores of words for each language; 50 below the best for those whose scripts a word isn't in."""
        rows, counts = self.gram_rows(words)
        total = np.add.reduceat(self.table[rows], np.r_[0, np.cumsum(counts)[:-1]], axis=0)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out = total / counts[:, None] * sizes[:, None]
        if all(users.all() for users in self.scripts.values()):
            return out
        # a row for each script, and one for the scripts that training hasn't met
        place = {script: i for i, script in enumerate(self.scripts)}
        users = np.array([*self.scripts.values(), np.ones(len(self.langs), bool)])
        letters, of = np.unique(np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4"), return_inverse=True)
        script = np.array([place.get(script_of(chr(c)), len(place)) for c in letters])
        allowed = np.logical_and.reduceat(users[script[of]], np.r_[0, np.cumsum(sizes)[:-1]], axis=0)
        allowed |= ~allowed.any(1, keepdims=True)
        return np.where(allowed, out, out.max(1, keepdims=True) - 50)

    def _trie(self) -> tuple[np.ndarray, ...]:
        """Known characters, steps between prefixes of n-grams (prefix and character as one key), where each leads, and rows."""
        if self.trie is None:
            chars = {c: i for i, c in enumerate(sorted({c for g in self.rows for c in g}))}
            nodes = {"": 0}
            for gram in self.rows:
                for n in range(1, len(gram) + 1):
                    nodes.setdefault(gram[:n], len(nodes))
            of = np.fromiter((self.rows.get(g, len(self.table) - 1) for g in nodes), np.int64, len(nodes))
            del nodes[""]
            keys = np.array([(nodes[g[:-1]] if g[1:] else 0) * len(chars) + chars[g[-1]] for g in nodes], np.int64)
            order = np.argsort(keys)
            codes = np.array([*map(ord, chars), 0x110000], np.int64)
            keys, to = np.r_[keys[order], np.iinfo(np.int64).max], np.r_[order + 1, 0]
            self.trie = codes, keys, to, of
        return self.trie

    def gram_rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the table for the n-grams of words, in the order of ``grams``, and how many each word has.

        All words are walked at once: step n goes from the first n - 1 characters of every place to n.
        """
        codes, keys, to, of = self._trie()
        code = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        word = np.repeat(np.arange(len(words)), sizes)
        within = np.arange(len(code)) - (np.cumsum(sizes) - sizes)[word]
        left = sizes[word] - within
        char = np.searchsorted(codes, code)
        char[codes[char] != code] = -1
        counts = sum(np.maximum(0, sizes - n + 1) for n in ORDERS)
        rows = np.full(int(counts.sum()), len(self.table) - 1)
        base = np.cumsum(counts) - counts
        at, node = np.arange(len(code)), np.zeros(len(code), np.int64)
        for n in range(1, max(ORDERS) + 1):
            on = left[at] >= n
            at, node = at[on], node[on]
            step = char[at + n - 1]
            on = step >= 0
            at, key = at[on], node[on] * (len(codes) - 1) + step[on]
            found = np.searchsorted(keys, key)
            on = keys[found] == key
            at, node = at[on], to[found[on]]
            if n in ORDERS:
                rows[base[word[at]] + within[at]] = of[node]
                base = base + np.maximum(0, sizes - n + 1)
        return rows, counts

    def lookup(self, words: list[str]) -> np.ndarray:
        """Row of ``scores`` for each word."""
        if self.scores is None or len(self.known) > REMEMBERED:
            self.known, self.scores = {}, np.zeros((0, len(self.langs)))
        new = list(set(words) - self.known.keys())
        if new:
            base = len(self.known)
            self.known.update(zip(new, range(base, base + len(new)), strict=True))
            parts = [self.word_scores(new[i : i + TOGETHER]) for i in range(0, len(new), TOGETHER)]
            self.scores = np.concatenate([self.scores, *parts])
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def label(self, texts: list[str], penalty: float) -> list[tuple[list[str], np.ndarray, np.ndarray]]:
        """Words of each text, the index of each word's language, and each word's scores."""
        split = [words_of(t) for t in texts]
        flat = [w for words in split for w in words]
        if not flat:
            return [([], np.zeros(0, np.int64), np.zeros((0, len(self.langs)))) for _ in texts]
        scores = self.scores_of(flat)
        out = []
        mixed = []
        start = 0
        for i, words in enumerate(split):
            here = scores[start : start + len(words)]
            start += len(words)
            top = int(here.sum(0).argmax()) if words else 0
            if len(self.langs) > 1 and words:
                gain = np.delete(here, top, 1).max(1) - here[:, top]
                reached = np.cumsum(gain)
                if (reached - np.minimum(0, np.minimum.accumulate(np.r_[0.0, reached[:-1]]))).max() > penalty:
                    mixed.append(i)
            out.append((words, np.full(len(words), top), here))
        if mixed:
            found = self._viterbi([out[i][2] for i in mixed], penalty)
            for i, labels in zip(mixed, found, strict=True):
                out[i] = (out[i][0], labels, out[i][2])
        return out

    def scores_of(self, words: list[str]) -> np.ndarray:
        rows = self.lookup(words)
        return self.scores[rows]

    def _viterbi(self, texts: list[np.ndarray], penalty: float) -> list[np.ndarray]:
        """Labels on the best path of each text, given as its words' scores."""
        scores = np.concatenate(texts)
        lengths = np.array([len(x) for x in texts])
        starts = np.r_[0, np.cumsum(lengths)[:-1]]
        order = np.argsort(-lengths, kind="stable")
        active = np.searchsorted(-lengths[order], -np.arange(lengths.max()), "left")  # texts with a word i
        first = starts[order]
        best = np.zeros((len(texts), len(self.langs)))
        came = np.zeros((len(scores), len(self.langs)), np.int16)
        stay = np.arange(len(self.langs), dtype=np.int16)
        for i, n in enumerate(active):
            here = best[:n]
            if i:
                top = here.argmax(1)
                switched = here[np.arange(n), top] - penalty
                moved = switched[:, None] > here
                came[first[:n] + i] = np.where(moved, top[:, None], stay)
                here = np.where(moved, switched[:, None], here)
            best[:n] = here + scores[first[:n] + i]
        labels = np.zeros(len(scores), np.int64)
        at = best.argmax(1)
        for i in range(len(active) - 1, -1, -1):
            n = active[i]
            places = first[:n] + i
            labels[places] = at[:n]
            at[:n] = came[places, at[:n]]
        return [labels[s : s + n] for s, n in zip(starts, lengths, strict=True)]


def _spans(text: str, labels: np.ndarray, langs: list[str]) -> list[dict]:
    out: list[dict] = []
    for found, label in zip(_WORD.finditer(text), labels, strict=False):
        if out and out[-1]["lang"] == langs[label]:
            out[-1]["stop"] = found.end()
        else:
            out.append({"start": found.start(), "stop": found.end(), "lang": langs[label]})
    return out


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """A model from about ``sample`` documents of each non-null language at most, chosen by a hash of ``key``.

    Without labelled rows the model has no languages and ``identify`` says "und" throughout. At most GRAMS n-grams of a language and one count of each script come to the driver.
    """
    spark = labelled.sparkSession
    ship(spark)
    usable = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    chosen = within(durable(bounded_sample(usable, key, [lang], sample).select(key).distinct()), F.lit(16))
    # one text for each chosen id and language, however many rows share them
    texts = usable.join(chosen, key, "left_semi").groupBy(key, F.col(lang).alias("lang")).agg(F.min(text).alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter = Counter()

        def flush() -> pd.DataFrame:
            counts: Counter = Counter()
            for (of, word), n in words.items():
                for gram in grams(word):
                    counts[of, "g", gram] += n
                for char in word:
                    counts[of, "s", script_of(char)] += n
            words.clear()
            return pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["lang", "kind", "what", "n"])

        for batch in batches:
            for of, value in zip(batch["lang"], batch["text"], strict=True):
                words.update((of, w) for w in words_of(value))
                if len(words) > 100_000:
                    yield flush()
        yield flush()

    counts = texts.mapInPandas(count, "lang string, kind string, what string, n long").groupBy("lang", "kind", "what").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "what")
    rows = counts.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= GRAMS).collect()
    langs = sorted({r.lang for r in rows})
    place = {of: i for i, of in enumerate(langs)}
    table: dict[str, np.ndarray] = {}
    script: dict[str, np.ndarray] = {}
    for r in rows:
        into = table if r.kind == "g" else script
        into.setdefault(r.what, np.zeros(len(langs)))[place[r.lang]] = r.n
    totals = sum(table.values(), np.zeros(len(langs))) + 0.5 * (len(table) + 1)
    letters = sum(script.values(), np.zeros(len(langs)))
    known = sorted(table)
    logs = np.log((np.array([table[g] for g in known]).reshape(len(known), len(langs)) + 0.5) / totals)
    used = {s: n >= SCRIPT_SHARE * np.maximum(letters, 1) for s, n in script.items()}
    return Model(langs, {g: i for i, g in enumerate(known)}, np.vstack([logs, np.log(0.5 / totals).reshape(1, -1)]), {s: u for s, u in used.items() if u.any()})


def predict(text: Column, model: Model, spark, penalty: float = PENALTY, with_spans: bool = True) -> Column:
    """Struct of lang_pred, score and, if asked for, spans (start, stop in code points, lang) of a text.

    ``lang_pred`` is the language of most letters (the first in order on a tie), ``score`` those letters'
    share times how surely they are that language's. Null, and text without a letter, gives "und" and 0.
    """
    shared = spark.sparkContext.broadcast(model)
    schema = "lang_pred string, score double" + ", spans array<struct<start:int,stop:int,lang:string>>" * with_spans

    @F.pandas_udf(schema)
    def found(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        langs = m.langs
        values = [t or "" for t in texts]
        out = []
        for start, stop in slices([len(v) for v in values]):
            part = values[start:stop]
            for value, (words, labels, scores) in zip(part, m.label(part, penalty) if langs else [([], None, None)] * len(part), strict=True):
                if not words:
                    out.append(("und", 0.0, []))
                    continue
                sizes = np.fromiter(map(len, words), np.int64, len(words))
                letters = np.bincount(labels, sizes, len(langs))
                top = int(letters.argmax())
                mine = scores[labels == top]
                if len(langs) > 1:
                    rival = np.delete(mine, top, 1).max(1)
                    sure = 1 / (1 + np.exp(-min(30.0, float((mine[:, top] - rival).sum()))))
                else:
                    sure = 1.0
                share = float(letters[top] / letters.sum())
                out.append((langs[top], share * float(sure), _spans(value, labels, langs) if with_spans else None))
        frame = pd.DataFrame(out, columns=["lang_pred", "score", "spans"])
        return frame if with_spans else frame.drop(columns="spans")

    return found(text)


def identify(df: DataFrame, model: Model, text: str = "text", penalty: float = PENALTY, with_spans: bool = True) -> DataFrame:
    """``df`` with lang_pred, score and spans. Repeated rows and null ids are labelled like any others; an
    empty table stays empty; very long texts are labelled whole; existing columns of these names are replaced."""
    ship(df.sparkSession)
    names = ["lang_pred", "score"] + ["spans"] * with_spans
    at = unused("found", df)
    out = df.withColumn(at, predict(F.col(text), model, df.sparkSession, penalty, with_spans))
    return out.withColumns({n: F.col(at)[n] for n in names}).drop(at)
