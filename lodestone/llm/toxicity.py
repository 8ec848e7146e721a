"""Toxicity by weak supervision.

Voters. Given lexicons hold ordinary insults, contempt and threats of four languages and come from no label.
Learned lexicons hold terms (whole words, and beginnings of words) that labelled documents suggest; a labelled
document is voted on with the terms that the other folds of documents suggest, so no voter has seen the label
of what it votes on. Counting voters look at how many words have terms, pattern voters at how a text is
written. The given label is one more voter. A voter that has nothing to say abstains.

Label model. The votes of the sample are explained by one hidden label. Expectation maximisation, started
from the majority of the votes, finds for each voter how often it votes toxic, clean or not at all under
either label; nothing is fixed beforehand, the given label's accuracy included. Voters whose votes stay
correlated given the label share one say, by the size of their group. The posterior is the label that the
classifier is trained on.

Classifier. A logistic regression over the terms and voters of a text, fitted to the posteriors.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bounded_sample, durable, ship, within

#: Labelled documents of either label that the models are fitted on, at most (about).
SAMPLE = 4_000
#: Terms, at most; documents that a term must be in; sizes of the beginnings of words.
TERMS = 600
LEAST_DOCS = 3
#: How much (in nats) the documents of a term must speak against chance; terms number tens of thousands.
SURPRISE = 8.0
HEADS = (4, 5, 6)
#: Words whose terms a worker remembers; beyond that it starts anew.
REMEMBERED = 120_000
#: Parts of the labelled documents; each is voted on with terms of the others.
FOLDS = 4

#: Words of the given lexicons, by kind.
GIVEN = {
    "insult": """idiot idiots moron morons imbecile cretin dimwit halfwit fool fools dunce loser losers clown scum jerk creep bastard
        dummkopf trottel depp vollidiot versager abschaum connard crétin débile abruti imbécile tonto estúpido imbécil cretino payaso""",
    "contempt": """stupid dumb pathetic worthless useless disgusting vile filthy garbage trash ridiculous
        dumm erbärmlich wertlos widerlich nutzlos stupide pathétique minable dégoûtant inútil patético asqueroso basura""",
    "threat": """kill die destroy hate shut hang töten hasse verrecke tuer crève déteste matar odio muere""",
}

_WORD = re.compile(r"[^\W\d_]{2,}")
_PATTERNS = [
    re.compile(r"\b(?:[A-Z]{4,}\W+){4}"),  # shouting
    re.compile(r"[!?]{3,}"),
    re.compile(r"\b(?:you|tu|du|vous|ihr|usted)\b\W+(?:are|es|bist|êtes|seid)\b", re.I),  # addressing someone
]


def candidates(word: str) -> list[str]:
    """The terms a word could stand for: itself, marked at both ends, and its beginnings, at one."""
    return [f"^{word}$"] + [f"^{word[:n]}" for n in HEADS if len(word) >= n]


def choose_terms(with_term: dict[str, tuple[int, int]], toxic: int, clean: int) -> list[tuple[str, float]]:
    """Terms and their log-odds, strongest first: those that far more toxic than clean documents have.

    A term that a stronger, shorter one covers in the same documents is left out.
    """
    found = []
    for term, (t, c) in with_term.items():
        if t < LEAST_DOCS:
            continue
        odds = np.log((t + 0.1) / (toxic + 0.2)) - np.log((c + 0.1) / (clean + 0.2))
        # how unlikely so many toxic ones are if the term said nothing
        rate = toxic / max(1, toxic + clean)
        surprise = t * np.log(max(t / (t + c), 1e-9) / rate) + (c * np.log(max(c / (t + c), 1e-9) / (1 - rate)) if c else 0)
        if odds > 1.5 and t / (t + c) > 0.5 and surprise > SURPRISE:
            found.append((-surprise, len(term), term, float(odds)))
    found.sort()
    return [(term, odds) for _, _, term, odds in found[:TERMS]]


def _given() -> list[frozenset[str]]:
    return [frozenset(words.split()) for words in GIVEN.values()]


@dataclass
class Model:
    terms: dict[str, int]  # place of each
    whole: np.ndarray  # of each term: whether it is a whole word
    folds: np.ndarray  # by term and fold: whether the documents outside the fold suggest it
    exempt: frozenset[str]  # words that a beginning would take for toxic though clean texts have them
    weights: np.ndarray  # terms, then votes, then counts, then bias
    accuracies: dict[str, tuple[float, float]]
    correlated: list[tuple[str, str]]
    known: dict[str, tuple[tuple[int, ...], int]] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def present(self, text: str) -> tuple[dict[tuple[int, ...], int], int, int]:
        """The terms of words that have any, with how often, the given lexicons met as bits, and how many words there are."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        words = _WORD.findall(text.lower())
        found: dict[tuple[int, ...], int] = {}
        given = 0
        for word in words:
            got = known.get(word)
            if got is None:
                places = () if word in self.exempt else tuple(self.terms[c] for c in candidates(word) if c in self.terms)
                got = known[word] = places, sum(1 << i for i, lexicon in enumerate(_GIVEN) if word in lexicon)
            if got[0]:
                found[got[0]] = found.get(got[0], 0) + 1
            given |= got[1]
        return found, given, len(words)

    def features(self, text: str, fold: int | None = None) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Places of a text's terms, votes and counts; with ``fold`` only terms that other folds suggest."""
        found, given, words = self.present(text)
        if fold is not None:
            found = {kept: n for places, n in found.items() if (kept := tuple(p for p in places if self.folds[p, fold]))}
        terms = sorted({p for places in found for p in places})
        hits = sum(found.values())
        return terms, votes(text, terms, hits, self.whole, given), counts_of(hits, words)

    def score(self, text: str) -> float:
        terms, voted, counts = self.features(text)
        n, m = len(self.terms), len(voted)
        z = self.weights[terms].sum() + self.weights[n : n + m] @ voted + self.weights[n + m : -1] @ counts + self.weights[-1]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


_GIVEN = _given()
VOTERS = ["learned words", "learned beginnings", *(f"given {k}" for k in GIVEN), "under 2 words", "2 words", "3 words", "no word", *(f"pattern {i}" for i in range(len(_PATTERNS)))]


def votes(text: str, terms: list[int], hits: int, whole: np.ndarray, given: int) -> np.ndarray:
    """1 toxic, -1 clean, 0 no vote, in the order of VOTERS."""
    kinds = whole[terms]
    return np.array(
        [
            int(kinds.any()),
            int((~kinds).any()),
            *(given >> i & 1 for i in range(len(_GIVEN))),
            -1 if hits < 2 else 0,
            int(hits > 1),
            int(hits > 2),
            0 if hits else -1,
            *(int(bool(pattern.search(text))) for pattern in _PATTERNS),
        ],
        np.int8,
    )


def counts_of(hits: int, words: int) -> np.ndarray:
    return np.array([np.log1p(hits), min(1.0, 20 * hits / max(words, 1))])


def label_model(voted: np.ndarray, prior: float, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors, the probability of each vote under either label, and correlations given the label.

    ``voted`` has a row for each text and a column for each voter. It starts from the majority of the votes
    and takes toxic ones to be ``prior`` of all at first; columns whose votes go together beyond the label
    are correlated.
    """
    n, m = voted.shape
    post = np.where(voted.sum(1) > 0, 0.95, 0.05)
    kinds = [(voted == v).astype(float) for v in (-1, 0, 1)]
    say = np.ones(m)
    rho = np.zeros((m, m))
    chance = np.zeros((2, 3, m))
    for i in range(rounds):
        for label, weight in ((0, 1 - post), (1, post)):
            for k, has in enumerate(kinds):
                chance[label, k] = (weight @ has + 1) / (weight.sum() + 3)
        chance = np.maximum(chance, 1e-6)
        if i == 5:  # the hidden label has settled enough to tell what it leaves unexplained
            expected = np.outer(post, chance[1, 2] - chance[1, 0]) + np.outer(1 - post, chance[0, 2] - chance[0, 0])
            rest = voted - expected
            spread = rest.std(0) + 1e-9
            rho = (rest.T @ rest) / n / np.outer(spread, spread)
            tied = np.abs(rho) > 0.5
            np.fill_diagonal(tied, True)
            say = 1 / tied.sum(1)
        z = np.full(n, np.log(prior / (1 - prior)))
        for k, has in enumerate(kinds):
            z += has @ (say * (np.log(chance[1, k]) - np.log(chance[0, k])))
        post = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return post, chance, rho


def fit_linear(x: np.ndarray, target: np.ndarray, steps: int = 1500, rate: float = 1.0, ridge: float = 1e-4) -> np.ndarray:
    """Weights and bias of a logistic regression on soft targets, by accelerated gradient descent."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weights, momentum = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    scale = rate * 4 / max(1e-9, (x**2).sum(1).max())
    for _ in range(steps):
        ahead = weights + 0.9 * momentum
        slope = x.T @ (1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30))) - target) / len(x)
        slope[:-1] += ridge * ahead[:-1]
        momentum = 0.9 * momentum - scale * slope
        weights = weights + momentum
    return weights


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from about ``sample`` labelled documents of each label at most, chosen by a hash of ``key``.

    Their term counts are made on the workers; terms, and then the sample's votes and terms, come to the
    driver: about ``2 * sample`` short rows at most, whatever the size of the input. Without labelled
    documents of both labels the given lexicons and patterns decide alone, with equal say.
    """
    spark = docs.sparkSession
    ship(spark)
    marked = labels.filter(F.col(toxic).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max(toxic).cast("int").alias("_toxic"))
    chosen = within(durable(bounded_sample(marked, key, ["_toxic"], sample)), F.lit(24))
    picked = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("text")).join(chosen.withColumnRenamed(key, "_key"), "_key")
    # one text of each id, kept: it is read four times
    fold = F.pmod(F.xxhash64("_key", F.lit(5)), F.lit(FOLDS)).cast("int")
    rows = durable(picked.groupBy("_key", "_toxic").agg(F.min("text").alias("text")).select("text", "_toxic", fold.alias("_fold")))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[tuple[int, int], Counter] = {}
        for batch in batches:
            for value, label, part in zip(batch["text"], batch["_toxic"], batch["_fold"], strict=True):
                found: set[str] = {""}
                for word in set(_WORD.findall((value or "").lower())):
                    found.update(candidates(word))
                counts.setdefault((part, label), Counter()).update(found)
        for (part, label), of in counts.items():
            yield pd.DataFrame({"term": list(of), "fold": part, "label": label, "n": list(of.values())}).astype({"fold": "int32", "label": "int32"})

    each = [F.sum(F.when((F.col("fold") == f) & (F.col("label") == y), F.col("n")).otherwise(0)).alias(f"n{f}_{y}") for f in range(FOLDS) for y in (0, 1)]
    tallies = rows.mapInPandas(count, "term string, fold int, label int, n long").groupBy("term").agg(*each)
    toxic_n, clean_n = (sum(F.col(f"n{f}_{y}") for f in range(FOLDS)) for y in (1, 0))
    tallies = durable(tallies.withColumns({"toxic": toxic_n, "clean": clean_n}).filter((F.col("term") == "") | (F.col("toxic") >= LEAST_DOCS) | (F.col("clean") >= 2)))
    whole = tallies.filter("term = ''").collect()
    n_toxic, n_clean = (whole[0].toxic, whole[0].clean) if whole else (0, 0)
    worth = (F.col("toxic") >= LEAST_DOCS) & (F.col("toxic") * max(n_clean, 1) > F.col("clean") * max(n_toxic, 1)) & (F.col("term") != "")
    top = tallies.filter(worth & (F.col("toxic") > F.col("clean"))).orderBy(F.desc(F.col("toxic") - F.col("clean")), "term").limit(20 * TERMS).collect() if n_toxic and n_clean else []
    terms = choose_terms({r.term: (r.toxic, r.clean) for r in top}, n_toxic, n_clean)
    place = {t: i for i, (t, _) in enumerate(terms)}
    folds = np.zeros((len(terms), FOLDS), bool)
    by_term = {r.term: r for r in top}
    for f in range(FOLDS):
        rest = {t: (r.toxic - r[f"n{f}_1"], r.clean - r[f"n{f}_0"]) for t in place for r in (by_term[t],)}
        for t, _ in choose_terms(rest, n_toxic - whole[0][f"n{f}_1"], n_clean - whole[0][f"n{f}_0"]) if terms else ():
            folds[place[t], f] = True
    # clean texts' own words under a chosen beginning: at most TERMS of each beginning's size
    exempt: set[str] = set()
    for n in HEADS:
        heads = [t for t in place if len(t) == n + 1 and not t.endswith("$")]
        if heads:
            natural = F.col("term").endswith("$") & (F.col("clean") >= 2) & (F.col("clean") * n_toxic > F.col("toxic") * n_clean)
            rows_of = tallies.filter(natural & F.substring("term", 1, n + 1).isin(heads)).orderBy(F.desc("clean"), "term").limit(TERMS).collect()
            exempt |= {r.term[1:-1] for r in rows_of}
    whole_word = np.array([t.endswith("$") for t, _ in terms], bool)
    draft = Model(place, whole_word, folds, frozenset(exempt), np.zeros(1), {}, [])
    m = len(VOTERS)
    if not n_toxic or not n_clean:
        given = np.array([2.0 if v.startswith("given") else 0.0 for v in VOTERS])
        return Model(place, whole_word, folds, frozenset(exempt), np.r_[np.zeros(len(terms)), given, 0, 0, -3.0], {}, [])
    shared = spark.sparkContext.broadcast(draft)

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            out = []
            for value, label, part in zip(batch["text"], batch["_toxic"], batch["_fold"], strict=True):
                found, voted, counts = model.features(value or "", part)
                out.append((found, voted.tolist(), counts.tolist(), label))
            yield pd.DataFrame(out, columns=["terms", "votes", "counts", "label"])

    got = rows.mapInPandas(vote, "terms array<int>, votes array<int>, counts array<double>, label int").collect()
    got.sort(key=lambda r: (r.label, r.terms, r.votes, r.counts))
    voted = np.array([[*r.votes, 1 if r.label else -1] for r in got], np.int8)
    post, chance, rho = label_model(voted, n_toxic / (n_toxic + n_clean))
    x = np.zeros((len(got), len(terms)))
    for i, r in enumerate(got):
        x[i, list(r.terms)] = 1
    weights = fit_linear(np.hstack([x, voted[:, :m], np.array([r.counts for r in got])]), post)
    names = [*VOTERS, "label"]
    accuracy = {n: (round(float(chance[1, 2, i]), 4), round(float(chance[0, 2, i]), 4)) for i, n in enumerate(names)}
    tied = [(names[i], names[j]) for i in range(len(names)) for j in range(i) if abs(rho[i, j]) > 0.5]
    return Model(place, whole_word, folds, frozenset(exempt), weights, accuracy, tied)


def toxicity(text: Column, model: Model, spark) -> Column:
    """Probability that a text is toxic; that of an empty text for null."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series([m.score(t or "") for t in texts], dtype="float64")

    return scored(text)


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with score and predicted. Null and empty texts score as texts without terms; very long texts
    are read whole; repeated rows and null ids are scored like any others; an empty table stays empty;
    existing columns of these names are replaced."""
    ship(df.sparkSession)
    out = df.withColumn("score", toxicity(F.col(text), model, df.sparkSession))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
