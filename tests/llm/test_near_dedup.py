"""Near-duplicates against all pairs, in blocks of any size, and the hashes they are found by."""

import random

import numpy as np
from lodestone.llm import near_dedup
from pyspark.sql import functions as F
from tests.llm.plain import LOWER


def sets(text):
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in (text or "").translate(LOWER)).split(" ") if w]
    return {tuple(words[i : i + 2]) for i in range(max(1, len(words) - 1))} if words else set()


def plain(rows):
    of = [sets(t) if i is not None else set() for i, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(of):
        for j in range(i):
            if a and of[j] and 100 * len(a & of[j]) >= 80 * len(a | of[j]):
                root[top(i)] = top(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[top(i)] = min(k, least.get(top(i), k))
    return sorted(((k, len(sets(t)), least.get(top(i)) if k is not None else None, k is not None and least[top(i)] == k) for i, (k, t) in enumerate(rows)), key=str)


def made(docs):
    return sorted(map(tuple, near_dedup.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def drifting(rng, n, at, changes):
    """A group of copies, each with some changed words, so that not all are linked to the first."""
    base = [f"t{i}" for i in range(60)]
    for i in range(n):
        words = list(base)
        for _ in range(rng.randint(0, changes)):
            words[rng.randrange(60)] = f"n{rng.randrange(10**6)}"
        yield at + i, " ".join(words)


def test_against_all_pairs(spark, monkeypatch):
    rng = random.Random(7)
    rows = [*drifting(rng, 40, 1000, 5), *drifting(rng, 30, 100, 8)]
    same = " ".join(f"w{i}" for i in range(30))
    rows += [(5, same), (9, same.upper()), (9, same), (None, same), (3, None), (4, ""), (6, " \t\n"), (7, "One"), (8, "one"), (12, "one two"), (13, "é è"), (14, "É è"), (15, "long text " * 200_000), (16, "text long " * 200_000)]
    rows += [(20, "a b c d e f"), (21, "a b c d e g"), (22, "a b c d e f a b"), (23, "x\x1cy z"), (24, "x\x1cy z")]
    rows += [(30, "a b c d e f g h i j"), (31, "a b c d e f g h i k"), (40, " ".join(f"q{i}" for i in range(10))), (41, " ".join(f"q{i}" for i in range(9)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("node", "g", "root", "rep", "t", "kept", "key", "band")})
    want = plain(rows)
    assert made(docs) == want
    for name, value in (("GROUP_BLOCK", 7), ("CLUSTER_BLOCK", 9), ("SHINGLE_BLOCK", 900)):
        monkeypatch.setattr(near_dedup, name, value)
    assert made(docs) == want
    assert made(docs.limit(0)) == []
    assert made(docs.filter("doc_id = 7 OR doc_id = 3")) == [(3, 0, 3, True), (7, 1, 7, True)]


def test_hashes_depend_on_the_word_alone(monkeypatch):
    """Also for words that are equal modulo powers of two of a polynomial, and cut texts."""
    thue = "a"
    for _ in range(11):
        thue += thue.translate(str.maketrans("ab", "ba"))
    words = ["a", "b", "ab", "ba", "\x00", "\x00\x00", "é", thue, thue.translate(str.maketrans("ab", "ba")), "word"]
    alone = [near_dedup.word_hashes([w])[0][0] for w in words]
    assert len(set(alone)) == len(words)
    monkeypatch.setattr(near_dedup, "SLICE_CHARS", 3)
    hashes, counts = near_dedup.word_hashes([" ".join(words), "", " word  a "])
    assert (hashes.tolist(), counts.tolist()) == ([*alone, alone[-1], alone[0]], [len(words), 0, 2])


def test_signatures_estimate_the_similarity():
    a, b = " ".join(f"w{i}" for i in range(1001)), " ".join(f"w{i}" for i in range(112, 1113))
    minima = [np.frombuffer(x, np.uint8) for x in near_dedup.signatures([a, b])["minima"]]
    assert abs((minima[0] == minima[1]).mean() - 888 / 1112) < 0.15
    assert 40 < near_dedup.fewest_matches() < 75
