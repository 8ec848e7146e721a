"""Collocations against plain counting, and blocks that cut texts anywhere."""

import collections
import random
import re

import numpy as np
from lodestone.llm import collocations
from pyspark.sql import functions as F
from tests.llm.plain import LOWER


def pieces(text):
    return [re.findall(r"[^ \t]+", p) for p in re.split(r"[.,;:!?\n\v\f\r]", (text or "").translate(LOWER))]


def plain(rows, least, top):
    out = []
    for lang in {lang or "und" for lang, _ in rows}:
        f, n = collections.Counter(), 0
        for words in (w for of, text in rows if (of or "und") == lang for w in pieces(text)):
            n += len(words)
            for k in (1, 2, 3, 4):
                f.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {d[i:j] for d, b in found.items() for i in range(len(d)) for j in range(i + 2, len(d) + 1) if j - i < len(d) and 100 * b >= 80 * found[d[i:j]]}
        ranked = []
        for p, a in found.items():
            if p not in gone:
                score, cut = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        out += [(lang, i, p.decode(), -a, l, r, n, -score) for i, (score, a, p, l, r) in enumerate(sorted(ranked)[:top], 1)]
    return sorted(out)


def made(docs, **more):
    got = collocations.collocations(docs, **more).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    return sorted(map(tuple, got.collect()))


def test_against_plain_counting(spark):
    rng = random.Random(3)
    vocabulary = ["the", "The", "of", "été", "\x1c", "x y", "a", "b", "<", "\U0001f600"]
    rows = [(rng.choice(["en", "fr", None, "und"]), "".join(rng.choice(vocabulary) + rng.choice([" ", "\t", "  ", ". ", "\n", ","] if rng.random() < 0.3 else [" "]) for _ in range(rng.randint(0, 60)))) for _ in range(80)]
    rows += [("en", None), (None, None), ("en", ""), ("de", "only once here"), ("en", "a a a a a a a"), ("en", "deep sea fish tank. " * 400)] + [("fr", "same text again")] * 5
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit(1) for c in ("block", "w", "word", "n", "at", "id", "a", "b", "f", "k", "rank")})
    for least, top, block in ((3, 7, 50), (2, 1000, 10**6)):
        assert made(docs, least=least, top=top, block=block) == plain(rows, least, top)
    assert made(docs.limit(0)) == []


def test_no_phrases_at_all(spark):
    assert made(spark.createDataFrame([("en", "a b c"), ("fr", None)], "lang string, text string")) == []


def test_a_text_goes_on_in_the_next_block(monkeypatch):
    """What starts in a block is counted there, whatever it is cut from."""
    rng = random.Random(5)
    for size in (1, 7, 40):
        monkeypatch.setattr(collocations, "SLICE", size)
        text = "".join(rng.choice(["a", "bb", "ccc", "é"]) + rng.choice([" ", " ", " ", ".", "\t"]) for _ in range(300))
        found = collections.Counter()
        for batch in collocations.blocks(iter([("en", text), ("en", "a bb")]), 9, most=11):
            *rows, whole = batch.to_pylist()
            positions, sizes = collocations.unpacked(whole["lists"])
            lists = dict(zip((r["word"] for r in rows), np.split(positions, np.cumsum(sizes)[:-1]), strict=True))
            assert [r["w"] for r in rows] == list(range(len(rows)))
            at = {int(p): word for word, of in lists.items() for p in of}
            assert all(sum(p < collocations.END for p in lists[r["word"]]) == r["n"] for r in rows)
            for k in (1, 2, 3, 4):
                found.update(tuple(at[p + i] for i in range(k)) for p in at if p < collocations.END and all(p + i in at for i in range(k)))
        want = collections.Counter(tuple(w[i : i + k]) for w in [*pieces(text), ["a", "bb"]] for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
        assert found == want
