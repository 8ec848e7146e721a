"""The Merkle manifest against a plain tree."""

import hashlib
import zlib

from lodestone.llm import merkle_manifest
from pyspark.sql import functions as F
from tests.llm.plain import LOWER


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, text):
    return digest(*map(field, (row.doc_id, row.source, row.lang, row.n_chars, text)))


def tree(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def steps(levels, i):
    for level in levels[:-1]:
        at = i // 16 * 16
        yield "".join(level[at:i]), "".join(level[i + 1 : at + 16])
        i //= 16


def plain(rows):
    sources = sorted({r.source for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    of = {s: sorted((r for r in rows if r.source == s), key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text))) for s in sources}
    trees = {s: tree([leaf(r, r.text) for r in of[s]]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for j, s in enumerate(sources):
        for i, r in enumerate(of[s]):
            path = [*steps(trees[s], i), *steps(top, j)]
            changed = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.text is not None
            node = leaf(r, r.text.translate(LOWER) if changed else r.text)
            for before, behind in path:
                node = digest(before, node, behind)
            out.append((r.doc_id, leaf(r, r.text), trees[s][-1][0], top[-1][0], digest(*(a + b for a, b in path)), node, node == top[-1][0]))
    return sorted(out, key=str)


def made(docs):
    return sorted(map(tuple, merkle_manifest.manifest(docs).collect()), key=str)


def test_against_a_plain_tree(spark):
    rows = [(i, f"Text {i} " + "x" * (i % 7), "en", "hot", i) for i in range(300)]
    rows += [(1, "Same", None, None, None)] * 20 + [(None, "A", "fr", "hot", 1), (None, None, None, None, None), (5, None, "en", "", 3), (6, "", "en", "é", 0), (7, "Long " * 100_000, "en", "lone", 9)]
    rows += [(i, "Ab", "en", f"s{i}", 2) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = plain(docs.collect())
    assert any(not r[-1] for r in want) and any(r[-1] for r in want)
    clash = docs.withColumns({c: F.lit(1) for c in ("s", "h", "t", "i", "n", "p", "kids", "path", "leaf", "_at", "_range")})
    assert made(clash) == want


def test_small_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    assert made(spark.createDataFrame([], schema)) == []
    for n in (1, 2, 16, 17):
        docs = spark.createDataFrame([(i, f"T{i}", "en", "a", 2) for i in range(n)], schema)
        assert made(docs) == plain(docs.collect())
