"""The queries of the subpackage: against SQL where there is some, else against libraries and labels."""

import hashlib
import html
import re

import pytest

from lodestone.llm import queries as q
from lodestone.llm.common import tokenizer_path
from tests.oracle import duck, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


@pytest.fixture(scope="module")
def texts(connection):
    return dict(connection.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_against_sql(spark, connection, name):
    same(q.QUERIES[name](spark, SF), connection, q.ORACLE_SQL[name])


def test_html(spark):
    """The tables' pages mark their article with a tag, so a plain cut of it is the whole truth."""
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = q.op1_html_extraction(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inside = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        blocks = re.split(r"</?(?:h1|p)>", re.sub(r"</?b>", "", inside.replace("<br>", " ")))
        want = [" ".join(html.unescape(b).split()) for b in blocks]
        assert r.text == "\n".join(b for b in want if b)
        assert r.n_chars == len(r.text)


def test_language(spark):
    sf = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = q.op2_language_id(spark, sf).collect()
    assert len(rows) == len(langs)
    held = [r for r in rows if r.held_out and langs[r.doc_id]]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_codec_is_the_library_s(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    for r in q.op6_bpe_codec(spark, SF).collect():
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_counts_are_the_library_s(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    for r in q.op10_token_counts(spark, SF).collect():
        n = len(t.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 1024)


def test_shards(spark, texts):
    import zlib

    rows = q.op8_sharding(spark, SF).collect()
    assert {r.doc_id for r in rows} == texts.keys()
    sizes = {}
    for r in rows:
        sizes.setdefault(r.shard, []).append(r.slot)
        assert (r.size, r.text_crc32, r.law) == (len(texts[r.doc_id].encode()) + 1, zlib.crc32(texts[r.doc_id].encode()), "rows")
    assert sorted(sizes) == list(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values())
    assert max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.slot, r.shard))]
    assert order != sorted(order)
    assert [tuple(r) for r in sorted(rows)] == [tuple(r) for r in sorted(q.op8_sharding(spark, SF).collect())]


def test_toxicity_has_all_rows(spark, texts):
    rows = q.op9_toxicity(spark, SF).collect()
    assert {r.doc_id for r in rows} == texts.keys()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_toxicity_of_held_out_rows(spark):
    """The labels are noisy: some toxic ones mark texts that have nothing of the kind."""
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(labels[r.doc_id], r.predicted) for r in q.op9_toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels]
    toxic = [p for y, p in held if y]
    clean = [p for y, p in held if not y]
    assert len(toxic) > 50 and sum(toxic) >= 0.85 * len(toxic)
    assert sum(clean) <= 0.05 * len(clean)
