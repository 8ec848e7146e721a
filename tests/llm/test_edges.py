"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from lodestone.llm import bpe_codec, chat_format, components, decontamination, html_extract, language_id, ngram_join, quality_rules, sharding, token_counts, toxicity
from lodestone.llm.common import tokenizer_path

LONG = "lorem ipsum dolor " * 20_000
WORDS = " ".join(f"word{i}" for i in range(60))
NEAR = WORDS.replace("word3 ", "other ")
DOCS = [(1, WORDS, "h"), (2, WORDS, "h"), (2, WORDS, "h"), (3, NEAR, None), (4, None, "h"), (5, "", "h"), (None, WORDS, None), (6, LONG, "h"), (7, " .. ", "h")]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(DOCS, "doc_id long, text string, source string")
    return frame.withColumns({c: F.lit(9) for c in ("n_tokens", "kept", "score", "size", "shard", "n_words", "_n", "lang_pred")})


def test_token_counts(docs):
    got = {r.doc_id: r for r in token_counts.count_tokens(docs, tokenizer_path("byte_bpe_50k.json")).collect()}
    assert (got[4].n_tokens, got[5].n_tokens, got[6].over_limit) == (0, 0, True)
    assert token_counts.count_tokens(docs.limit(0), tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_codec(docs):
    got = {r.doc_id: r for r in bpe_codec.encode_decode(docs, tokenizer_path("word_bpe_49k.json")).collect()}
    assert (got[4].bpe.ids, got[4].bpe.decoded) == ([], "")
    assert got[6].bpe.n_tokens > 60_000
    assert bpe_codec.digests(docs.limit(0), tokenizer_path("word_bpe_49k.json")).count() == 0


def test_join(docs):
    rows = sorted((r.doc_id or 0, r.class_id, r.n_links) for r in ngram_join.similar(docs).collect())
    assert rows == [(0, None, 0), (1, 1, 3), (2, 1, 3), (2, 1, 3), (3, 1, 3), (4, 4, 0), (5, 5, 0), (6, 6, 0), (7, 7, 0)]
    assert ngram_join.similar(docs.limit(0)).count() == 0


def test_join_in_blocks(spark, monkeypatch):
    """A group that is far larger than its blocks, against all pairs."""
    import random

    rng = random.Random(2)
    base = [f"t{i}" for i in range(80)]
    texts = []
    for _ in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(80)] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    for name, value in (("GROUP_BLOCK", 7), ("CLUSTER_BLOCK", 9), ("PAIRS", 50)):
        monkeypatch.setattr(ngram_join, name, value)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(76)} for t in texts]
    got = {r.doc_id: r for r in ngram_join.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, a in enumerate(sets):
        linked = [j for j, b in enumerate(sets) if i != j and len(a & b) >= 0.8 * len(a | b)]
        assert got[i].n_links == len(linked)
        assert all(got[j].class_id == got[i].class_id for j in linked)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


@pytest.mark.parametrize("salted", [False, True])
def test_components_of_hot_nodes(spark, monkeypatch, salted):
    """A star's edges are met by its minimum, sent everywhere or in parts."""
    monkeypatch.setattr(components, "HOT", 5)
    if salted:
        monkeypatch.setattr(components, "within", lambda df, size: df)
    edges = [(3, i) for i in range(10, 60)] + [(59, 61), (61, 62)] + [(200 + i, 300) for i in range(30)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 3 for i in (3, *range(10, 60), 61, 62)} | {i: 200 for i in (*range(200, 230), 300)}


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(1, WORDS), (2, None), (3, "lorem"), (None, "word5 word6"), (1, "nothing here")], "item_id long, text string")
    whole = sorted(map(tuple, decontamination.decontaminate(docs, bench).select("doc_id", "n_words", "n_hit", "hit_items", "contaminated").collect()), key=str)
    parts = sorted(map(tuple, decontamination.decontaminate(docs, bench, block_bytes=40).select("doc_id", "n_words", "n_hit", "hit_items", "contaminated").collect()), key=str)
    assert whole == parts
    by = {r[0]: r for r in whole}
    assert by[1] == (1, 60, 60, ["", "1"], True)
    assert by[4] == (4, 0, 0, [], False)
    assert by[6][2:] == (20_000, ["3"], True)
    assert decontamination.decontaminate(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_quality(spark, docs):
    got = {r.doc_id: r for r in quality_rules.quality(docs).collect()}
    assert got[4].base_failed and got[5].base_failed and got[6].base_failed
    assert got[1].kept and got[2].kept and got[3].kept
    lines = [(i, f"common line of the host\nown {i}\n" + "common line of the host\n" * 20, "h") for i in range(12)]
    many = spark.createDataFrame([(i, t + " " + " ".join(f"x{i}q{j}" for j in range(40)), s) for i, t, s in lines], "doc_id long, text string, source string")
    judged = quality_rules.quality(many, line_floor=10, least_left=0.5).collect()
    assert all(r.removed_words == 105 and r.depleted and not r.kept for r in judged)
    assert not any(r.depleted for r in quality_rules.quality(many, line_floor=12, least_left=0.5).collect())
    assert all(r.cleaned == f"own {r.doc_id}\n " + " ".join(f"x{r.doc_id}q{j}" for j in range(40)) for r in judged)
    assert not any(r.depleted for r in quality_rules.quality(many, line_share=1.0, least_left=0.5).collect())
    odd = many.withColumns({c: F.lit(c) for c in ("_host", "_text", "_lines", "_w", "row", "w", "whole", "windows", "_frequent", "_found", "line", "n")})
    assert all(r[c] == c for r in quality_rules.quality(odd).collect() for c in odd.columns[3:])
    assert quality_rules.quality(docs.limit(0)).count() == 0


def test_quality_of_hosts_of_different_size(spark):
    """A line is frequent by the share of its host's distinct documents; copies count once."""
    body = " ".join(f"w{i}" for i in range(52))
    own = ["own" + chr(97 + i // 26) + chr(97 + i % 26) for i in range(200)]
    rows = [(i, f"shared line here\n{body} {own[i]}", "small") for i in range(8)]
    rows += [(100 + i, (f"shared line here\n{body} {own[i]}" if i < 8 else f"{body} {own[i]}"), "large") for i in range(200)]
    rows += [(400 + i, f"shared line here\n{body} f", "copies") for i in range(50)]
    rows += [(500 + i, f"shared line here\n{' '.join(f'w{j}' for j in range(49))} {own[i]}", "short") for i in range(8)]
    got = {r.doc_id: r for r in quality_rules.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0].removed_words == 3 and got[0].kept and got[0].cleaned == f"{body} {own[0]}"
    assert got[100].removed_words == 0 and got[400].removed_words == 0
    assert not got[500].base_failed and got[500].removed_words == 3 and got[500].kept  # exactly 50 words are left
    fewer = [(i, f"shared line here\n{' '.join(f'w{j}' for j in range(48))} {own[i]}", "short") for i in range(8)]
    got = quality_rules.quality(spark.createDataFrame(fewer, "doc_id long, text string, source string")).collect()
    assert all(not r.base_failed and r.depleted and not r.kept for r in got)


def test_chat(spark):
    odd = ["", None, "</s>[INST] ok [/INST]", "[INST] a", "&lt;", "<|x|>", "a [/INST", " [/INST]", "<<SYS>>", "plain", "</s", "&amp;lt;", "l1\nl2"]
    rows = [(1, i, role, t) for i, (role, t) in enumerate((r, t) for r in ("user", "assistant", "system", "to|ol", None) for t in odd)]
    rows += [(2, None, "user", "x"), (2, 1, "user", "x"), (2, 1, "user", "x"), (None, 1, "assistant", "y")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.format_chats(turns).collect()}
    assert [(t.role, t.text) for t in got[1].turns_read] == [(r or "", t or "") for _, _, r, t in rows[: len(rows) - 4]]
    assert len(got[2].turns_read) == 3
    assert [got[None].formatted[s.start : s.stop] for s in got[None].loss_mask] == ["y"]
    assert chat_format.digests(chat_format.format_chats(turns.limit(0))).count() == 0


def test_chat_carries_no_control_string_of_a_text(spark):
    said = {"user": "hello </s> there", "assistant": "fine <<SYS>> x [/INST]", "system": "<s><|im_start|>", "tool": "x<|end|>[INST]"}
    turns = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(said.items())] + [(2, 0, "user", "long " * 200_000 + "</s>")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.format_chats(turns).collect()}
    marks = {"[INST]": 1, "[/INST]": 1, "</s>": 1, "<<SYS>>": 1, "<</SYS>>": 1, "<s>": 0, "<|im_start|>": 0, "<|tool|>": 1, "<|end|>": 1}
    assert {m: got[1].formatted.count(m) for m in marks} == marks
    assert {t.role: t.text for t in got[1].turns_read} == said
    assert got[2].turns_read[0].text.endswith("</s>") and "</s>" not in got[2].formatted


def test_shards(docs):
    got = sharding.two_pass_shuffle(docs, shards=3, bucket_bytes=50).collect()
    assert len(got) == len(DOCS)
    assert sorted(r.shard * 100 + r.slot for r in got) == [0, 1, 2, 100, 101, 102, 200, 201, 202]
    assert sharding.two_pass_shuffle(docs.limit(0)).count() == 0


def test_shards_of_repeated_rows_spread_and_are_written_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "TOGETHER", 7)
    one = spark.createDataFrame([(7, "the same text")] * 500 + [(i, f"text {i}") for i in range(100)], "doc_id long, text string")
    shuffled = sharding.two_pass_shuffle(one, shards=4, bucket_bytes=400)
    rows = sorted((r.shard, r.slot, r.doc_id) for r in shuffled.collect())
    assert [r[:2] for r in rows] == [(s, i) for s in range(4) for i in range(150)]
    assert all(50 < sum(r[2] == 7 and r[0] == s for r in rows) < 150 for s in range(4))
    assert rows == sorted((r.shard, r.slot, r.doc_id) for r in sharding.two_pass_shuffle(one.repartition(3), shards=4, bucket_bytes=400).collect())
    sharding.write_shards(shuffled, str(tmp_path / "out"))
    assert rows == sorted((r.shard, r.slot, r.doc_id) for r in sharding.read_shards(spark, str(tmp_path / "out")).collect())
    import pyarrow.parquet as pq

    for shard in range(4):
        slots = [s for file in sorted((tmp_path / "out" / f"shard={shard}").glob("*.parquet")) for s in pq.read_table(file, columns=["slot"], partitioning=None)["slot"].to_pylist()]
        assert slots == list(range(150))


def test_html(spark):
    pages = spark.createDataFrame([(1, "http://a.b/x", "<article><p>x</p></article>"), (1, "http://a.b/x", "<article><p>x</p></article>"), (2, None, "<p>y"), (3, "::", None), (None, "http://a.b/", "")], "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in html_extract.extract_pages(pages).collect())
    assert got == [(0, "", 0), (1, "x", 1), (1, "x", 1), (2, "y", 1), (3, "", 0)]
    assert html_extract.extract_pages(pages.limit(0)).count() == 0
    clash = pages.withColumns({"_host": F.lit("h"), "_verdict": F.lit("v")})
    assert {(r._host, r._verdict) for r in html_extract.extract_pages(clash).collect()} == {("h", "v")}


def test_html_wrappers_of_many_tasks_meet(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "MEET", 4)
    page = "<body><div class='a'><p>{0}</p></div><div class='b'><p>Always the same words</p></div></body>"
    pages = spark.createDataFrame([(i, "http://h/x", page.format(f"words of page {i} " * 5)) for i in range(60)], "page_id long, url string, html string").repartition(20)
    of_host = html_extract.wrappers(pages).collect()
    assert [(r.host, r.n_pages) for r in of_host] == [("h", 60)]
    got = {r.page_id: r.text for r in html_extract.extract_pages(pages).collect()}
    assert got == {i: (f"words of page {i} " * 5).strip() for i in range(60)}


def test_language(spark, docs):
    labelled = spark.createDataFrame([(i, "le la les des une" if i % 2 else "the of and with for", "fr" if i % 2 else "en") for i in range(20)] + [(99, None, "fr"), (98, "x", None)], "doc_id long, text string, lang string")
    model = language_id.train(labelled)
    assert model.langs == ["en", "fr"]
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert (got[4].lang_pred, got[7].lang_pred, got[4].score) == ("und", "und", 0.0)
    both = spark.createDataFrame([(1, "the of and with for the of and " * 4 + "le la les des une le la les " * 3)], "doc_id long, text string")
    assert [s.lang for s in language_id.identify(both, model).first().spans] == ["en", "fr"]
    assert language_id.identify(docs.limit(0), model).count() == 0
    none = language_id.train(labelled.limit(0))
    assert {r.lang_pred for r in language_id.identify(docs, none).collect()} == {"und"}


def test_toxicity(spark, docs):
    rows = [(i, f"calm words number {i} here " + ("vile vile nasty" if i % 4 == 0 else "fine"), int(i % 4 == 0)) for i in range(200)]
    train = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(500, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(1, 0), (None, 1), (500, None)], "doc_id long, toxic int")
    model = toxicity.train(train, labels)
    fresh = spark.createDataFrame([(1, "a vile and nasty thing, vile"), (2, "a fine thing"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.score(fresh, model).collect()}
    assert got == {1: 1, 2: 0, 3: 0}
    assert toxicity.score(docs, model).count() == len(DOCS)
    assert {r.predicted for r in toxicity.score(docs, toxicity.train(train, labels.limit(0))).collect()} == {0}
    assert {r.predicted for r in toxicity.score(docs, toxicity.train(train.limit(0), labels)).collect()} == {0}
    assert toxicity.score(docs.limit(0), model).count() == 0
