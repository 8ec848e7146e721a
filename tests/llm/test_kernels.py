"""The operators' inner parts against plain versions of the same, over random input."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import bpe_codec, decontamination, html_extract, language_id, ngram_join, shingles, token_counts, toxicity
from lodestone.llm.common import tokenizer_path
from tests.llm.plain import windows_of, words_of

ODD = st.text(alphabet="aabBé漢 \n\t'sß1½🙂Σ<|>.", max_size=80)
SPECIAL = st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "the ", "'ll", " ", "é", "x" * 300]), max_size=6).map("".join)


@pytest.fixture(scope="module")
def libraries():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(tokenizer_path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


@settings(max_examples=200, deadline=None)
@given(ODD | SPECIAL)
def test_rank_merging(libraries, text):
    m = token_counts.merger(tokenizer_path("byte_bpe_50k.json"))
    assert m.count([text]) == [len(libraries["byte_bpe_50k.json"].encode(text, add_special_tokens=False).ids)]
    assert m._count_long(text) == m.count([text])[0]


@settings(max_examples=200, deadline=None)
@given(ODD | SPECIAL)
def test_automaton(libraries, text):
    c, t = bpe_codec.codec(tokenizer_path("word_bpe_49k.json")), libraries["word_bpe_49k.json"]
    ids = t.encode(text, add_special_tokens=False).ids
    assert c.encode(text) == ids
    assert c.decode(ids) == t.decode(ids, skip_special_tokens=False)


def test_small_automaton_against_plain_merging():
    merges = [("a", "b"), ("ab", "a"), ("b", "a"), ("a", "a"), ("aa", "b"), ("ab", "ab"), ("b", "b"), ("bb", "bb")]
    symbols = ["a", "b", *(x + y for x, y in merges)]
    auto = bpe_codec.MergeAutomaton({s: i for i, s in enumerate(symbols)}, merges)

    def plain(word):
        parts = list(word)
        for x, y in merges:
            out = []
            for p in parts:
                if out and out[-1] == x and p == y and out[-1] != "#":
                    out[-1] = x + y
                    out.append("#")
                else:
                    out.append(p)
            parts = [p for p in out if p != "#"]
        return parts

    for n in range(1, 9):
        for word in map("".join, itertools.product("ab", repeat=n)):
            assert [auto.label[i] for i in auto.encode(word)] == plain(word)


def _set(text, size=5):
    words = words_of(text)
    if not words:
        return set()
    n = min(size, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "B", "cé", "7", "--", "\n"]), max_size=30).map(" ".join), max_size=6))
def test_shingle_sets(texts):
    hashes, counts = shingles.shingle_sets(texts, 5)
    assert counts.tolist() == [len(_set(t)) for t in texts]
    sets = np.split(hashes, np.cumsum(counts)[:-1]) if texts else []
    for i, j in itertools.combinations(range(len(texts)), 2):
        assert len(np.intersect1d(sets[i], sets[j])) == len(_set(texts[i]) & _set(texts[j]))


def test_word_hashes_of_long_texts(monkeypatch):
    text = " ".join(f"w{i % 97}é" for i in range(5000))
    whole, _ = shingles.word_hashes([text, "w1é"])
    monkeypatch.setattr(shingles, "SLICE_CHARS", 50)
    cut, counts = shingles.word_hashes([text, "w1é"])
    assert counts.tolist() == [5000, 1]
    assert (whole == cut).all()


def test_exact_links():
    rng = random.Random(3)
    base = [rng.sample(range(1000), 40) for _ in range(6)]
    sets = [np.array(sorted({*b[: rng.randint(30, 40)], *rng.sample(range(1000, 2000), rng.randint(0, 6))}), np.uint64) for b in base for _ in range(8)]
    weights = np.arange(1, len(sets) + 1)
    n, label = ngram_join.exact_links(sets, weights, np.full(len(sets), 2), 0.8)
    for i, a in enumerate(sets):
        linked = [j for j, b in enumerate(sets) if i != j and len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))]
        assert n[i] == sum(weights[j] for j in linked)
        assert all(label[j] == label[i] for j in linked)


def test_bayesian_bounds_keep_what_reaches_the_threshold():
    fewest = ngram_join.least_matches(0.8, 1e-6)
    assert fewest == sorted(fewest)
    assert 55 <= fewest[-1] < 0.8 * ngram_join.HASHES


@pytest.mark.parametrize("pairs", [1, 200_000])
def test_decontamination_search(monkeypatch, pairs):
    monkeypatch.setattr(decontamination, "PAIRS", pairs)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    for _ in range(300):
        items = [(i, " ".join(rng.choices(words, k=rng.randint(0, 6)))) for i in range(3)]
        block = decontamination.Block.of(items, 4)
        prefixes = block.prefixes({k: np.array([rng.randint(0, 3) for _ in known]) for k, known in block.shingles.items()})
        docs = [rng.choices(words, k=rng.randint(0, 40)) for _ in range(3)]
        hashes, counts = shingles.word_hashes([" ".join(d) for d in docs])
        got = {(s, n, block.items[i]) for begun, sizes, of in prefixes.search(hashes, counts) for s, n, i in zip(begun.tolist(), sizes.tolist(), of.tolist())}
        want = set()
        base = 0
        for doc in docs:
            for i, text in items:
                for w in windows_of(words_of(text), 4):
                    want.update((base + s, len(w), str(i)) for s in range(len(doc) - len(w) + 1) if tuple(doc[s : s + len(w)]) == w)
            base += len(doc)
        assert got == want


def test_covered_words():
    assert decontamination.covered([0, 2, 9, 9], [4, 6, 10, 12]) == 9


def test_letters_are_words_and_numerals_are_not():
    assert language_id.words_of("½ ² Ⅷ 7 a1b x_y Ünï ﬁ 漢字") == ["a", "b", "x", "y", "ünï", "ﬁ", "漢字"]


def test_spans_stay_in_place_when_lower_case_is_longer():
    text = "xx İİ yy"
    model = language_id.Model(["l1", "l2"], {"x": 0, "y": 1}, np.array([[5.0, -5], [-5, 5], [0, 0]]), {})
    (words, labels, _), = model.label([text], 2.0)
    assert len(words) == 3
    spans = language_id._spans(text, labels, model.langs)
    assert (spans[0]["start"], spans[-1]["stop"], spans[-1]["lang"]) == (0, len(text), "l2")


def test_all_letters_scripts_count():
    scripts = {"latin": np.array([True, True, False]), "han": np.array([False, True, False])}
    model = language_id.Model(["a", "b", "c"], {}, np.zeros((1, 3)), scripts)
    scores = model.word_scores(["abc", "ab漢", "漢", "жж"])
    assert (scores[0] > -1).tolist() == [True, True, False]
    assert (scores[1] > -1).tolist() == [False, True, False]
    assert (scores[2] > -1).tolist() == [False, True, False]
    assert (scores[3] > -1).all()


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(4)
    model = language_id.Model(["a", "b", "c"], {}, np.zeros((1, 3)), {})
    for n in (1, 2, 6):
        scores = rng.normal(0, 2, (n, 3))
        best = max(itertools.product(range(3), repeat=n), key=lambda p: sum(scores[i, k] for i, k in enumerate(p)) - 1.5 * sum(x != y for x, y in itertools.pairwise(p)))
        assert model._viterbi([scores, scores[:1]], 1.5)[0].tolist() == list(best)


def test_mixed_text_gets_spans(monkeypatch):
    rows = {"<": 0, ">": 1, "x": 2, "y": 3, "<x": 4, "<y": 5}
    table = np.zeros((7, 2))
    table[2], table[3] = (5, -5), (-5, 5)
    model = language_id.Model(["l1", "l2"], rows, table, {})
    text = "xx xx xx xx xx xx yy yy yy yy yy yy"
    (_, labels, _), = model.label([text], 2.0)
    assert labels.tolist() == [0] * 6 + [1] * 6
    assert [s["lang"] for s in language_id._spans(text, labels, model.langs)] == ["l1", "l2"]


def test_wrapper_inference():
    page = "<html><body><div class=m><p>Home</p></div><div id=c><h1>{}</h1>{}</div></body></html>"
    pages = [page.format(f"T{i}", "".join(f"<p>text {i} {j}</p>" for j in range(i + 1))) for i in range(3)]
    wrapper = html_extract.infer(pages)
    found, waiting = [], [wrapper]
    while waiting:
        found.append(waiting.pop())
        waiting.extend(found[-1].kids)
    assert {i.kind for i in found} == {"e", "#", "r"}
    verdict = html_extract.judge(wrapper)
    assert [f.split(":")[1] for f in verdict["fixed"]] == [html_extract.digest("Home")]
    assert [html_extract.extract(p, verdict) for p in pages][1] == "T1\ntext 1 0\ntext 1 1"
    assert html_extract.dump(html_extract.load(html_extract.dump(wrapper))) == html_extract.dump(wrapper)


def test_groups_and_options():
    def page(*tags):
        return "<body>" + "".join(f"<{t}>{t} text</{t}>" for t in tags) + "</body>"

    wrapper = html_extract.infer([page("h2", "p", "h2", "p", "p", "h2", "p"), page("h2", "p", "table"), page("h2", "p")])
    body = wrapper.kids[0]
    assert [(k.kind, k.optional) for k in body.kids] == [("r", False), ("e", True)]
    assert [k.sign() for k in body.kids[0].kids] == ["<h2 ", "<p "]


@pytest.mark.parametrize("source", ["", None, "<", "plain", "<p>a<p>b", "<script>x", "<div class='comments'><p>no</p></div>", "<article><p>&lt;b&gt; &nbsp; c</p>" + "<p>x</p>" * 3000])
def test_odd_pages(source):
    text = html_extract.extract(source, None)
    assert isinstance(text, str)
    if source and "&lt;" in source:
        assert text.startswith("<b> c\nx\nx")
    if source == "<p>a<p>b":
        assert text == "a\nb"


def test_label_model_finds_good_and_tied_voters():
    rng = np.random.default_rng(1)
    truth = rng.random(2000) < 0.3
    good = np.where(rng.random(2000) < 0.95, truth, ~truth) * 2 - 1
    bad = rng.choice([-1, 1], 2000)
    other = np.where(rng.random(2000) < 0.8, truth, ~truth) * 2 - 1
    label = np.where(rng.random(2000) < 0.98, truth, ~truth) * 2 - 1
    post, chance, rho = toxicity.label_model(np.stack([good, bad, bad, other, label], 1).astype(np.int8), 0.3)
    assert ((post > 0.5) == truth).mean() > 0.96
    assert abs(rho[1, 2]) > 0.9
    assert abs(rho[0, 3]) < 0.3
    assert chance[1, 2, 0] > 0.9 > chance[1, 2, 1]


def test_deep_and_long_pages_take_part():
    deep = [f"<article>{'<div>' * 3000}<p>x{i}</p>{'</div>' * 3000}</article>" for i in range(3)]
    long = "<article>" + "".join(f"<p>{i}</p><hr><div class='c{i % 7}'>y</div>" for i in range(20_000)) + "</article>"
    wrapper = html_extract.infer([*deep, long])
    assert wrapper.pages == 4
    assert html_extract.extract(deep[1], html_extract.judge(wrapper)) == "x1"
    assert html_extract.extract(long, html_extract.judge(wrapper)).count("\n") == 39_999
