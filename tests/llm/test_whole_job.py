"""Cases in which an operator once did less than its whole job."""

import corpus_pipeline
import numpy as np
from lodestone.llm import html_extract, language_id


def test_words_are_scored_by_all_orders():
    words = ["abcd", "été", "a", "żółw", "abcdabcdabcd", "日本"]
    all_grams = {w: [f"<{w}>"[i : i + n] for n in (1, 2, 3, 4) for i in range(len(w) + 3 - n)] for w in words}
    known = sorted({g for w in words[:3] for g in all_grams[w]} - {"bc"}) + ["zzzz"]
    table = np.random.default_rng(5).normal(-6, 2, (len(known) + 1, 3))
    rows = {g: i for i, g in enumerate(known)}
    model = language_id.Model(["a", "b", "c"], rows, table, {"han": np.array([True, False, True])})
    want = np.array([sum(table[rows.get(g, -1)] for g in all_grams[w]) / len(all_grams[w]) * len(w) for w in words])
    want[-1, 1] = want[-1].max() - 50
    assert np.allclose(model.word_scores(words), want, rtol=1e-12)
    assert [list(language_id.grams(w)) for w in words] == list(all_grams.values())


def test_join_stage_judges_rows_of_repeated_and_null_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(3, a), (5, a + " end"), (5, b), (7, c), (7, c), (None, c), (None, "lone words of a row without an id"), (8, None), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.join_stage(spark, docs, "").collect()]
    want = [(3, a), (5, b), (7, c), (None, "lone words of a row without an id"), (8, None), (8, None)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_wrapper_decides_before_names():
    def page(i):
        said = "".join(f"<p>{w} of page {i} in words of its own</p>" for w in ("start", "middle", "end"))
        return f'<body><article><p>{"The same notice on every page. " * 9}</p></article><div class="x7">{said}</div></body>'

    verdict = html_extract.judge(html_extract.infer([page(i) for i in range(4)]))
    body = html_extract.path_of(0, "body", "")
    assert verdict["content"] == html_extract.path_of(body, "div", "x7")
    assert html_extract.extract(page(1), verdict) == "\n".join(f"{w} of page 1 in words of its own" for w in ("start", "middle", "end"))


def test_pages_too_deep_to_align_make_no_text_fixed(spark):
    short = "<body><h1>T</h1><div>a long text that only this page has</div></body>"
    deep = ["<body>" + "<div>" * 130 + f"text {i}" + "</div>" * 130 + "</body>" for i in range(3)]
    pages = spark.createDataFrame([(i, "http://h/x", p) for i, p in enumerate([short, *deep])], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract_pages(pages).collect()}
    assert got[0] == "T\na long text that only this page has"
    assert got[2] == "text 1"
