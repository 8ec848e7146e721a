"""Wrappers of random hosts: no page order or split breaks them or changes a text; headings and quotes stay."""

import random

from lodestone.llm import html_extract as h


def element(rng, depth):
    tag = rng.choice(["p", "h2", "ul", "table", "div", "pre", "section class=a", "div class=b"])
    name = tag.split()[0]
    if name == "ul":
        return "<ul>" + "".join(f"<li>{rng.choice('xyz')} {rng.randrange(3)}</li>" for _ in range(rng.randrange(4))) + "</ul>"
    if name in ("div", "section") and depth:
        return f"<{tag}>" + "".join(element(rng, depth - 1) for _ in range(rng.randrange(6))) + f"</{name}>"
    return f"<{tag}>{rng.choice(['same', 'other', str(rng.random())])}</{name}>"


def page(rng):
    return "<body>" + "".join(element(rng, 2) for _ in range(rng.randrange(12))) + "</body>"


def test_random_hosts_in_all_orders_and_splits():
    rng = random.Random(12)
    for _ in range(2_000):
        pages = [page(rng) for _ in range(rng.randrange(1, 9))]
        for _ in range(2):
            rng.shuffle(pages)
            cut = rng.randrange(len(pages))
            whole = h.infer(pages[cut:])
            if cut:
                whole = h.merge(h.load(h.dump(h.infer(pages[:cut]))), h.load(h.dump(whole)))
            verdict = h.judge(whole)
            assert whole.pages == len(pages)
        for p in pages:
            h.extract(p, verdict)


def test_groups_of_several_elements_side_by_side():
    rows = ["ul table ul table ul", "p ul", "ul table ul", "ul table", "pre"]
    pages = ["<body><div>" + "".join(f"<{t}>{i} {t}</{t}>" for t in row.split()) + "</div></body>" for i, row in enumerate(rows)]
    assert h.infer(pages).pages == 5


def test_a_wrapper_is_as_wide_as_it_has_different_items():
    rng = random.Random(3)
    pages = ["<body><div>" + "".join(f"<{t}>{rng.random()}</{t}>" for t in rng.choices(["p", "h2", "ul", "pre", "table"], k=60)) + "</div></body>" for _ in range(60)]
    assert h.dump(h.infer(pages)).count("[") < 400


def test_splits_and_orders_of_a_table_give_the_same_texts(spark):
    rng = random.Random(21)
    rows = [(i, f"http://h{i % 6}/x", page(rng)) for i in range(150)]
    schema = "page_id long, url string, html string"
    got = []
    for n in (1, 7, 23):
        rng.shuffle(rows)
        got.append(sorted((r.page_id, r.text) for r in h.extract_pages(spark.createDataFrame(rows, schema).repartition(n)).collect()))
    assert got[0] == got[1] == got[2]


def test_constant_headings_and_inline_articles_stay(spark):
    recipe = "<body><div class='top'><p>Site of recipes</p></div><article><h1>Title {0}</h1><h2>Ingredients</h2><p>{0} eggs and some flour of kind {0}</p><h2>Method</h2><p>Stir it {0} times and bake it</p></article></body>"
    quoted = "<body><div class='x9'><h1>Title {0}</h1>" + "".join(f"<p>Paragraph {k} of page {{0}} says its own</p>" for k in range(7)) + "<article class=quote><p>A quote that page {0} has here, long enough to be a fifth</p></article></div></body>"
    pages = [(i, "http://r/x", recipe.format(i)) for i in range(6)] + [(10 + i, "http://q/x", quoted.format(i)) for i in range(6)]
    got = {r.page_id: r.text for r in h.extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[3] == "Title 3\nIngredients\n3 eggs and some flour of kind 3\nMethod\nStir it 3 times and bake it"
    assert got[12].count("\n") == 8 and got[12].startswith("Title 2\nParagraph 0 of page 2")
