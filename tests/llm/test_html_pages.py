"""Hand-written pages of several hosts with the text that is their article."""

import pytest

from lodestone.llm import html_extract


def article(i):
    return [f"Title number {i}", f"The first paragraph of {i} says something that no other page says, at some length.", f"A second one, of {i}, with a link in it.", f"point {i}a", f"point {i}b"]


def said(i):
    t = article(i)
    return f"<h1>{t[0]}</h1><p>{t[1]}</p><p>A second one, of {i}, with <a href='/x'>a link</a> in it.</p><ul><li>{t[3]}<li>{t[4]}</ul>"


def plain_divs(i):
    """No tag or name says what is what."""
    return f"""<html><body><div class="q1"><div><a href=/>Start</a></div><div><a href=/n>News</a></div></div>
    <div class="q2"><div class="q3">{said(i)}<p>Read more of this every Monday.</p></div><div class="q4">Seen {i} times</div></div><div class="q5">All rights kept</div></body></html>"""


def table_layout(i):
    return f"""<body bgcolor=white><table><tr><td width=20%><p>Start</p><p>Shop</p></td><td>{said(i)}</td></tr></table><p>Made with care</p></body>"""


def named(i):
    return f"""<body><header><h1>The Site</h1></header><nav><a href=/>x</a></nav><div class="layout with-sidebar"><div class="has-comments post">{said(i)}</div>
    <div class="sidebar-right"><p>Other things {i}</p></div><section id="comments"><p>I agree with {i}</p></section></div><footer>f</footer></body>"""


def marked(i):
    return f"""<body class="page-sidebar"><form id="whole"><main><article>{said(i)}<aside>no</aside></article></main><div class="cookie-notice">We use cookies</div></form></body>"""


@pytest.mark.parametrize("host", [plain_divs, table_layout, named, marked])
def test_articles(host):
    pages = [host(i) for i in range(6)]
    verdict = html_extract.verdict_of(pages)
    for i, page in enumerate(pages):
        assert html_extract.extract(page, verdict) == "\n".join(article(i))


@pytest.mark.parametrize("host", [named, marked])
def test_articles_of_hosts_of_one_page(host):
    assert html_extract.extract(host(3), html_extract.verdict_of([host(3)])) == "\n".join(article(3))


def test_what_the_wrapper_changes():
    """Without names the wrapper is what tells the article; with them it agrees."""
    changed = {host.__name__: sum(html_extract.extract(host(i), html_extract.verdict_of([host(k) for k in range(6)])) != html_extract.extract(host(i), None) for i in range(6)) for host in (plain_divs, table_layout, named, marked)}
    assert changed == {"plain_divs": 6, "table_layout": 6, "named": 0, "marked": 0}


@pytest.mark.parametrize(
    "source, text",
    [
        ('<div style="overflow:hidden"><p>Main text here.</p></div>', "Main text here."),
        ('<div data-hidden="false"><p>Main text here.</p></div>', "Main text here."),
        ('<div class="layout with-sidebar"><p>Main text here.</p></div>', "Main text here."),
        ('<div class="has-comments post"><p>Main text here.</p></div>', "Main text here."),
        ('<div><p>Some text that is the article here.</p><p class="cookie-notice">We use cookies</p></div>', "Some text that is the article here."),
        ('<div hidden><p>no</p></div><p>yes</p><p style="display: none">no</p><div role="navigation">no</div><p aria-hidden=true>no</p>', "yes"),
        ("<p>Half of <a href=x>this is linked</a></p>", "Half of this is linked"),
        ('<article class="comment"><p>no</p></article><article><p>a longer text than the comment</p></article>', "a longer text than the comment"),
        ('<article><p>one part</p></article><article id="two"><p>other part</p></article>', "one part\nother part"),
        ("<p title='a > b'>x &amp; y&nbsp;z</p>", "x & y z"),
        ("<pre>a\n\n b</pre>c<br>d", "a b\nc d"),
    ],
)
def test_markup(source, text):
    assert html_extract.extract(source, None) == text
