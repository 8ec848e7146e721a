"""Main text of web pages by wrappers inferred from the pages of one host.

A page is a stream of tokens: opening tags with their class and id, closing tags, and texts; tags that only
mark up words belong to the text around them, and elements that never hold article text (scripts, menus,
forms, hidden ones) are left out. A wrapper is a union-free regular expression over such tokens: tokens, text
slots, optional groups (...)? and repeated groups (...)+. Inference takes a host's pages one after the other
and aligns the wrapper so far with the next page:

* equal tokens match; a text against another text becomes a slot,
* at a mismatch, elements on either side that follow an equal row of elements are resolved into a repeated
  group: that row becomes the group's pattern, and what follows is folded into it,
* any other mismatch is resolved into optional groups: the fewest tokens that one or both sides have before
  they go on with an equal tag.

* optional items in a row of which one recurs become a repeated group of optional items, as wide as it has
  different ones.

Two wrappers align like a wrapper and a page. Pages of one shape (equal but for their texts) align item by item in
whatever order, so tasks fold those that they read; the shapes of a host are then aligned in groups and an order
that their hashes fix, so that a wrapper depends on the host's pages alone. All pages take part; none is shuffled.

The wrapper decides what the article is. Its content is the smallest element that holds most of what varies;
of the texts that don't vary, those before and behind all that do are template, but no heading is and nothing
in between. Names come second: tags that mark an article narrow a content to what holds most of it, class names
that speak of boilerplate drop lesser parts of it, but no part that holds most of the text or a heading of the
article. A host that has no content element (its pages vary all over, or it is one page) is judged by names alone.
"""

from __future__ import annotations

import bisect
import hashlib
import html
import itertools
import json
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import durable, ship, within

#: Pages that must agree on a text for it to be template, and share of the varying text that the content holds.
AGREE = 3
CONTENT_SHARE = 0.8
#: Elements in a row that are tried as the pattern of a repeated group.
ROW = 3
#: Items that a task holds before it passes on what it has, and wrappers that are aligned in one task.
HELD = 200_000
MEET = 64

#: Elements without content, elements whose content is no markup, elements that hold no
#: article text, roles that say so, and elements that end no block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BOILERPLATE = frozenset("head title nav footer aside script style noscript template textarea select button iframe svg canvas object menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar toolbar".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
#: Elements that a content element is not looked for inside of.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl li dt dd blockquote pre figure details summary address".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in class or id that name boilerplate, words before them that make them speak of
#: something else than the element, and words that name content.
CUES = frozenset(
    """ad ads advert advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs
    sidebar side footer header masthead cookie cookies consent notice popup modal comment comments respond reply replies
    discussion disqus share sharing social related recommended teaser newsletter subscribe signup login search widget
    pagination pager toolbar skip""".split()
)
MODIFIERS = frozenset("with without has have no not is show hide enable js type format status category tag template".split())
CONTENT = frozenset("article content main post entry story body text".split())
#: Elements that close an open element of the key's kind when they begin.
CLOSES = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")
#: Numbers of posts and the like, which would tell equal elements apart; those of a grid are shorter.
_DIGITS = re.compile(r"\d{3,}")


@dataclass(slots=True)
class Token:
    kind: str  # "open", "close" or "text"
    name: str  # tag, or the text itself
    mark: str = ""  # class and id of an opening tag
    role: str = ""  # its role; "hidden" if it isn't shown


def _marks(attributes: str) -> tuple[str, str]:
    marks, role = [], ""
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), html.unescape(value.strip("\"'"))
        if key in ("class", "id"):
            marks.append(value)
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and _UNSEEN.search(value)):
            role = "hidden"
        elif key == "role" and role != "hidden":
            role = value.strip().lower()
    return " ".join(marks), role


def tokens(source: str) -> Iterator[Token]:
    """Tags and texts of a page; the content of scripts and styles, comments and declarations are left out."""
    at = 0
    while at < len(source):
        found = _TOKEN.search(source, at)
        if found is None:
            break
        if found.start() > at:
            yield Token("text", source[at : found.start()])
        at = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if found[1]:
            yield Token("close", tag)
            continue
        yield Token("open", tag, *(_marks(found[3]) if "=" in found[3] or "hidden" in found[3].lower() else ()))
        if tag in RAW and not found[3].rstrip().endswith("/"):
            end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            stop = end.start() if end else len(source)
            if tag in ("title", "textarea") and stop > at:
                yield Token("text", source[at:stop])
            at = stop
        elif tag in VOID:
            yield Token("close", tag)
    if at < len(source):
        rest = source[at:]
        cut = rest.rfind("<")
        yield Token("text", rest if cut < 0 or not re.match(r"<[/a-zA-Z!]", rest[cut:]) else rest[:cut])


# --- pages --------------------------------------------------------------------------------------------


@dataclass(slots=True)
class Element:
    """An element that may hold article text: where it stands, by a number for its place and for its parent."""

    tag: str
    mark: str
    parent: int
    path: int  # number of the way from the root to it, by tags and marks
    role: str = ""


@dataclass(slots=True)
class Piece:
    """A block of text, the element it stands in, and how many of its characters are linked."""

    text: str
    inside: int
    linked: int


def path_of(parent: int, tag: str, mark: str) -> int:
    return zlib.crc32(f"<{tag} {_DIGITS.sub('0', mark)}".encode("utf-8", "surrogatepass"), parent)


def read(source: str) -> tuple[list[Element], list[Piece]]:
    """Elements, and blocks of text in page order with character references decoded and white space as one space."""
    elements = [Element("", "", -1, 0)]
    stack: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, element (that of the block around an inline one), whether it is left out
    pieces: list[Piece] = []
    text: list[str] = []
    linked = barred = 0

    def flush() -> None:
        nonlocal linked
        if text:
            whole = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if whole:
                pieces.append(Piece(whole, stack[-1][1], min(linked, len(whole))))
            text.clear()
        linked = 0

    def leave(index: int) -> None:
        nonlocal barred
        for _, _, bar in stack[index:]:
            barred -= bar
        del stack[index:]

    for token in tokens(source):
        if token.kind == "text":
            if not barred:
                text.append(token.name)
                if any(tag == "a" for tag, _, _ in stack[-3:]):
                    linked += len(token.name)
            continue
        tag = token.name
        if tag in VOID:
            if token.kind == "open" and not barred:
                if tag in ("br", "wbr", "img"):
                    text.append(" " if tag == "br" else "")
                else:
                    flush()
            continue
        if tag not in INLINE:
            flush()
        if token.kind == "open":
            if tag in CLOSES:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in CLOSES[tag]:
                        leave(k)
                        break
                    if stack[k][0] in ("ul", "ol", "dl", "table", "select"):
                        break
            elif tag not in INLINE:  # a block ends an open paragraph and what is inside it
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        leave(k)
                        break
                    if stack[k][0] not in INLINE:
                        break
            bar = tag in BOILERPLATE or token.role == "hidden" or token.role in ROLES
            at = stack[-1][1]
            if tag not in INLINE and not bar and not barred:
                elements.append(Element(tag, token.mark, at, path_of(elements[at].path, tag, token.mark), token.role))
                at = len(elements) - 1
            barred += bar
            stack.append((tag, at, bar))
        else:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    leave(k)
                    break
                # an end tag doesn't reach past the element that its block stands in
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
    flush()
    return elements, pieces


# --- wrappers -----------------------------------------------------------------------------------------


@dataclass(slots=True, repr=False)
class Item:
    """A part of a wrapper: an element "e", a text "#" or a repeated group "r", with what it was aligned with."""

    kind: str
    key: str  # opening token of an element
    kids: list[Item] = field(default_factory=list)
    pages: int = 1  # pages that have it
    optional: bool = False
    text: str | None = None  # digest of a text that all these pages share; None for a slot
    size: int = 0  # characters of its texts

    def sign(self) -> str:
        """What must be equal for two items to match; a group of one element matches that element."""
        if self.kind == "e":
            return self.key
        return "#" if self.kind == "#" else (self.kids[0].sign() if len(self.kids) == 1 else "(" + " ".join(k.sign() for k in self.kids) + ")")


def digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def page_item(source: str) -> Item:
    """A page as a wrapper: its own tokens."""
    elements, pieces = read(source)
    items = [Item("e", f"<{e.tag} {_DIGITS.sub('0', e.mark)}") for e in elements]
    open_, live = [0], {0}

    def close(until: int) -> None:
        while open_[-1] != until:
            done = open_.pop()
            live.discard(done)
            items[open_[-1]].kids.append(items[done])

    for piece in pieces:
        new, at = [], piece.inside
        while at not in live:
            new.append(at)
            at = elements[at].parent
        close(at)
        open_.extend(reversed(new))
        live.update(new)
        items[open_[-1]].kids.append(Item("#", "#", text=digest(piece.text), size=len(piece.text)))
    close(0)
    return items[0]


def merge(a: Item, b: Item) -> Item:
    """``a`` aligned with ``b``, which has an equal sign. Nested elements wait their turn, however deep they are."""
    waiting = deque([(a, b)])
    while waiting:
        x, y = waiting.popleft()
        x.optional |= y.optional
        if x.kind == "#":
            x.pages, x.size = x.pages + y.pages, x.size + y.size
            x.text = x.text if x.text == y.text else None
            continue
        if x.kind == "e" and y.kind == "r":
            x.kids = [Item("e", x.key, x.kids, x.pages)]
            x.kind, x.key = "r", ""
        x.pages += y.pages
        if x.kind == "r":
            waiting.extend(zip(x.kids, y.kids if y.kind == "r" else [y], strict=True))
        else:
            x.kids = align(x.kids, y.kids, lambda p, q: waiting.append((p, q)))
    return a


def _signs(items: list[Item]) -> list[str]:
    return [x.sign() for x in items]


def _occurrence(kids: list[Item], items: list[Item], at: int) -> tuple[list[Item], int]:
    """What makes one more occurrence of a group's row at ``at``, a group of that row or the row itself, and how many items that is."""
    signs = _signs(kids)
    if at < len(items) and items[at].kind == "r" and _signs(items[at].kids) == signs:
        return items[at].kids, 1
    row = items[at : at + len(kids)]
    return (row, len(row)) if _signs(row) == signs else ([], 0)


def _repeat(out: list[Item], items: list[Item], at: int, match: Callable[[Item, Item], None]) -> int:
    """Folds items into a repeated group at the end of ``out`` if they repeat what is there; how many it takes."""
    if not out or items[at].kind == "#":
        return 0
    last = out[-1]
    if last.kind == "r":
        row, taken = _occurrence(last.kids, items, at)
        if taken:
            for x, y in zip(last.kids, row, strict=True):
                match(x, y)
            return taken
        tail = last.kids[-1]
        if len(last.kids) > 1 and tail.sign() == items[at].sign():  # the row's last element goes on
            if tail.kind != "r":
                tail = last.kids[-1] = Item("r", "", [tail], tail.pages)
            match(tail, items[at])
            return 1
    for n in range(1, min(ROW, len(out)) + 1):
        row = out[-n:]
        if n == 1 and row[0].kind == "r":
            continue
        found, taken = _occurrence(row, items, at)
        if not taken:
            continue
        del out[-n:]
        while len(out) >= n and _signs(out[-n:]) == _signs(row):  # equal rows before it are the same group
            before = out[-n:]
            del out[-n:]
            for x, y in zip(before, row, strict=True):
                match(x, y)
            row = before
        for x, y in zip(row, found, strict=True):
            match(x, y)
        out.append(row[0] if n == 1 and row[0].kind == "r" else Item("r", "", row, row[0].pages))
        return taken
    return 0


def _loosened(out: list[Item], match: Callable[[Item, Item], None]) -> list[Item]:
    """``out`` with each run of optional items in which some sign recurs as one repeated group of optional items.

    Such a run says no more than that these items come in any order, and would grow with every page; as a
    group (a? b? c?)+ it is as wide as it has different signs.
    """
    done: list[Item] = []
    for optional, run_ in itertools.groupby(out, key=lambda x: x.optional):
        run = list(run_)
        parts, waiting = [], run[::-1]
        while waiting:
            item = waiting.pop()
            if item.kind == "r":
                waiting.extend(item.kids[::-1])
            else:
                parts.append(item)
        if not optional or len(run) == 1 or len({x.sign() for x in parts}) == len(parts):
            done += run
            continue
        first: dict[str, Item] = {}
        for item in parts:
            item.optional = True
            if first.setdefault(item.sign(), item) is not item:
                match(first[item.sign()], item)
        done.append(Item("r", "", list(first.values()), max(x.pages for x in run), True))
    return done


def align(a: list[Item], b: list[Item], match: Callable[[Item, Item], None]) -> list[Item]:
    """Items that cover both rows: pairs with equal signs are matched, other ones become repeated or optional."""
    signs_a, signs_b = _signs(a), _signs(b)
    places: dict[str, list[int]] = {}
    for at, sign in enumerate(signs_b):
        if sign != "#":
            places.setdefault(sign, []).append(at)
    out: list[Item] = []
    i = j = 0
    while i < len(a) and j < len(b):
        x, y = a[i], b[j]
        if signs_a[i] == signs_b[j]:
            match(x, y)
            out.append(x)
            i, j = i + 1, j + 1
            continue
        for group, row, mine in ((x, b, True), (y, a, False)):
            found, taken = _occurrence(group.kids, row, j if mine else i) if group.kind == "r" and len(group.kids) > 1 else ([], 0)
            if taken:
                whole = group if mine else Item("r", "", found, x.pages)
                for p, q in zip(whole.kids, found if mine else group.kids, strict=True):
                    match(p, q)
                out.append(whole)
                i, j = (i + 1, j + taken) if mine else (i + taken, j + 1)
                break
        else:
            taken = 0
        if taken:
            continue
        if taken := _repeat(out, a, i, match):
            i += taken
            continue
        if taken := _repeat(out, b, j, match):
            j += taken
            continue
        best = None
        di = 0
        while i + di < len(a) and (best is None or di < best[0] + best[1]):
            at = places.get(signs_a[i + di], ())
            k = bisect.bisect_left(at, j)
            if k < len(at) and (best is None or di + at[k] - j < best[0] + best[1]):
                best = di, at[k] - j
            di += 1
        if best is None:
            break
        for item in (*a[i : i + best[0]], *b[j : j + best[1]]):
            item.optional = True
            out.append(item)
        i, j = i + best[0], j + best[1]
    for rest, at in ((a, i), (b, j)):
        while at < len(rest):
            if taken := _repeat(out, rest, at, match):
                at += taken
                continue
            rest[at].optional = True
            out.append(rest[at])
            at += 1
    return _loosened(out, match)


def infer(pages: list[str]) -> Item | None:
    """The wrapper of some pages, aligned in order."""
    wrapper = None
    for page in pages:
        item = page_item(page)
        wrapper = item if wrapper is None else merge(wrapper, item)
    return wrapper


def dump(wrapper: Item) -> str:
    """A wrapper as flat JSON, parents before their parts."""
    out, waiting = [], [wrapper]
    while waiting:
        x = waiting.pop()
        out.append([x.kind, x.key, x.pages, int(x.optional), x.text, x.size, len(x.kids)])
        waiting.extend(reversed(x.kids))
    return json.dumps(out, separators=(",", ":"))


def load(dumped: str) -> Item:
    root = Item("e", "")
    open_ = [(root, 1)]
    for kind, key, pages, optional, text, size, n in json.loads(dumped):
        while not open_[-1][1]:
            open_.pop()
        parent, left = open_.pop()
        open_.append((parent, left - 1))
        item = Item(kind, key, [], pages, bool(optional), text, size)
        parent.kids.append(item)
        open_.append((item, n))
    return root.kids[0]


def judge(wrapper: Item | None) -> dict:
    """What a host's wrapper says: ``content``, the path of the element that holds most of what varies, or None,
    and ``fixed``, the path and digest of texts that are template."""
    if wrapper is None:
        return {"content": None, "fixed": []}
    flat: list[tuple[Item, int, int, bool]] = []  # item, number of its parent, path of the element, whether it repeats
    waiting: list[tuple[Item, int, int, bool]] = [(wrapper, -1, 0, False)]
    while waiting:
        item, parent, path, repeats = waiting.pop()
        if item.kind == "e" and parent >= 0:
            path = zlib.crc32(item.key.encode("utf-8", "surrogatepass"), path)
        repeats |= item.kind == "r"
        flat.append((item, parent, path, repeats))
        me = len(flat) - 1
        waiting.extend((k, me, path, repeats) for k in reversed(item.kids))
    pages = wrapper.pages
    fixed = {(path, x.text) for x, _, path, repeats in flat if x.kind == "#" and x.text is not None and not repeats and x.pages >= AGREE and 2 * x.pages > pages}
    varying = [x.size if x.kind == "#" and (path, x.text) not in fixed else 0 for x, _, path, _ in flat]
    for me in range(len(flat) - 1, 0, -1):
        varying[flat[me][1]] += varying[me]
    titles = [int(x.kind == "e" and x.key.startswith("<h1 ") and varying[me] > 0) for me, (x, _, _, _) in enumerate(flat)]
    for me in range(len(flat) - 1, 0, -1):
        titles[flat[me][1]] += titles[me]
    content = None
    if pages > 1 and varying[0]:
        at = 0
        below: dict[int, list[int]] = {}
        for me, (x, parent, _, _) in enumerate(flat):
            if x.kind == "e":
                below.setdefault(parent, []).append(me)
        while (down := max(below.get(at, ()), key=varying.__getitem__, default=None)) is not None:
            tag = flat[down][0].key[1:].split(" ")[0]
            # a title that varies beside the element belongs to the article too
            if varying[down] < CONTENT_SHARE * varying[0] or titles[down] < titles[at] or tag in TEXTUAL:
                break
            at = down
            if tag not in ("html", "body"):
                content = flat[at][2]
    return {"content": content, "fixed": sorted(f"{path}:{text}" for path, text in fixed)}


def verdict_of(pages: list[str]) -> dict:
    """The judgement on some pages of a host."""
    return judge(infer(pages))


# --- extraction ---------------------------------------------------------------------------------------


def names(mark: str, words: frozenset[str]) -> bool:
    """Whether a class or id has one of the words, as a part of its own that no modifier precedes."""
    for name in mark.split():
        parts = [p.lower() for p in _PARTS.findall(name)]
        if parts and parts[0] not in MODIFIERS and not words.isdisjoint(parts):
            return True
    return False


def extract(source: str | None, verdict: dict | None) -> str:
    """The main text of a page under the judgement on its host's wrapper."""
    if not source:
        return ""
    elements, pieces = read(source)
    if not pieces:
        return ""
    n = len(elements)
    heads, marked = [False] * n, [False] * n  # elements that hold a first heading, and an element that marks an article
    for e in range(n - 1, 0, -1):
        x = elements[e]
        heads[e] |= x.tag == "h1"
        marked[e] |= x.tag in ("article", "main") or x.role in ("main", "article")
        heads[x.parent] |= heads[e]
        marked[x.parent] |= marked[e]
    own = [elements[e].tag in ("article", "main") or elements[e].role in ("main", "article") for e in range(n)]
    # page headers and forms, unless they are part of an article or hold it
    within_article, out_ = [False] * n, [False] * n
    for e in range(1, n):
        x = elements[e]
        within_article[e] = within_article[x.parent] or own[e]
        apart = (x.tag == "header" and not (within_article[e] and heads[e])) or (x.tag == "form" and not (heads[e] or marked[e]))
        out_[e] = out_[x.parent] or apart
    headed = [False] * n  # headings and what is in them
    for e in range(1, n):
        headed[e] = headed[elements[e].parent] or elements[e].tag in HEADINGS
    held = [0] * n
    for p in pieces:
        if not out_[p.inside]:
            held[p.inside] += len(p.text)
    for e in range(n - 1, 0, -1):
        held[elements[e].parent] += held[e]

    def outermost(chosen: Callable[[int], bool], inside: list[bool] | None = None) -> list[bool]:
        """Elements that are chosen, or in a chosen one, within ``inside``."""
        got = [False] * n
        for e in range(1, n):
            got[e] = got[elements[e].parent] or (not out_[e] and (inside is None or inside[e]) and chosen(e))
        return got

    def text_in(region: list[bool]) -> int:
        return sum(held[e] for e in range(1, n) if region[e] and not region[elements[e].parent])

    def speaks_of_boilerplate(e: int) -> bool:
        return bool(elements[e].mark) and elements[e].tag not in ("html", "body") and names(elements[e].mark, CUES) and not heads[e] and not (marked[e] and not own[e])

    def plain_in(region: list[bool] | None) -> int:
        """Characters in a region, or all, without those of parts that are named boilerplate."""
        spoken = outermost(speaks_of_boilerplate, region)
        return (held[0] if region is None else text_in(region)) - text_in(spoken)

    region = None
    content = verdict.get("content") if verdict else None
    if content is not None:
        region = outermost(lambda e: elements[e].path == content)
        if not text_in(region):
            region = None
    # a name narrows what the wrapper says to what holds most of it; where that says nothing, to what holds half
    article = outermost(lambda e: own[e] and not speaks_of_boilerplate(e), region)
    share = 0.5 if region is None else CONTENT_SHARE
    enclosed = region is not None and any(region[e] and not region[elements[e].parent] and within_article[elements[e].parent] for e in range(1, n))
    if text_in(article) and text_in(article) >= share * plain_in(region) and not enclosed:
        region = article
    if region is None:
        named = outermost(lambda e: bool(elements[e].mark) and names(elements[e].mark, CONTENT) and not names(elements[e].mark, CUES) and held[e] >= 0.2 * held[0])
        region = named if text_in(named) else None
    everything = region is None
    if region is None:
        region = [True] * n
    most = held[0] if everything else text_in(region)
    gone = [False] * n
    links: dict[int, list[int]] = {}
    if everything:  # lists of links are menus where nothing tells the article from them
        for p in pieces:
            e = p.inside
            while e > 0:
                known = links.setdefault(e, [0, 0])
                known[0] += 2 * p.linked >= len(p.text)
                known[1] += p.linked
                e = elements[e].parent
    for e in range(1, n):
        above = elements[e].parent
        inner = region[above] if not everything else True
        menu = everything and links.get(e, (0, 0))[0] >= AGREE and links[e][1] >= 0.8 * max(1, held[e]) and elements[e].tag not in ("html", "body", "p")
        gone[e] = gone[above] or out_[e] or (inner and 2 * held[e] <= most and (menu or speaks_of_boilerplate(e)))
    left = [p for p in pieces if region[p.inside] and not gone[p.inside] and not out_[p.inside]]
    fixed = set(verdict["fixed"]) if verdict and verdict.get("fixed") else None
    if fixed and left:
        varied = [f"{elements[p.inside].path}:{digest(p.text)}" not in fixed for p in left]
        # a page that is all template is a copy of others, not boilerplate
        if 2 * sum(len(p.text) for p, own_ in zip(left, varied, strict=True) if own_) >= sum(len(p.text) for p in left):
            first, last = varied.index(True), len(left) - varied[::-1].index(True)
            left = [p for i, p in enumerate(left) if first <= i < last or headed[p.inside]]
    if not left:
        left = [p for p in pieces if not out_[p.inside]] or pieces
    return "\n".join(p.text for p in left)


# --- Spark --------------------------------------------------------------------------------------------


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))


_WRAPPERS = "host string, shape string, wrapper string, n long"


def shape(item: Item) -> str:
    """A digest of a page's elements and the places of its texts."""
    said, waiting = hashlib.blake2b(digest_size=16), [item]
    while waiting:
        x = waiting.pop()
        said.update(f"{x.key} {len(x.kids)}\n".encode("utf-8", "surrogatepass"))
        waiting.extend(reversed(x.kids))
    return said.hexdigest()


def _inferred(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The wrappers of the hosts' shapes that a task reads, passed on whenever HELD items are held."""
    held: dict[tuple[str, str], Item] = {}
    items = 0

    def rows() -> pd.DataFrame:
        out = pd.DataFrame([(*key, dump(w), w.pages) for key, w in held.items()], columns=["host", "shape", "wrapper", "n"])
        held.clear()
        return out

    for batch in batches:
        for host, page in zip(batch["host"], batch["html"], strict=True):
            item = page_item(page)
            key = (host, shape(item))
            if key in held:
                _same_shape(held[key], item)
            else:
                held[key] = item
                items += 1 + page.count("<")
            if items > HELD:
                yield rows()
                items = 0
    yield rows()


def _same_shape(a: Item, b: Item) -> Item:
    """``a`` aligned with ``b`` of the same shape; neither order nor grouping of many of them matters."""
    waiting = [(a, b)]
    while waiting:
        x, y = waiting.pop()
        x.pages, x.size = x.pages + y.pages, x.size + y.size
        x.text = x.text if x.text == y.text else None
        waiting.extend(zip(x.kids, y.kids, strict=True))
    return a


def _together(frame: pd.DataFrame) -> pd.DataFrame:
    """One wrapper of a host's: those of equal shapes first, then the shapes in order."""
    whole, said = None, hashlib.blake2b(digest_size=16)
    for shape_, group in frame.sort_values("shape").groupby("shape", sort=False):
        of_shape = None
        for dumped in group["wrapper"]:
            of_shape = load(dumped) if of_shape is None else _same_shape(of_shape, load(dumped))
        whole = of_shape if whole is None else merge(whole, of_shape)
        said.update(shape_.encode())
    one = frame["shape"].iloc[0]
    return pd.DataFrame({"host": [frame["host"].iloc[0]], "shape": [one if frame["shape"].nunique() == 1 else said.hexdigest()], "wrapper": [dump(whole)], "n": [int(frame["n"].sum())]})


def _met(parts: DataFrame, keys: list[str], place) -> DataFrame:
    """``parts`` aligned in groups of about half of MEET by ``place`` until each of ``keys`` has one row."""
    while True:
        counts = durable(parts.groupBy(*keys).agg(F.count("*").alias("of_key")))
        if (counts.agg(F.max("of_key").alias("n")).first().n or 0) <= 1:
            return parts
        groups = F.when(F.col("of_key") > MEET, F.ceil(F.col("of_key") / (MEET // 2))).otherwise(1)
        counts = within(counts, sum((F.octet_length(k) for k in keys), F.lit(32)))
        dealt = parts.join(counts, keys).withColumn("part", F.pmod(F.xxhash64(place, F.col("of_key")), groups))
        parts = durable(dealt.groupBy(*keys, "part").applyInPandas(lambda frame: _together(frame.drop(columns=["part", "of_key"])), _WRAPPERS))


def wrappers(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """(host, verdict as JSON, n_pages) from all pages of each host.

    Wrappers are aligned at most about MEET at a time, so a hot host's pages or wrappers never meet in one task.
    Which ones meet and in which order is fixed by the hashes of their shapes, not by how pages are dealt to tasks.
    """
    ship(pages.sparkSession)
    read_ = pages.filter(F.col(source).isNotNull()).select(host_of(F.col(url)).alias("host"), F.col(source).alias("html"))
    parts = durable(read_.mapInPandas(_inferred, _WRAPPERS))
    parts = _met(_met(parts, ["host", "shape"], F.monotonically_increasing_id()), ["host"], F.col("shape"))
    judged = F.pandas_udf(lambda dumped: dumped.map(lambda w: json.dumps(judge(load(w)))), "string")
    return parts.select("host", judged("wrapper").alias("verdict"), F.col("n").alias("n_pages"))


def extract_pages(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """``pages`` with text and n_chars.

    Null and empty html gives an empty text; a null or odd url belongs to the host "" and pages of equal
    url or id are each extracted. Pages of any length and depth take part in their host's wrapper and are
    read whole. An empty table stays empty; existing columns of these two names are replaced, and no other.
    """
    ship(pages.sparkSession)
    host, verdict = (next(n for n in (f"_{name}{'_' * i}" for i in range(len(pages.columns) + 1)) if n not in pages.columns) for name in ("host", "verdict"))
    of_host = durable(wrappers(pages, url, source).select(F.col("host").alias(host), F.col("verdict").alias(verdict)))
    of_host = within(of_host, F.octet_length(host) + F.octet_length(verdict) + 32)
    joined = pages.withColumn(host, host_of(F.col(url))).join(of_host, host, "left")

    @F.pandas_udf("string")
    def main_text(sources: pd.Series, verdicts: pd.Series) -> pd.Series:
        parsed: dict[str, dict] = {}
        out = []
        for page, dumped in zip(sources, verdicts, strict=True):
            if dumped is not None and dumped not in parsed:
                if len(parsed) > 1_000:
                    parsed.clear()
                parsed[dumped] = json.loads(dumped)
            out.append(extract(page, parsed.get(dumped)))
        return pd.Series(out, dtype="object")

    out = joined.withColumn("text", main_text(F.col(source), F.col(verdict))).drop(host, verdict)
    return out.withColumn("n_chars", F.length("text").cast("long"))
