"""Text expressions: tokens, normal forms, overlap of token sets, identifiers, sentences."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning for retrieval.
STOP_WORDS = tuple(
    """a an and are as at be by for from has have in is it its of on or that the to was were
    with will would can could should this these those there their they we you your our not no but if
    than then when which who whom whose what how why into over under about after before during said
    say says been being do does did done had having he she his her them us me my""".split()
)
#: Tokens, identifiers, and the end of a sentence.
TOKEN = r"[A-Za-z_][A-Za-z0-9_]+|\d+(?:\.\d+)?"
IDENTIFIER = r"[A-Z][A-Z0-9]{2,}(?:_[A-Z0-9]+)+|[A-Z]{2,}-\d+"
#: Letters with marks and the letters they are searched as.
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
_MARK = "\x01"


def tokens(text: Column, keep_stop: bool = False) -> Column:
    """Lower-case tokens in order; stop words and single characters are left out unless asked for."""
    found = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)
    return found if keep_stop else F.filter(found, lambda t: ~t.isin(*STOP_WORDS) & (F.length(t) > 1))


_LOWERED = re.compile(TOKEN.replace("A-Z", "").replace(r"\d", "[0-9]").encode())
_STOPPED = frozenset(w.encode() for w in STOP_WORDS)


def cut(text: str) -> list[bytes]:
    """``tokens`` of one text inside a task; they are ASCII, so that bytes of A-Z are all there is to lower."""
    found = _LOWERED.findall(text.encode("utf-8", "surrogatepass").lower())
    return [t for t in found if len(t) > 1 and t not in _STOPPED]


def normalized(text: Column) -> Column:
    """Lower case with runs of white space as one space, trimmed."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def approx_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up, one at least."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("int")


def sentences(text: Column) -> Column:
    """Parts that end with . ! or ? before white space, trimmed, empty ones left out."""
    marked = F.regexp_replace(text, r"([.!?])\s+", f"$1{_MARK}")
    return F.filter(F.transform(F.split(marked, _MARK), lambda x: F.trim(x)), lambda s: s != "")


_ENDED = re.compile(rb"([.!?])[ \t\n\x0b\f\r]+")
#: A token has two characters, or is a digit.
_LEFT_OUT = _STOPPED | frozenset(b"%d" % i for i in range(10))


def sentences_of(text: str) -> list[tuple[bytes, set[bytes]]]:
    """``sentences`` of one text inside a task, each with its distinct ``tokens``; white space is ASCII there too."""
    marked = _ENDED.sub(b"\\1" + _MARK.encode(), text.encode("utf-8", "surrogatepass"))
    parts = zip(marked.split(_MARK.encode()), marked.lower().split(_MARK.encode()), strict=True)
    return [(s, set(_LOWERED.findall(low)) - _LEFT_OUT) for x, low in parts if (s := x.strip(b" "))]


def identifiers(text: Column) -> Column:
    """Upper-case identifiers such as ERR_CODE or ABC-12."""
    return F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def containment(query: Column, text: Column) -> Column:
    """Share of the distinct query tokens that the text has; 0 without any."""
    distinct = F.size(F.array_distinct(query))
    return F.when(distinct > 0, F.size(F.array_intersect(query, text)) / distinct).otherwise(0.0)


def analyzed(text: Column) -> Column:
    """Terms for fielded search: lower case without accents, hyphens and underscores kept, of two characters or more."""
    plain = F.translate(F.lower(text), *ACCENTS)
    return F.filter(F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}_-]+"), F.lit(0)), lambda t: F.length(t) > 1)


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based UUID of version 5 of a text."""
    import uuid

    digest = F.substring(F.sha1(F.concat(F.lit(uuid.UUID(namespace).bytes), F.encode(name, "UTF-8"))), 1, 32)
    variant = F.lower(F.conv(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8)).cast("string"), 10, 16))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))
