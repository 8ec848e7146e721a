"""Chunking: one document (doc_id, title, text) to rows (doc_id, ordinal, text), with ids by content."""

from __future__ import annotations

import functools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import approx_tokens, sentences, sentences_of, tokens
from lodestone.operators._state import ship


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))


def _each(rows: DataFrame, array: Column | str, place: str, item: str, *own: str | Column) -> DataFrame:
    """``own`` columns beside place and item of every entry of an array.

    From a plain posexplode Spark infers a filter for arrays that aren't empty, which makes them anew, and what they
    are made of once for each place that names it.
    """
    return rows.select(*own, F.posexplode_outer(array).alias(place, item)).filter(F.col(place).isNotNull())


def window_size(size_tokens: int) -> int:
    """Words of a window for a size in tokens."""
    return max(20, int(size_tokens * 0.75))


def windows(words: Column, per: int, overlap: float) -> Column:
    """Texts of windows of ``per`` words; the last one ends with the text, none for no words."""
    if not 0 <= overlap < 1:
        raise ValueError("overlap must be at least 0 and less than 1")
    step = max(1, int(per * (1 - overlap)))
    last = F.greatest(F.lit(0), F.ceil((F.size(words) - per) / step)).cast("int")
    starts = F.transform(F.sequence(F.lit(0), last), lambda i: i * step)
    return F.when(F.size(words) > 0, F.transform(starts, lambda s: F.array_join(F.slice(words, s + 1, per), " "))).otherwise(F.array().cast("array<string>"))


def finalized(pieces: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, ordinal, n_chunks, text, chunk_id) from (doc, ordinal, text); the id addresses the text."""
    return _identified(pieces.withColumn("n_chunks", F.count("*").over(Window.partitionBy(doc))), doc)


def _identified(pieces: DataFrame, doc: str) -> DataFrame:
    text = F.trim("text")
    identity = F.concat_ws(":", F.col(doc).cast("string"), F.col("ordinal").cast("string"), F.substring(F.sha1(text.cast("binary")), 1, 10))
    return pieces.select(doc, "ordinal", "n_chunks", text.alias("text"), identity.alias("chunk_id"))


def numbered(docs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``finalized`` from (doc, pieces), arrays of texts: pieces are counted while a document is one row."""
    counted = docs.select(doc, "pieces", F.sum(F.size("pieces")).over(Window.partitionBy(doc)).alias("n_chunks"))
    return _identified(_each(counted, "pieces", "ordinal", "text", doc, "n_chunks"), doc)


def fixed(docs: DataFrame, size_tokens: int = 512, overlap: float = 0.15) -> DataFrame:
    """Windows of words with an overlap; heading lines are left out."""
    body = docs.select("doc_id", _words(F.regexp_replace("text", r"(?m)^## .*$", "")).alias("w"))
    return numbered(body.select("doc_id", windows(F.col("w"), window_size(size_tokens), overlap).alias("pieces")))


def passages(docs: DataFrame) -> DataFrame:
    """(doc_id, title, passage, text): the non-blank lines of a document."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return _each(docs, lines, "passage", "text", "doc_id", "title")


def structural(docs: DataFrame, size_tokens: int = 256) -> DataFrame:
    """A chunk for each passage under its title; longer passages in windows with a tenth of overlap."""
    per = window_size(size_tokens)
    # only longer passages are cut into words
    parts = passages(docs).withColumn("w", F.when(F.regexp_count("text", F.lit(r"\S+")) > per, _words(F.col("text"))))
    split = parts.withColumn("piece", F.when(F.col("w").isNotNull(), windows(F.col("w"), per, 0.1)).otherwise(F.array(F.trim("text"))))
    flat = _each(split, "piece", "n", "t", "doc_id", "passage", "title")
    ordinal = (F.row_number().over(Window.partitionBy("doc_id").orderBy("passage", "n")) - 1).alias("ordinal")
    return finalized(flat.select("doc_id", ordinal, F.concat("title", F.lit("\n"), "t").alias("text")))


def contextual(docs: DataFrame, size_tokens: int = 256, describe: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Structural chunks behind a sentence that says what they are from (first entities, else the title).

    ``describe`` may say it otherwise: given the documents it returns (doc_id, about).
    """
    about = describe(docs).select("doc_id", "about") if describe else docs.select("doc_id", F.when(F.size("entities") > 0, F.array_join(F.slice("entities", 1, 3), ", ")).otherwise(F.col("title")).alias("about"))
    chunks = structural(docs, size_tokens).join(about, "doc_id")
    return finalized(chunks.select("doc_id", "ordinal", F.concat(F.lit("From a document about "), "about", F.lit(".\n"), "text").alias("text")))


def late(docs: DataFrame, size_tokens: int = 256, context_tokens: int = 90) -> DataFrame:
    """Structural chunks with an embed_text that starts with the document's first distinct tokens.

    The id keeps addressing the readable text.
    """
    context = docs.select("doc_id", F.array_join(F.slice(F.array_distinct(tokens(F.col("text"))), 1, context_tokens), " ").alias("c"))
    return structural(docs, size_tokens).join(context, "doc_id").withColumn("embed_text", F.concat(F.lit("[doc-context] "), "c", F.lit("\n"), "text")).drop("c")


def parent(docs: DataFrame, child_tokens: int = 180, parent_tokens: int = 900) -> DataFrame:
    """(doc_id, parent, child, heading, text): child windows that carry their parent window's text."""
    outer = _each(docs.select("doc_id", _words(F.col("text")).alias("w")), windows(F.col("w"), window_size(parent_tokens), 0.0), "parent", "text", "doc_id")
    inner = _each(outer.withColumn("w", _words(F.col("text"))), windows(F.col("w"), window_size(child_tokens), 0.0), "child", "c", "doc_id", "parent", "text")
    return inner.select("doc_id", "parent", "child", F.concat(F.lit("child::"), F.substring("c", 1, 80)).alias("heading"), "text")


def _packed(parts: str, per: int, joiner: str) -> Column:
    """SQL fold that packs an array of texts into pieces of at most ``per`` words, longer ones alone."""
    return F.expr(
        f"aggregate({parts}, named_struct('done', cast(array() AS array<string>), 'cur', '', 'n', 0), "
        f"(s, x) -> named_struct("
        f"'done', if(s.n > 0 AND s.n + size(split(x, ' ')) > {per}, concat(s.done, array(s.cur)), s.done), "
        f"'cur', if(s.n = 0 OR s.n + size(split(x, ' ')) > {per}, x, concat(s.cur, '{joiner}', x)), "
        f"'n', if(s.n > 0 AND s.n + size(split(x, ' ')) > {per}, size(split(x, ' ')), s.n + size(split(x, ' ')))), "
        f"s -> if(s.n > 0, concat(s.done, array(s.cur)), s.done))"
    )


def recursive(docs: DataFrame, size_tokens: int = 256, overlap: float = 0.1) -> DataFrame:
    """Paragraphs packed up to the size, longer ones by sentence; each piece starts with the tail of the one before."""
    per = window_size(size_tokens)
    paragraphs = F.filter(F.transform(F.split("text", "\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")
    fine = F.flatten(F.transform(paragraphs, lambda p: F.when(F.size(F.split(p, " ")) > per, sentences(p)).otherwise(F.array(p))))
    packed = docs.select("doc_id", fine.alias("parts")).select("doc_id", _packed("parts", per, " ").alias("pieces"))
    flat = _each(packed, "pieces", "ordinal", "piece", "doc_id")
    before = F.split(F.lag("piece").over(Window.partitionBy("doc_id").orderBy("ordinal")), " ")
    tail = F.greatest(F.lit(1), F.floor(F.size(before) * overlap)).cast("int")
    text = F.when(before.isNull(), F.col("piece")).otherwise(F.concat_ws(" ", F.array_join(F.slice(before, -tail, tail), " "), "piece"))
    return finalized(flat.select("doc_id", "ordinal", text.alias("text")))


def _joined(text: str, per: int, threshold: float) -> list[str]:
    """``semantic`` of one text inside a task. A sentence is compared with the one before it only, once."""
    pieces, own, last, n = [], [], set(), 0
    for sentence, terms in sentences_of(text):
        # parts between white space, as split() would leave out an empty one at either end
        size = len(sentence.split()) + sentence[:1].isspace() + sentence[-1:].isspace()
        if own:
            stay = n + size <= per
            if stay:
                both = len(last & terms)
                either = len(last) + len(terms) - both
                stay = either > 0 and both / either >= threshold
            if not stay:
                pieces.append(b" ".join(own).decode("utf-8", "surrogatepass"))
                own, n = [], 0
        own.append(sentence)
        last, n = terms, n + size
    return [*pieces, b" ".join(own).decode("utf-8", "surrogatepass")] if own else pieces


def semantic(docs: DataFrame, size_tokens: int = 256, threshold: float = 0.22) -> DataFrame:
    """Sentences joined until the next one shares too few tokens with the last, or the size is reached."""
    ship(docs.sparkSession)
    per = window_size(size_tokens)

    @F.pandas_udf("array<string>")
    def joined(texts: pd.Series) -> pd.Series:
        return pd.Series([_joined(text, per, threshold) for text in texts], dtype=object)

    return numbered(docs.select("doc_id", joined(F.coalesce("text", F.lit(""))).alias("pieces")))


def parent_chunks(docs: DataFrame, size_tokens: int = 180, parent_tokens: int = 900) -> DataFrame:
    """Child windows as chunks of their parent's text, under a heading that begins like the child."""
    rows = parent(docs, size_tokens, parent_tokens)
    ordinal = (F.row_number().over(Window.partitionBy("doc_id").orderBy("parent", "child")) - 1).alias("ordinal")
    return finalized(rows.select("doc_id", ordinal, "text"))


STRATEGIES = {"parent": parent_chunks, "fixed": fixed, "recursive": recursive, "structural": structural, "semantic": semantic, "contextual": contextual, "late": late}


def chunk(docs: DataFrame, strategy: str, **parameters) -> DataFrame:
    """Chunks by the name of a strategy."""
    if strategy not in STRATEGIES:
        raise KeyError(f"no chunking strategy {strategy!r}; there are {sorted(STRATEGIES)}")
    return STRATEGIES[strategy](docs, **parameters)


def chunk_stats(chunks: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """Number, median, 90th percentile, maximum and sum of the chunks' approximate tokens, and how many times those
    of a baseline's chunks they take; sizes are counted before they are ranked."""
    from lodestone.operators._state import kept
    from lodestone.operators.metrics import ranked_value

    sizes = kept(chunks.select(approx_tokens(F.col("text")).alias("n")))
    base = (baseline if baseline is not None else chunks).agg(F.sum(approx_tokens(F.col("text"))).alias("base"))
    out = sizes.agg(F.count("*").alias("chunks"), F.floor(F.median("n")).cast("long").alias("median"), F.max("n").alias("largest"), F.sum("n").alias("total"))
    return out.crossJoin(ranked_value(sizes, "n", 0.9, from_zero=True).select(F.col("value").alias("p90"))).crossJoin(base).select("chunks", "median", "p90", "largest", "total", F.round(F.col("total") / F.col("base"), 6).alias("storage_x"))


def boundary_damages(anchors: DataFrame, docs: DataFrame, strategies: dict[str, DataFrame]) -> DataFrame:
    """A row (strategy, in_documents, in_chunks, damage) for the chunks of each strategy: anchors (anchor) that some
    document holds, those that some chunk still holds, and the share that the boundaries of chunks cut."""
    from lodestone.operators._state import kept
    from lodestone.operators.retrieve import holders

    ids = anchors.select("anchor").distinct().withColumn("qid", F.xxhash64("anchor"))
    whole = kept(holders(ids, docs.select("text")).distinct())
    parts = []
    for name, chunks in strategies.items():
        cut = holders(ids, chunks.select("text")).distinct().withColumn("k", F.lit(1))
        both = whole.join(cut, "qid", "left").agg(F.count("*").alias("in_documents"), F.count("k").alias("in_chunks"))
        parts.append(both.select(F.lit(name).alias("strategy"), "*"))
    share = F.when(F.col("in_documents") > 0, 1 - F.col("in_chunks") / F.col("in_documents")).otherwise(0.0)
    return functools.reduce(DataFrame.unionByName, parts).withColumn("damage", F.round(share, 6))


def boundary_damage(anchors: DataFrame, docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """``boundary_damages`` of one strategy: one row (in_documents, in_chunks, damage)."""
    return boundary_damages(anchors, docs, {"": chunks}).drop("strategy")
