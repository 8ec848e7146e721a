"""Pattern search over a trigram index: regular expressions are run only on chunks that hold what they require.

A pattern is analysed into clauses; a clause is one or more alternatives, an alternative is the trigrams of
literals that stand together. A chunk that a pattern matches holds, of each clause, all trigrams of some
alternative. Patterns without a literal of three letters are run on every chunk.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators._state import kept, sized
from lodestone.operators.retrieve import grep, top

Clause = list[frozenset[str]]
_parser = re._parser


def _trigrams(run: str) -> frozenset[str]:
    return frozenset(run[i : i + 3] for i in range(len(run) - 2))


def _clauses(items) -> list[Clause]:
    """What a parsed sequence requires. Anything but a plain letter ends a run of literals."""
    found: list[Clause] = []
    run = ""

    def end() -> None:
        nonlocal run
        if len(run) > 2:
            found.append([_trigrams(run)])
        run = ""

    for kind, value in items:
        name = str(kind)
        if name == "LITERAL" and value < 128:
            run += chr(value).lower()
            continue
        end()
        if name == "SUBPATTERN":
            found += _clauses(value[-1])
        elif name == "ATOMIC_GROUP":
            found += _clauses(value)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
            found += _clauses(value[2])
        elif name == "BRANCH":
            ways = [_clauses(way) for way in value[1]]
            # of each way one clause that is a single alternative or a choice of some; all ways need one
            if all(ways):
                found.append([alternative for way in ways for alternative in max(way, key=lambda c: min(map(len, c)))])
    end()
    return found


def required(pattern: str) -> list[Clause]:
    """The clauses of a pattern; none if it requires nothing that an index could tell, or can't be read."""
    try:
        return _clauses(_parser.parse(pattern))
    except (re.error, OverflowError, RecursionError):
        return []


def trigram_index(chunks: DataFrame) -> DataFrame:
    """(gram, chunk_id) of all trigrams of the lower-cased texts, kept in order of trigrams so that files can be skipped."""
    low = F.lower(F.coalesce("text", F.lit("")))
    cut = kept(chunks.select("chunk_id", low.alias("t")))
    grams = F.regexp_extract_all("t", F.lit("(?s)(?=(...))"), F.lit(1))  # a substring by its place would start from the beginning each time
    rows = cut.filter(F.length("t") > 2).select("chunk_id", F.explode(F.array_distinct(grams)).alias("gram"))
    return kept(rows.repartitionByRange("gram", "chunk_id").sortWithinPartitions("gram"))


def candidates(patterns: DataFrame, index: DataFrame) -> tuple[DataFrame, list]:
    """(qid, chunk_id) that hold what each of (qid, pattern) requires, and the qids of patterns that require nothing."""
    spark = patterns.sparkSession
    rows, clauses, loose = [], [], []
    for r in patterns.select("qid", "pattern").collect():  # the stated side
        need = required(r.pattern)
        if not need:
            loose.append(r.qid)
            continue
        clauses.append((r.qid, len(need)))
        rows += [(r.qid, c, a, len(grams), g) for c, clause in enumerate(need) for a, grams in enumerate(clause) for g in sorted(grams)]
    kind = patterns.schema["qid"].dataType.simpleString()
    wanted = spark.createDataFrame(rows, f"qid {kind}, clause int, alternative int, n int, gram string")
    whole = spark.createDataFrame(clauses, f"qid {kind}, clauses int")
    grams = index.filter(F.col("gram").isin(*{r[4] for r in rows})) if len(rows) <= 2_000 else index
    met = grams.join(F.broadcast(wanted), "gram").groupBy("qid", "clause", "alternative", "chunk_id", "n").agg(F.count("*").alias("got")).filter("got = n")
    held = met.groupBy("qid", "chunk_id").agg(F.count_distinct("clause").alias("held"))
    return held.join(F.broadcast(whole), "qid").filter("held = clauses").select("qid", "chunk_id"), loose


def search(patterns: DataFrame, chunks: DataFrame, index: DataFrame, n: int = 20) -> DataFrame:
    """``retrieve.grep``, case ignored, with texts fetched for the candidates alone."""
    found, loose = candidates(patterns, index)
    pairs = kept(found)
    few, _ = sized(pairs, 32)
    texts = chunks.select("chunk_id", "text").join(few, "chunk_id").join(F.broadcast(patterns.select("qid", F.concat(F.lit("(?i)"), "pattern").alias("p"))), "qid")
    counted = texts.select("qid", "chunk_id", F.regexp_count("text", F.col("p")).cast("double").alias("score")).filter("score > 0")
    hits = top(counted, n).select("qid", "chunk_id", "score", "rank")
    return hits.unionByName(grep(patterns.filter(F.col("qid").isin(*loose)), chunks, n)) if loose else hits
