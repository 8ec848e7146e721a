"""Quality rules: measures of one text, and the frequency of its lines across documents of its host.

Only DataFrame functions. A line is normalised (lower case, white space as one space, digits as 0) and
hashed; for each host the distinct documents with that line are counted, equal texts as one document, so
that copying a document does not turn its lines into boilerplate. Lines of more than ``line_share`` of the
host's distinct documents, and of more than ``line_floor``, are removed. A document is depleted, and
rejected, if that leaves less than ``least_left`` of its words or fewer words than the base rule asks for.

Rows that are shuffled hold hashes and counts, never text, and are counted from partial counts, so a hot
line or host does not meet in one task. A host has at most ``1 / line_share`` times its documents' mean
number of lines above the limit, so its frequent lines are one array, which its documents are checked
against where they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import durable, within

#: Lines of more than this share of a host's distinct documents are removed, if they are in more than the floor.
LINE_SHARE = 0.05
LINE_FLOOR = 5
LEAST_LEFT = 0.3
LEAST_WORDS = 50
#: White space, by the rule of this operator.
SPACE = r"[\x20\x09-\x0D]+"


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    The rows go along as one value, so that names used here can't clash with theirs.
    """
    out = df.select(F.struct(*(df[f"`{c}`"] for c in df.columns)).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("whole"))
    out = out.withColumns({"w": F.filter(F.split("whole", SPACE, -1), lambda w: w != ""), "lines": F.filter(F.split("whole", "\n", -1), _has_word)})
    out = out.withColumns(
        {
            "n_words": F.size("w").cast("long"),
            "word_chars": F.length(F.regexp_replace("whole", SPACE, "")).cast("long"),
            "n_symbols": (F.length("whole") - F.length(F.translate("whole", "#*$%&|<>", ""))).cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            # hashes of all three-word windows with their places, in order of the hash
            "windows": F.when(F.size("w") > 3, F.sort_array(F.expr("transform(sequence(1, size(w) - 2), i -> struct(xxhash64(w[i - 1], w[i], w[i + 1]) AS h, i AS i))"))),
        }
    )
    # neighbours with one hash are repeated windows; the words of a place set are counted once
    out = out.withColumn("same", F.expr("zip_with(slice(windows, 1, size(windows) - 1), slice(windows, 2, size(windows) - 1), (a, b) -> if(a.h = b.h, array(a.i, b.i), array()))"))
    out = out.withColumn("places", F.sort_array(F.array_distinct(F.flatten("same"))))
    gaps = F.expr("zip_with(slice(places, 1, size(places) - 1), slice(places, 2, size(places) - 1), (a, b) -> least(3, b - a))")
    repeated = F.when(F.size("places") > 0, F.aggregate(gaps, F.lit(3), lambda a, x: a + x)).otherwise(0)
    out = out.withColumn("n_repeat_words", F.coalesce(repeated, F.lit(0)).cast("long"))
    out = out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.select(*(F.col("row")[c].alias(c) for c in df.columns if c not in MEASURES), *MEASURES)


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[0-9]", "0"), SPACE, " "))


def _identity(df: DataFrame, text: str, host: str, *more: Column) -> DataFrame:
    """The host, hash and size of each text; equal ones are one document."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return df.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.xxhash64(whole).alias("doc"), F.octet_length(whole).alias("bytes"), *more)


def frequent_lines(df: DataFrame, text: str = "text", host: str = "source", line_share: float = LINE_SHARE, line_floor: int = LINE_FLOOR) -> DataFrame:
    """(host, lines): the hashes of each host's frequent normalised lines, in one array; hosts without any are left out."""
    whole = F.coalesce(F.col(text), F.lit(""))
    hashes = F.array_distinct(F.transform(F.filter(F.split(whole, "\n", -1), _has_word), lambda x: F.xxhash64(_normal(x))))
    lines = _identity(df, text, host, F.explode(hashes).alias("line")).distinct()
    counted = lines.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") > line_floor)
    sizes = _identity(df, text, host).distinct().groupBy("host").agg(F.count("*").alias("n_docs"))
    frequent = counted.join(sizes, "host").filter(F.col("n") > line_share * F.col("n_docs"))
    return frequent.groupBy("host").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def quality(df: DataFrame, text: str = "text", host: str = "source", line_share: float = LINE_SHARE, line_floor: int = LINE_FLOOR, least_left: float = LEAST_LEFT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``df`` with the measures, removed_words, depleted, kept and cleaned (the text without frequent lines).

    Null and empty texts have no words and fail the base rule; ``cleaned`` is null for null. A null host is
    a host of its own. Repeated rows and copies get equal verdicts; a line that repeats inside a text counts
    once for it, and all its repetitions are removed. A line exactly at the limit stays. Texts of any length
    are judged whole, null ids like any others; an empty table stays empty. Existing columns of the names
    above are replaced, and no other column, whatever its name, is lost.
    """
    taken = set(df.columns)
    host_key, lines, found = (next(n for n in (f"_{name}{'_' * i}" for i in range(len(taken) + 1)) if n not in taken) for name in ("host", "frequent", "found"))
    frequent = durable(frequent_lines(df, text, host, line_share, line_floor)).select(F.col("host").alias(host_key), F.col("lines").alias(lines))
    frequent = within(frequent, F.octet_length(host_key) + 8 * F.size(lines) + 32)
    whole = F.coalesce(F.col(text), F.lit(""))
    out = measures(df, text).withColumn(host_key, F.coalesce(F.col(host).cast("string"), F.lit("")))
    out = out.join(frequent, host_key, "left").drop(host_key)
    parts = F.transform(F.split(whole, "\n", -1), lambda x: F.struct(x.alias("line"), F.array_contains(F.col(lines), F.xxhash64(_normal(x))).alias("gone")))
    out = out.withColumn(found, F.when(F.col(lines).isNotNull(), parts)).drop(lines)
    gone = F.filter(F.col(found), lambda p: p["gone"] & _has_word(p["line"]))
    n_words = F.aggregate(gone, F.lit(0), lambda n, p: n + F.size(F.filter(F.split(p["line"], SPACE, -1), lambda w: w != "")))
    left = F.array_join(F.transform(F.filter(F.col(found), lambda p: ~(p["gone"] & _has_word(p["line"]))), lambda p: p["line"]), "\n")
    out = out.withColumn("removed_words", F.coalesce(n_words, F.lit(0)).cast("long"))
    out = out.withColumn("cleaned", F.when(F.col("removed_words") > 0, left).otherwise(F.col(text))).drop(found)
    rest = F.col("n_words") - F.col("removed_words")
    out = out.withColumn("depleted", (F.col("removed_words") > 0) & ((rest < least_left * F.col("n_words")) | (rest < least_words)))
    # one sum of both verdicts: a filter on it stays above the join, instead of going down in halves and
    # taking copies of the measures' expressions along
    return out.withColumn("kept", F.col("base_failed").cast("int") + F.col("depleted").cast("int") == 0)


ORACLE_SQL = rf"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n
  FROM (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t))
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM win WHERE n > 1) GROUP BY doc_id
), ln AS (
  SELECT host, text, trim(regexp_replace(regexp_replace(lower(x), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line,
         sum(len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))) AS n
  FROM (SELECT host, text, unnest(lines) AS x FROM (SELECT DISTINCT host, text, lines FROM t)) GROUP BY ALL
), hosts AS (SELECT host, count(DISTINCT text) AS n_docs FROM t GROUP BY host), often AS (
  SELECT host, line FROM ln JOIN hosts USING (host) GROUP BY host, line
  HAVING count(*) > {LINE_FLOOR} AND count(*) > {LINE_SHARE}e0 * any_value(n_docs)
), gone AS (
  SELECT host, text, sum(n) AS n FROM ln JOIN often USING (host, line) GROUP BY host, text
), m AS (
  SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(gone.n, 0) AS removed
  FROM t LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (host, text)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words)
         AND NOT (removed > 0 AND (n_words - removed < {LEAST_LEFT}e0 * n_words OR n_words - removed < {LEAST_WORDS})) AS kept
FROM m
"""
