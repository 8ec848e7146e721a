"""The relations that the queries run on, derived from the tables, in DataFrames and in DuckDB SQL."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import STOP_WORDS, tokens
from lodestone.operators import embed, lexical_index, retrieve
from lodestone.operators._state import folder, kept
from lodestone.sources import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, and its SQL if SQL can express it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            # DuckDB reads 0.5 as a decimal and 0.5e0 as the double that Spark has
            ORACLE_SQL[f.__name__] = re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"\1e0", sql)
        return f

    return add


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as chunks: readable by their source's group, owned by their language's tenant."""
    date = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")), "yyyy-MM-dd")
    first = F.split("text", "\n")[0]
    return table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "doc_id", "text", "source", F.col("lang").alias("tenant"), date.alias("published"), F.array("source").alias("acl"), F.substring(first, 1, 60).alias("title"))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items as questions, in tokens of theirs. Two of three ask for the next item's text as well."""
    b = table(spark, sf, "benchmark")
    following = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("also"))
    words = F.concat(F.slice(tokens(F.col("text")), 1, 12), F.coalesce(F.slice(tokens(F.col("also")), 1, 6), F.array().cast("array<string>")))
    both = b.join(following, "item_id", "left").withColumn("also", F.when(F.col("item_id") % 3 > 0, F.col("also")))
    return both.select(F.col("item_id").alias("qid"), F.col("text").alias("anchor"), F.array_join(words, " ").alias("query"), "also")


def anchors(spark: SparkSession, sf: str) -> DataFrame:
    """(qid, anchor_idx, anchor): the texts that a question's evidence must hold, one or two."""
    texts = F.filter(F.array(F.struct(F.lit(0).alias("i"), F.col("anchor").alias("a")), F.struct(F.lit(1).alias("i"), F.col("also").alias("a"))), lambda x: x["a"].isNotNull())
    return questions(spark, sf).select("qid", F.explode(texts).alias("x")).select("qid", F.col("x.i").alias("anchor_idx"), F.col("x.a").alias("anchor"))


_made: dict[tuple, object] = {}


def once(spark: SparkSession, sf: str, name: str, make: Callable[[], object]):
    """What ``make`` returns for the documents and benchmark that are at ``sf`` now, made once in a session.

    What is made (an index, tables of vectors or gold) lies in the checkpoint folder and is read by every query
    over the same files; a file that changes makes it anew.
    """
    seen = []
    for part in ("documents", "benchmark"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/{part}.parquet")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
        seen += [(str(f.getPath()), f.getLen(), f.getModificationTime()) for f in files]
    key = (spark.sparkContext.applicationId, name, tuple(seen))
    if key not in _made:
        _made[key] = make()
    return _made[key]


def index_of(spark: SparkSession, sf: str) -> lexical_index.Index:
    """The kept lexical index of all chunks."""
    new = lambda: lexical_index.add(lexical_index.Index(f"{folder(spark)}/index-{uuid.uuid4().hex}"), "v1", chunks(spark, sf))
    return once(spark, sf, "lexical", new)


def with_heading(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks with the beginning of their second line as heading."""
    return chunks(spark, sf).withColumn("heading", F.coalesce(F.substring(F.get(F.split("text", "\n"), 1), 1, 40), F.lit("")))


def lexical(spark: SparkSession, sf: str, n: int) -> DataFrame:
    """BM25 hits of the questions over all chunks, from postings that are kept for every scoring of them."""
    return retrieve.score(once(spark, sf, "postings", lambda: retrieve.postings(questions(spark, sf), chunks(spark, sf))), n)


def chunk_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of all chunks, kept."""
    return once(spark, sf, "terms", lambda: retrieve.cut_terms(chunks(spark, sf)))


def chunk_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Hashed trigram vectors of all chunks, kept."""
    return once(spark, sf, "vectors", lambda: kept(embed.hashed_vectors(chunks(spark, sf), "chunk_id", "text")))


def gold_of(spark: SparkSession, sf: str) -> DataFrame:
    """(qid, anchor_idx, chunk_id) of the chunks that hold an anchor, kept."""
    return once(spark, sf, "gold", lambda: kept(retrieve.resolve_gold(anchors(spark, sf), chunks(spark, sf))))


def any_gold(gold: DataFrame) -> DataFrame:
    """(qid, chunk_id) of the chunks that hold any anchor of a question."""
    return gold.select("qid", "chunk_id").distinct()


def legs(spark: SparkSession, sf: str, n: int = 50):
    """Chunks, questions, and the lexical and the dense leg over them."""
    c, q = chunks(spark, sf), questions(spark, sf)
    return c, q, lexical(spark, sf, n), retrieve.knn(embed.hashed_vectors(q, "qid", "query"), chunk_vectors(spark, sf), n)


def tok(x: str) -> str:
    """SQL of the tokens of a text."""
    words = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"list_filter(list_transform(regexp_extract_all({x}, '[A-Za-z_][A-Za-z0-9_]+|\\d+(?:\\.\\d+)?'), lambda t: lower(t)), lambda t: length(t) > 1 AND t NOT IN ({words}))"


def norm(x: str) -> str:
    return f"lower(trim(regexp_replace({x}, '\\s+', ' ', 'g')))"


def sents(x: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"


C = "c AS (SELECT doc_id AS chunk_id, doc_id, text, source, lang AS tenant, strftime(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER), '%Y-%m-%d') AS published, substr(string_split(text, chr(10))[1], 1, 60) AS title FROM documents)"
Q = f"q AS (SELECT b.item_id AS qid, b.text AS anchor, n.text AS also, array_to_string(list_concat(list_slice({tok('b.text')}, 1, 12), coalesce(list_slice({tok('n.text')}, 1, 6), [])), ' ') AS query FROM benchmark b LEFT JOIN benchmark n ON n.item_id = b.item_id + 1 AND b.item_id % 3 > 0)"
TERMS = f"""ct AS (SELECT chunk_id, {tok('text')} AS t FROM c), dl AS (SELECT chunk_id, len(t) AS dl FROM ct),
st AS (SELECT count(*) AS n, avg(dl) AS a FROM dl),
p AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(t) AS term FROM ct) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({tok('query')}) AS term FROM q) GROUP BY ALL)"""


def bm(name: str, n: int, k1: float = 1.5, b: float = 0.75) -> str:
    """SQL of a BM25 leg."""
    score = f"round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * {k1 + 1} / (tf + {k1} * (1 - {b} + {b} * dl / a)))), 6)"
    return f"{name} AS MATERIALIZED (SELECT * FROM (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM (SELECT qid, chunk_id, {score} AS score FROM p JOIN df USING (term) JOIN qt USING (term) JOIN dl USING (chunk_id), st GROUP BY qid, chunk_id)) WHERE rank <= {n})"


def vec(name: str, source: str, key: str, text: str) -> str:
    """SQL of hashed trigram vectors (key, v) of a relation's texts."""
    return f"""{name} AS MATERIALIZED (WITH p AS (SELECT {key}, ' ' || regexp_replace(lower({text}), '\\s+', ' ', 'g') || ' ' AS s FROM {source}), t AS (SELECT {key}, substr(s, i, 3) AS t, count(*) AS n FROM (SELECT {key}, s, unnest(range(1, length(s) - 1)) AS i FROM p) GROUP BY ALL), h AS (SELECT {key}, n, ('0x' || substr(md5(t), 1, 8))::BIGINT AS h FROM t), b AS (SELECT {key}, h % 192 AS b, CAST(sum(CASE WHEN (h >> 8) & 1 = 1 THEN n ELSE -n END) AS BIGINT) AS n FROM h GROUP BY ALL), m AS (SELECT {key}, sqrt(sum(n * n)) AS m FROM b GROUP BY {key}), grid AS (SELECT {key}, unnest(range(192)) AS b FROM {source})
SELECT {key}, list(CASE WHEN coalesce(m, 0) > 0 THEN round(coalesce(n, 0) / m, 6) ELSE 0.0 END ORDER BY b) AS v FROM grid LEFT JOIN b USING ({key}, b) LEFT JOIN m USING ({key}) GROUP BY {key})"""


def near(name: str, n: int) -> str:
    """SQL of the dense leg over the vectors hq and hc."""
    return f"{name} AS MATERIALIZED (SELECT * FROM (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM (SELECT qid, chunk_id, round(list_dot_product(hq.v, hc.v), 6) AS score FROM hq, hc)) WHERE rank <= {n})"


GOLD = f"ga AS MATERIALIZED (SELECT DISTINCT qid, anchor_idx, chunk_id FROM (SELECT qid, 0 AS anchor_idx, anchor AS a FROM q UNION ALL SELECT qid, 1, also FROM q WHERE also IS NOT NULL) JOIN c ON contains({norm('c.text')}, {norm('a')})), g AS MATERIALIZED (SELECT DISTINCT qid, chunk_id FROM ga)"
BASE = f"WITH {C}, {Q}"
VECS = f"{vec('hq', 'q', 'qid', 'query')}, {vec('hc', 'c', 'chunk_id', 'text')}"
LEGS = f"{BASE}, {TERMS}, {bm('la', 50)}, {VECS}, {near('lb', 50)}, {GOLD}"
RRF = "fused AS (SELECT * FROM (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM (SELECT qid, chunk_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM (SELECT * FROM la UNION ALL SELECT * FROM lb) GROUP BY qid, chunk_id)) WHERE rank <= 20)"


def greedy(hits: str, k: int, x: str = "") -> str:
    """SQL of greedy nDCG: gd (qid, ndcg); ``x`` ends the names of what it defines."""
    return f"""hold{x} AS (SELECT qid, chunk_id, list_sort(list(DISTINCT anchor_idx)) AS an FROM ga GROUP BY ALL), gz{x} AS (WITH RECURSIVE z AS (SELECT qid, 0 AS pos, CAST([] AS INTEGER[]) AS seen, CAST(0.0 AS DOUBLE) AS gain FROM (SELECT DISTINCT qid FROM ga)
UNION ALL SELECT qid, pos + 1, CASE WHEN new IS NULL THEN seen ELSE list_append(seen, new) END, gain + CASE WHEN new IS NULL THEN 0.0 ELSE 1.0 / log2(pos + 2) END FROM (SELECT z.*, list_filter(coalesce(an, CAST([] AS INTEGER[])), lambda x: NOT list_contains(seen, x))[1] AS new FROM z LEFT JOIN {hits} h ON h.qid = z.qid AND h.rank = z.pos + 1 LEFT JOIN hold{x} w ON w.qid = z.qid AND w.chunk_id = h.chunk_id WHERE pos < {k})) SELECT qid, gain FROM z WHERE pos = {k}),
gd{x} AS (SELECT qid, round(gain / list_sum(list_transform(range(1, least(n, {k}) + 1), lambda i: 1.0 / log2(i + 1))), 6) AS ndcg FROM gz{x} JOIN (SELECT qid, count(DISTINCT anchor_idx) AS n FROM ga GROUP BY qid) USING (qid))"""


def per_question(hits: str, k: int, x: str = "") -> str:
    """SQL of the metrics of each question: pm (qid, evidence_recall, full_chain, mrr, ndcg)."""
    return f"""{greedy(hits, k, x)}, fr{x} AS (SELECT ga.qid, anchor_idx, min(h.rank) AS r FROM ga LEFT JOIN {hits} h ON h.qid = ga.qid AND h.chunk_id = ga.chunk_id AND h.rank <= {k} GROUP BY ALL),
pm{x} AS (SELECT q.qid, round(avg(CASE WHEN f.qid IS NOT NULL THEN CASE WHEN r IS NULL THEN 0.0 ELSE 1.0 END END), 6) AS evidence_recall, min(CASE WHEN f.qid IS NOT NULL THEN CASE WHEN r IS NULL THEN 0.0 ELSE 1.0 END END) AS full_chain, CASE WHEN count(f.qid) > 0 THEN round(coalesce(1.0 / min(r), 0.0), 6) END AS mrr, any_value(d.ndcg) AS ndcg FROM q LEFT JOIN fr{x} f USING (qid) LEFT JOIN gd{x} d USING (qid) GROUP BY q.qid)"""


def weighted_sql(alpha: float, n: int = 10) -> str:
    """SQL of the weighted fusion of la and lb; ``alpha`` is lb's share."""

    def scaled(leg: str, share: float) -> str:
        return f"SELECT qid, chunk_id, {share} * (score - min(score) OVER w) / CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE max(score) OVER w - min(score) OVER w END AS s FROM {leg} WINDOW w AS (PARTITION BY qid)"

    return f"SELECT qid, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM (SELECT qid, chunk_id, round(sum(s), 6) AS score FROM ({scaled('la', 1 - alpha)} UNION ALL {scaled('lb', alpha)}) GROUP BY qid, chunk_id)) WHERE rank <= {n}"


POISSON = "CASE WHEN u < 0.367879441 THEN 0 WHEN u < 0.735758882 THEN 1 WHEN u < 0.919698603 THEN 2 WHEN u < 0.981011843 THEN 3 WHEN u < 0.996340153 THEN 4 WHEN u < 0.999405815 THEN 5 WHEN u < 0.999916759 THEN 6 ELSE 7 END"


def resampled(rows: str, name: str, reps: int, seed: int = 11) -> str:
    """SQL of the means (rep, m) of (qid, d) under weights drawn for each replicate and question."""
    return f"{name} AS (SELECT rep, round(sum(w * d) / sum(w), 9) AS m FROM (SELECT rep, d, {POISSON} AS w FROM (SELECT rep, d, ('0x' || substr(md5('{seed}:' || rep || ':' || qid), 1, 8))::BIGINT / 4294967296.0 AS u FROM {rows}, (SELECT unnest(range({reps})) AS rep))) GROUP BY rep HAVING sum(w) > 0)"


def interval(means: str, reps: int) -> str:
    """SQL expressions of the bounds of resampled means."""
    return f"(SELECT round(list_sort(list(m))[{int(0.025 * reps) + 1}], 6) FROM {means}) AS lo, (SELECT round(list_sort(list(m))[{int(0.975 * reps)}], 6) FROM {means}) AS hi"
