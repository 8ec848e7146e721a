"""A Merkle manifest of a table: every row a leaf, a tree a source, a tree of the sources' roots, and proofs.

Levels are made one after the other by DataFrame operations: nodes carry their row number within their
source, the number divided by the fanout is their parent's, and a parent hashes the sorted array of its at most
``fanout`` children. So a group is never larger than the fanout, however many rows a source has. Numbers come
from ranges of the order: a row's number is its row_number() within its range plus the rows of the ranges
before, so no task sorts a whole source.

Proofs go down again: one join a level appends the path of the parent to each node's own siblings, from the
root to the groups of leaves, which then are spelled out row by row. Only nodes above the leaves are joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import written

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Ranges of the order for each shuffle partition, so that a partition's ranges even out.
RANGES = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """Lower-case hex sha256 of the parts, one behind the other."""
    return F.sha2(F.concat(*(p.cast("binary") for p in parts)), 256)


def field(value: Column) -> Column:
    """``-`` for null, else UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with ``i``, numbers from 0 within each ``group`` in the order of columns, and ``n``, rows of the group.

    ``rows`` must be kept, as equal ones are told apart by where they lie.
    """
    parts = RANGES * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(parts, group, *order, "_at")
    ranged = written(ranged.withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy(group, "_range").agg(F.count("*").alias("_size"))
    whole = Window.partitionBy(group)
    before = F.sum("_size").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(group, "_range", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_size").over(whole).alias("n"))
    inside = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order, "_at")) - 1
    placed = ranged.withColumn("_inside", inside).join(sizes, [group, "_range"])
    return placed.withColumn("i", F.col("_before") + F.col("_inside")).drop("_at", "_range", "_before", "_inside")


def _parents(nodes: DataFrame) -> DataFrame:
    """(s, p, n, kids): the groups of siblings of (s, i, n, h, ...), each with its children in order."""
    extra = [c for c in nodes.columns if c not in ("s", "n")]
    kids = F.array_sort(F.collect_list(F.struct("i", *(c for c in extra if c != "i"))))
    return nodes.groupBy("s", F.floor(F.col("i") / FANOUT).alias("p")).agg(F.max("n").alias("n"), kids.alias("kids"))


def _hashed(kids: str = "kids") -> Column:
    return digest(F.array_join(F.transform(kids, lambda k: k["h"]), ""))


def _tree(first: DataFrame) -> list[DataFrame]:
    """The groups of siblings of every level, from the bottom; ``first`` are those of the lowest."""
    levels = [written(first)]
    while True:
        above = levels[-1].filter(F.col("n") > 1).select("s", F.col("p").alias("i"), F.ceil(F.col("n") / FANOUT).alias("n"), _hashed().alias("h"))
        grown = written(_parents(above))
        if grown.isEmpty():
            return levels
        levels.append(grown)


def _tops(levels: list[DataFrame]) -> DataFrame:
    """(s, h): what remains of each tree, a lone node of some level."""
    tops = [level.filter(F.col("n") == 1).select("s", F.col("kids")[0]["h"].alias("h")) for level in levels]
    return reduce(DataFrame.unionByName, tops)


def _siblings(kids: str, at: Column) -> Column:
    """What stands before and behind child ``at`` of a group, as one step of a path."""
    text = lambda part: F.array_join(F.transform(part, lambda k: k["h"]), "")
    return F.struct(text(F.slice(kids, F.lit(1), at)).alias("before"), text(F.slice(kids, at + 2, F.lit(FANOUT))).alias("behind"))


def _spelled(groups: DataFrame, *carried: str) -> DataFrame:
    """Each child of some groups: s, kid, and path, its steps to the root. A lone top of a tree takes no step."""
    each = groups.select("s", "n", "kids", "path", *carried, F.posexplode("kids").alias("at", "kid"))
    step = F.concat(F.array(_siblings("kids", F.col("at"))), F.col("path"))
    return each.select("s", "kid", F.when(F.col("n") > 1, step).otherwise(F.col("path")).alias("path"), *carried)


def _paths(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest groups with ``path``, the steps from their parent to the root, and ``above``'s columns.

    ``above`` holds one row a tree: s, path and what each row is to carry on.
    """
    carried = [c for c in above.columns if c not in ("s", "path")]
    known = None
    for level in reversed(levels):
        groups = level.filter(F.col("n") == 1).join(above, "s")
        if known is not None:
            groups = groups.unionByName(level.filter(F.col("n") > 1).join(known, ["s", "p"]))
        if level is not levels[0]:
            spelled = _spelled(groups, *carried)
            known = written(spelled.select("s", F.col("kid.i").alias("p"), "path", *carried))
    return groups


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    A leaf is the hash of the fields doc_id, source, lang, n_chars and text. Rows of which 5 divides the unsigned
    crc32 of the decimal doc_id are tampered with (A-Z of the text lower-cased) before their root is folded
    again from leaf and proof; they verify if that changes nothing. ``proof_sha256`` is the hash of all siblings.
    Null fields are hashed as ``-``. Rows of a null source form a tree of their own, first of all. A null doc_id
    comes first in its source and is not tampered with; repeated rows are leaves of their own, next to each
    other, and ties of doc_id go by leaf. A lone row's leaf is its source's subroot and, of a lone source, the
    root. Texts of any length are hashed whole. An empty table gives no rows; other columns don't matter.
    """
    leaf = lambda text: digest(*(field(text if c == "text" else F.col(c)) for c in FIELDS))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf(F.translate("text", _UPPER, _LOWER)))
    # null sources come first and differ from empty ones
    tree = F.when(F.col("source").isNotNull(), F.concat(F.lit("s"), F.col("source"))).otherwise("").alias("s")
    leaves = written(docs.select(tree, "doc_id", leaf(F.col("text")).alias("h"), tampered.alias("t")))
    trees = _tree(_parents(numbered(leaves, "s", "doc_id", "h")))

    subroots = written(_tops(trees).select(F.lit("").alias("s"), F.col("s").alias("tree"), "h"))
    crown = _tree(_parents(numbered(subroots, "s", "tree")))
    root = _tops(crown).select("s", F.col("h").alias("root"), F.array().cast("array<struct<before:string,behind:string>>").alias("path"))
    of_tree = _spelled(_paths(crown, root), "root")
    above = written(of_tree.select(F.col("kid.tree").alias("s"), F.col("kid.h").alias("subroot"), "root", "path"))

    rows = _spelled(_paths(trees, above), "subroot", "root")
    proof = digest(F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["behind"])), ""))
    start = F.coalesce(F.col("kid.t"), F.col("kid.h"))
    folded = F.aggregate("path", start, lambda node, s: digest(s["before"], node, s["behind"]))
    out = rows.select(F.col("kid.doc_id").alias("doc_id"), F.col("kid.h").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: The same in DuckDB: the levels of all trees by recursion, with the tree of the subroots among them; then each
#: leaf's steps from the runs of its siblings, folded in turn. crc32 is spelled out bit by bit.
ORACLE_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT doc_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384::BIGINT ELSE 0 END))) AS left_over
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
), told AS (
  SELECT row_number() OVER () AS r, d.*, coalesce(xor(c.left_over, 4294967295) % 5 = 0, false) AS tampered FROM documents d LEFT JOIN crc c USING (doc_id)
), said AS (
  SELECT r, doc_id, source, tampered,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS body,
    coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS lowered
  FROM told
), leaf AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS i
  FROM (SELECT r, doc_id, source, sha256(head || body) AS h, sha256(head || CASE WHEN tampered THEN lowered ELSE body END) AS t FROM said)
), node AS (
  SELECT 0 AS level, source, i, h, count(*) OVER (PARTITION BY source) AS n FROM leaf
  UNION ALL
  SELECT level + 1, source, i // 16, sha256(string_agg(h, '' ORDER BY i)), (n + 15) // 16 FROM node WHERE n > 1 GROUP BY level, source, i // 16, n
), subroot AS MATERIALIZED (
  SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i FROM node WHERE n = 1
), top AS (
  SELECT 0 AS level, i, h, count(*) OVER () AS n FROM subroot
  UNION ALL
  SELECT level + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (n + 15) // 16 FROM top WHERE n > 1 GROUP BY level, i // 16, n
), climb AS (
  SELECT r, source, 0 AS level, i AS at FROM leaf
  UNION ALL
  SELECT c.r, c.source, c.level + 1, c.at // 16 FROM climb c JOIN node x ON x.level = c.level AND x.source IS NOT DISTINCT FROM c.source AND x.i = c.at WHERE x.n > 1
), ascent AS (
  SELECT source, 0 AS level, i AS at FROM subroot
  UNION ALL
  SELECT c.source, c.level + 1, c.at // 16 FROM ascent c JOIN top x ON x.level = c.level AND x.i = c.at WHERE x.n > 1
), step AS MATERIALIZED (
  SELECT r, c.level, coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i < c.at), '') AS before, coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i > c.at), '') AS behind
  FROM climb c JOIN node x ON x.level = c.level AND x.source IS NOT DISTINCT FROM c.source AND x.i // 16 = c.at // 16 WHERE x.n > 1 GROUP BY r, c.level
  UNION ALL
  SELECT l.r, 1000 + c.level, coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i < c.at), ''), coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i > c.at), '')
  FROM leaf l JOIN ascent c ON c.source IS NOT DISTINCT FROM l.source JOIN top x ON x.level = c.level AND x.i // 16 = c.at // 16 WHERE x.n > 1 GROUP BY l.r, c.level
), path AS (
  SELECT r, string_agg(before || behind, '' ORDER BY level) AS siblings, list({'a': before, 'b': behind} ORDER BY level) AS steps FROM step GROUP BY r
), fold AS (
  SELECT r, 0 AS done, t AS h FROM leaf
  UNION ALL
  SELECT f.r, done + 1, sha256(steps[done + 1].a || f.h || steps[done + 1].b) FROM fold f JOIN path p ON p.r = f.r WHERE done < len(steps)
)
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(coalesce(p.siblings, '')) AS proof_sha256,
  f.h AS folded_root, f.h = (SELECT h FROM top WHERE n = 1) AS verified
FROM leaf l JOIN subroot s ON s.source IS NOT DISTINCT FROM l.source LEFT JOIN path p ON p.r = l.r JOIN (SELECT r, max_by(h, done) AS h FROM fold GROUP BY r) f ON f.r = l.r
"""
