"""Packing: greedy folds over the ranked hits of a query, and the order of what is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ranked(hits: DataFrame, *fields: str) -> DataFrame:
    return hits.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", *fields))).alias("h"))


def dedup(hits: DataFrame, threshold: float = 0.82) -> DataFrame:
    """Drops each hit of (qid, rank, chunk_id, tokens) that is too like one kept before; ranks anew."""
    fold = F.expr(
        "aggregate(h, cast(array() AS array<struct<rank:int,chunk_id:bigint,tokens:array<string>>>), "
        f"(kept, x) -> if(exists(kept, k -> size(array_union(k.tokens, x.tokens)) > 0 AND size(array_intersect(k.tokens, x.tokens)) / size(array_union(k.tokens, x.tokens)) >= {threshold}), kept, concat(kept, array(named_struct('rank', x.rank, 'chunk_id', x.chunk_id, 'tokens', x.tokens)))))"
    )
    kept = _ranked(hits.withColumns({"rank": F.col("rank").cast("int"), "chunk_id": F.col("chunk_id").cast("bigint")}), "tokens").select("qid", F.posexplode(fold).alias("at", "x"))
    return kept.select("qid", "x.chunk_id", (F.col("at") + 1).alias("rank"))


def pack(hits: DataFrame, k: int = 8, cap: int = 6000) -> DataFrame:
    """Takes up to ``k`` hits of (qid, rank, chunk_id, n_tokens) in order, skipping those beyond the cap."""
    fold = F.expr(
        "aggregate(h, named_struct('used', 0L, 'ids', cast(array() AS array<bigint>)), "
        f"(s, x) -> named_struct('used', if(size(s.ids) < {k} AND s.used + x.n_tokens <= {cap}, s.used + x.n_tokens, s.used), "
        f"'ids', if(size(s.ids) < {k} AND s.used + x.n_tokens <= {cap}, concat(s.ids, array(cast(x.chunk_id AS bigint))), s.ids)))"
    )
    packed = _ranked(hits.withColumn("n_tokens", F.col("n_tokens").cast("long")), "n_tokens").select("qid", fold.alias("s"))
    return packed.select("qid", "s.used", F.posexplode("s.ids").alias("at", "chunk_id")).select("qid", "chunk_id", (F.col("at") + 1).alias("rank"), "used")


def edges_order(packed: DataFrame) -> DataFrame:
    """The second best goes last where there are three or more, so that both ends hold the best."""
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy("qid"))
    place = F.when((n < 3) | (F.col("rank") == 1), F.col("rank")).when(F.col("rank") == 2, n).otherwise(F.col("rank") - 1)
    return packed.select("qid", "chunk_id", place.cast("int").alias("place"))


def quota(hits: DataFrame, entities: DataFrame, k: int = 8, cap: int = 6000) -> DataFrame:
    """First a share of slots for each entity of a question in order, then the best of the rest, all under the cap.

    ``hits`` is (qid, rank, chunk_id, text, n_tokens), ``entities`` (qid, entity). A hit that an entity has
    taken is no other one's; one that doesn't fit is skipped.
    """
    names = entities.groupBy("qid").agg(F.array_sort(F.collect_set("entity")).alias("names"))
    about = F.filter(F.transform("names", lambda e: F.when(F.contains(F.lower("text"), F.lower(e)), e)), lambda e: e.isNotNull())
    marked = hits.join(names, "qid", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>"))).withColumn("about", about)
    rows = marked.withColumns({"rank": F.col("rank").cast("int"), "n_tokens": F.col("n_tokens").cast("long")}).groupBy("qid").agg(F.first("names").alias("names"), F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "n_tokens", "about"))).alias("h"))
    kind = hits.schema["chunk_id"].dataType.simpleString()
    fits = f"NOT array_contains(z.ids, x.chunk_id) AND z.used + x.n_tokens <= {cap}"

    def take(when: str) -> str:
        return f"(z, x) -> if({when} AND {fits}, named_struct('used', z.used + x.n_tokens, 'ids', concat(z.ids, array(x.chunk_id)), 'n', z.n + 1), z)"

    share = f"greatest(1, {k} div greatest(1, size(names)))"
    start = f"named_struct('used', 0L, 'ids', cast(array() AS array<{kind}>), 'n', 0)"
    reserved = f"aggregate(names, {start}, (s, e) -> aggregate(h, named_struct('used', s.used, 'ids', s.ids, 'n', 0), {take(f'z.n < {share} AND array_contains(x.about, e)')}))"
    filled = rows.withColumn("r", F.expr(reserved)).withColumn("f", F.expr(f"aggregate(h, r, {take(f'size(z.ids) < {k}')})"))
    out = filled.select("qid", F.size("r.ids").alias("n_reserved"), F.posexplode("f.ids").alias("at", "chunk_id"))
    return out.select("qid", "chunk_id", (F.col("at") + 1).alias("place"), (F.col("at") < F.col("n_reserved")).alias("reserved"))


def entity_shares(packed: DataFrame, chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """(qid, weakest, prevalence): the least share of packed chunks that any entity of a question has among those
    that any has, and how many times more chunks of the corpus hold its most common entity than its rarest."""
    has = F.contains(F.lower("text"), F.lower("entity"))
    # a text is lowered once, not once for each entity that it is searched for
    named = F.broadcast(entities.select("entity", F.lower("entity").alias("_e")).distinct())
    overall = chunks.select(F.lower("text").alias("_t")).join(named, F.contains("_t", "_e")).groupBy("entity").agg(F.count("*").alias("in_corpus"))
    mine = packed.select("qid", "chunk_id").join(chunks.select("chunk_id", "text"), "chunk_id").join(entities, "qid").filter(has).groupBy("qid", "entity").agg(F.count("*").alias("n"))
    per = entities.join(mine, ["qid", "entity"], "left").join(overall, "entity", "left").na.fill(0, ["n", "in_corpus"])
    out = per.groupBy("qid").agg(F.min("n").alias("low"), F.sum("n").alias("all"), F.max("in_corpus").alias("most"), F.min("in_corpus").alias("least"))
    return out.select("qid", F.round(F.when(F.col("all") > 0, F.col("low") / F.col("all")), 6).alias("weakest"), F.round(F.col("most") / F.greatest(F.lit(1), "least"), 6).alias("prevalence"))


def k_collapse(hits: DataFrame, acl: DataFrame, groups: DataFrame, k: int = 8) -> DataFrame:
    """Packed hits before and after a filter by (qid, groups) that comes too late, and how many it took."""
    packed = hits.filter(F.col("rank") <= k).join(acl.select("chunk_id", "acl"), "chunk_id").join(groups, "qid")
    may = F.arrays_overlap("acl", "groups")
    return packed.groupBy("qid").agg(F.count("*").alias("before"), F.count_if(may).alias("after")).withColumn("k_collapse", F.col("before") - F.col("after"))
