"""Other sources and sinks: question-answer corpora in JSON, tagged comments, file areas, traces, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_corpus(spark: SparkSession, corpus: str, questions: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, title, source, published, passages) and questions (qid, query, answer, type, anchors)
    of two JSON arrays: [{title, body or text, source, published_at}] and [{query, answer, question_type,
    evidence_list: [{fact}]}]. Bodies are cut at blank lines, anchors after 60 characters."""
    doc_schema = "title string, body string, text string, source string, published_at string"
    docs = spark.read.schema(doc_schema).option("multiLine", True).json(corpus)
    body = F.coalesce("body", "text", F.lit(""))
    passages = F.filter(F.transform(F.split(body, r"\n\s*\n"), lambda x: F.trim(x)), lambda p: p != "")
    documents = docs.select(F.sha1(F.encode(F.concat_ws("\n", "title", body), "UTF-8")).alias("doc_id"), "title", "source", F.substring("published_at", 1, 10).alias("published"), passages.alias("passages"))
    q_schema = "query string, answer string, question_type string, evidence_list array<struct<fact:string>>"
    asked = spark.read.schema(q_schema).option("multiLine", True).json(questions)
    anchors = F.transform(F.coalesce("evidence_list", F.array().cast("array<struct<fact:string>>")), lambda e: F.substring(e["fact"], 1, 60))
    out = asked.select(F.substring(F.sha1(F.encode("query", "UTF-8")), 1, 12).alias("qid"), "query", "answer", F.col("question_type").alias("type"), anchors.alias("anchors"))
    return documents, out if limit is None else out.orderBy("qid").limit(limit)


def tagged_events(comments: DataFrame, pattern: str = r"\[(\w+):([\w-]+)\]") -> DataFrame:
    """(login, thread, ts, kind, unit): one row a tag [kind:unit] in the body of (login, thread, ts, body)."""
    tags = F.explode(F.regexp_extract_all("body", F.lit(pattern), F.lit(0))).alias("tag")
    rows = comments.select("login", "thread", "ts", tags)
    return rows.select("login", "thread", "ts", F.regexp_extract("tag", pattern, 1).alias("kind"), F.regexp_extract("tag", pattern, 2).alias("unit"))


def areas(files: DataFrame) -> DataFrame:
    """(area, paths): changed files (path) by their first folder, as sorted sets."""
    return files.groupBy(F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1)).otherwise("").alias("area")).agg(F.sort_array(F.collect_set("path")).alias("paths"))


def put_traces(existing: DataFrame | None, new: DataFrame, key: str = "trace_id", order: str = "created_at") -> DataFrame:
    """Traces with the last write of each key; of equally late ones a new one, and of those the greatest row."""
    tagged = new.withColumn("_new", F.lit(1))
    both = tagged if existing is None else existing.withColumn("_new", F.lit(0)).unionByName(tagged)
    row = F.struct(*(c for c in new.columns if c != key))
    last = both.groupBy(key).agg(F.max_by(row, F.struct(order, "_new", row)).alias("_row"))
    return last.select(key, "_row.*").select(*new.columns)


def get_trace(traces: DataFrame, trace_id, key: str = "trace_id") -> DataFrame:
    return traces.filter(F.col(key) == trace_id)


def query_traces(traces: DataFrame, sql: str) -> DataFrame:
    """SQL text over the traces, which it calls ``traces``."""
    traces.createOrReplaceTempView("traces")
    return traces.sparkSession.sql(sql)


def write_report(scores: DataFrame, path: str) -> None:
    """A scorecard as JSON lines."""
    scores.coalesce(1).write.mode("overwrite").json(path)


def corpus_stats(documents: DataFrame, by: list[str], public: str = "public") -> DataFrame:
    """(of, value, n, n_public): documents by each of some columns, and how many of them everyone may read, in one scan."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("of"), F.col(c).cast("string").alias("value")) for c in by))).alias("x")
    return documents.select("acl", pairs).groupBy("x.of", "x.value").agg(F.count("*").alias("n"), F.count_if(F.array_contains("acl", public)).alias("n_public"))


def evidence_of(asked: DataFrame, facts: DataFrame) -> DataFrame:
    """(qid, anchors, doc_ids) of questions' facts (qid, nth, fact_id), looked up in (fact_id, doc_id, anchor): the
    anchors in the order asked, each document once."""
    found = asked.join(facts, "fact_id")
    anchors = F.transform(F.sort_array(F.collect_list(F.struct("nth", "doc_id", "anchor"))), lambda x: x["anchor"])
    return found.groupBy("qid").agg(anchors.alias("anchors"), F.array_sort(F.collect_set("doc_id")).alias("doc_ids"))


def units(spark: SparkSession, path: str) -> DataFrame:
    """(uid, track, title, needs, bars) of a folder of JSON files, one a unit."""
    schema = "uid string, track string, title string, needs array<string>, bars array<struct<metric:string,threshold:double,direction:string>>"
    return spark.read.schema(schema).option("multiLine", True).json(path)


def synthetic(spark: SparkSession, n: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, title, source, published, text, fact_id) and facts (fact_id, doc_id, anchor) made from hashes of
    their numbers, for trials at any size: a record of a deal, a report of a quarter or a notice of a fault each."""
    def pick(salt: int, options: list[str]):
        at = F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(len(options)))
        return F.element_at(F.array(*map(F.lit, options)), (at + 1).cast("int"))

    firm, other = (F.concat(pick(i, ["Alder", "Birch", "Cedar", "Dogwood", "Elm", "Fir"]), F.lit(" "), pick(i + 1, ["Works", "Systems", "Foods", "Lines"])) for i in (1, 3))
    amount = (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(5)), F.lit(900)) + 100).cast("string")
    date = F.date_format(F.date_add(F.lit("2023-01-01").cast("date"), F.pmod(F.xxhash64("id", F.lit(seed), F.lit(6)), F.lit(700)).cast("int")), "yyyy-MM-dd")
    kind = (F.col("id") % 3).cast("int")
    fact = F.when(kind == 0, F.concat(firm, F.lit(" acquired "), other, F.lit(" for $"), amount, F.lit(" million"))).when(kind == 1, F.concat(firm, F.lit(" reported revenue of $"), amount, F.lit(" million"))).otherwise(F.concat(firm, F.lit(" restored service after "), amount, F.lit(" minutes")))
    source = F.when(kind == 0, "newswire").when(kind == 1, "filings").otherwise("incident")
    rows = spark.range(n).select(F.col("id").alias("doc_id"), "id", fact.alias("anchor"), source.alias("source"), date.alias("published"), firm.alias("firm"))
    text = F.concat("anchor", F.lit(" on "), "published", F.lit(".\n\n"), F.lit("Observers of "), "firm", F.lit(" had expected as much. Nothing else was announced."))
    docs = rows.select("doc_id", F.concat("firm", F.lit(" "), "published").alias("title"), "source", "published", text.alias("text"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("fact_id"))
    return docs, rows.select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("fact_id"), "doc_id", "anchor")
