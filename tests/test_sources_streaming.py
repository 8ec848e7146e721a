"""Sources, sinks and streams."""

import json

from lodestone.operators import economy
from lodestone.sources import corpora
from lodestone.streaming import prompt_cache_stream, unit_digest


def test_json_corpus(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"title": "T", "body": "one\n\ntwo\n \n", "source": "s", "published_at": "2024-03-01T00:00:00Z"}, {"title": "U", "text": "x"}]))
    (tmp_path / "q.json").write_text(json.dumps([{"query": "q?", "answer": "a", "question_type": "inference", "evidence_list": [{"fact": "f" * 80}]}, {"query": "n", "answer": "none"}]))
    docs, asked = corpora.json_corpus(spark, str(tmp_path / "c.json"), str(tmp_path / "q.json"))
    got = {r.title: r for r in docs.collect()}
    assert (got["T"].passages, got["T"].published, got["U"].passages) == (["one", "two"], "2024-03-01", ["x"])
    assert sorted(len(r.anchors) for r in asked.collect()) == [0, 1]
    assert max(len(a) for r in asked.collect() for a in r.anchors) == 60


def test_tags_areas_traces(spark, tmp_path):
    comments = spark.createDataFrame([("a", 1, 5, "done [pass:u1] and [hint:u-2]"), ("b", 1, 6, "no tag")], "login string, thread int, ts int, body string")
    assert sorted((r.kind, r.unit) for r in corpora.tagged_events(comments).collect()) == [("hint", "u-2"), ("pass", "u1")]
    files = spark.createDataFrame([("docs/b",), ("docs/a",), ("docs/a",), ("top",)], "path string")
    assert {r.area: r.paths for r in corpora.areas(files).collect()} == {"docs": ["docs/a", "docs/b"], "": ["top"]}
    old = spark.createDataFrame([("t1", 1, "x")], "trace_id string, created_at int, v string")
    new = spark.createDataFrame([("t1", 2, "y"), ("t2", 1, "z")], "trace_id string, created_at int, v string")
    kept = corpora.put_traces(old, new)
    assert sorted(r.v for r in corpora.query_traces(kept, "SELECT v FROM traces").collect()) == ["y", "z"]
    corpora.write_report(kept, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2


def _stream(spark, df, path, parts):
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_cache_stream_is_the_batch_form(spark, tmp_path):
    rows = [(i, "pqr"[(i * i) % 3]) for i in range(1, 30)]
    df = spark.createDataFrame(rows, "seq long, prefix string")
    stream = _stream(spark, df, str(tmp_path / "in"), [df.filter("seq < 15"), df.filter("seq >= 15")])
    q = prompt_cache_stream(stream, 2).writeStream.format("memory").queryName("cache_hits").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.seq, r.hit) for r in spark.table("cache_hits").collect())
    assert got == sorted(map(tuple, economy.prompt_cache(df, 2).collect()))


def test_digest_stream_is_the_batch_form(spark, tmp_path):
    df = spark.sql("SELECT timestamp'2024-01-01' + make_interval(0, 0, 0, 0, id) AS ts, cast(id % 3 AS int) AS unit, element_at(array('fail', 'pass', 'hint'), cast(id % 3 + 1 AS int)) AS kind FROM range(300)")
    stream = _stream(spark, df, str(tmp_path / "in"), [df])
    q = unit_digest(stream).writeStream.format("memory").queryName("digest").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("digest").collect())) == sorted(map(tuple, unit_digest(df).collect()))
