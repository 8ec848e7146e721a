"""The pipeline against a plain version of its stages on a small fixture, and its contract."""

import collections
import hashlib
import re

import corpus_pipeline
from lodestone.llm import queries
from lodestone.llm.common import tokenizer_path
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tests.llm.plain import windows_of, words_of

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    sources = {r.doc_id: r.source for r in docs.collect()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        rows = docs.collect()
        after = {r.doc_id for r in rows}
        assert after <= before.keys()
        if number < 4:
            assert docs.columns == columns
            if name != "quality rules":
                assert all(r.text == before[r.doc_id] for r in rows)
        if name == "toxicity":
            scored = {r.doc_id: r.predicted for r in queries.op9_toxicity(spark, SF).collect()}
            assert after == {i for i in before if not scored[i]}
        if name == "quality rules":
            plain = _quality(sources, before)
            assert {r.doc_id: r.text for r in rows} == {i: t for i, t in plain.items() if t is not None}
            assert all(r.n_chars == len(r.text) for r in rows if r.text != before[r.doc_id])
        if name == "n-gram Jaccard join":
            kept, sets = [], {}
            for i in sorted(before):
                words = words_of(before[i])
                sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
            group = {i: i for i in sets}

            def root(i, group=group):
                while group[i] != i:
                    i = group[i]
                return i

            for i in sets:
                for j in sets:
                    if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                        a, b = sorted((root(i), root(j)))
                        group[b] = a
            kept = {i for i in sets if root(i) == i}
            assert after == kept
        if name == "benchmark decontamination":
            windows = {w for _, t in bench for w in windows_of(words_of(t), 13)}
            for i, text in before.items():
                words = words_of(text)
                hit = {p for n in {len(w) for w in windows} for s in range(len(words) - n + 1) if tuple(words[s : s + n]) in windows for p in range(s, s + n)}
                assert (i in after) == (not hit or 20 * len(hit) < len(words))
        if number == 4:
            t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
            for r in rows:
                ids = t.encode(before[r.doc_id] or "", add_special_tokens=False).ids
                assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
            assert after == before.keys()


def _quality(sources, texts):
    """Texts without the frequent lines of their source; None for those rejected."""
    words = lambda x: re.findall(r"[^\x20\x09-\x0D]+", x)
    normal = lambda x: " ".join(words(re.sub("[0-9]", "0", x.lower())))
    docs = collections.defaultdict(set)
    for i, t in texts.items():
        docs[sources[i]].add(t or "")
    often = {s: {x for x, n in collections.Counter(x for t in of for x in {normal(y) for y in t.split("\n")} if x).items() if n > max(5, 0.05 * len(of))} for s, of in docs.items()}
    out = {}
    for i, t in texts.items():
        w = words(t or "")
        places = collections.defaultdict(list)
        for k in range(len(w) - 2):
            places[tuple(w[k : k + 3])].append(k)
        repeated = {k + j for of in places.values() if len(of) > 1 for k in of for j in range(3)}
        kept = [x for x in (t or "").split("\n") if normal(x) not in often[sources[i]]]
        left = len(words("\n".join(kept)))
        bad = len(w) < 50 or 2 * len(repeated) > len(w) or (left < len(w) and (left < 50 or left < 0.3 * len(w)))
        out[i] = None if bad else "\n".join(kept)
    return out


def test_stages_of_empty_and_odd_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(3).unionByName(docs.limit(2).withColumn("text", F.lit(None).cast("string"))).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.limit(1).withColumn("text", F.lit("")))
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs.limit(0), SF).count() == 0
        out = stage(spark, odd, SF)
        assert out.count() <= odd.count()
        if number < 4:
            assert out.columns == docs.columns


def test_run_has_rows(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
