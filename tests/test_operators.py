"""Small fixtures with known answers, and properties."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import agent, chunk, economy, embed, events, metrics, pack, retrieve


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_recall_counts_items_not_chunks(spark):
    q = spark.createDataFrame([(1,)], "qid long")
    gold = spark.createDataFrame([(1, 0, 1), (1, 0, 2), (1, 0, 3), (1, 1, 9)], "qid long, anchor_idx int, chunk_id long")
    hits = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3)], "qid long, chunk_id long, rank int")
    got = metrics.retrieval_metrics(q, gold, hits, 8).first()
    assert (got.evidence_recall, got.full_chain, got.mrr) == (0.5, 0.0, 1.0)


def test_ndcg_values(spark):
    q = spark.createDataFrame([(1,)], "qid long")
    gold = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 3)], "qid long, anchor_idx int, chunk_id long")
    one = spark.createDataFrame([(1, 1, 1), (1, 8, 2), (1, 9, 3)], "qid long, chunk_id long, rank int")
    assert metrics.retrieval_metrics(q, gold, one, 8).first().ndcg == pytest.approx(0.4693, abs=1e-4)
    two = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "qid long, chunk_id long, rank int")
    assert metrics.retrieval_metrics(q, gold, two, 2).first().ndcg == 1.0
    assert metrics.greedy_ndcg(gold, two, 2).first().ndcg == 1.0


def test_no_gold_is_null(spark):
    q = spark.createDataFrame([(1,)], "qid long")
    none = spark.createDataFrame([], "qid long, anchor_idx int, chunk_id long")
    hits = spark.createDataFrame([(1, 1, 1)], "qid long, chunk_id long, rank int")
    assert tuple(metrics.retrieval_metrics(q, none, hits, 8).first())[1:] == (None, None, None, None)


def test_rrf_value_and_rank_from_one(spark):
    legs = [spark.createDataFrame([(1, c, s, r) for r, (c, s) in enumerate(x, 1)], "qid long, chunk_id string, score double, rank int") for x in ([("a", 9.0), ("b", 5.0), ("c", 1.0)], [("b", 9e6), ("a", 5e6), ("d", 1.0)])]
    got = {r.chunk_id: r.score for r in retrieve.rrf(legs, 10).collect()}
    assert got["a"] == pytest.approx(1 / 61 + 1 / 62, abs=1e-6)
    assert got["a"] == got["b"]


def test_kappa_of_always_pass(spark):
    pairs = spark.createDataFrame([(1, 1)] * 90 + [(1, 0)] * 10, "a int, b int")
    got = metrics.kappa(pairs, "a", "b").first()
    assert (got.kappa, got.agreement) == (0.0, 0.9)


def test_abstention(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, False)], "n boolean, a boolean")
    got = metrics.abstention(df, F.col("n"), F.col("a")).first()
    assert (got.precision, got.recall, got.false_answers) == (1.0, 0.5, 1)


def test_bootstrap(spark):
    same = spark.createDataFrame([(i, 1.0, 1.0) for i in range(60)], "qid long, a double, b double")
    assert tuple(metrics.paired_bootstrap(same).first())[::4] == (0.0, "inside the noise band")
    apart = spark.createDataFrame([(i, 0.0, 1.0) for i in range(80)], "qid long, a double, b double")
    assert tuple(metrics.paired_bootstrap(apart).first())[::4] == (1.0, "real")


def test_failure_overlap(spark):
    lexical = spark.createDataFrame([("q2",), ("q3",), ("q4",)], "qid string")
    dense = spark.createDataFrame([("q1",), ("q2",)], "qid string")
    got = metrics.failure_overlap(lexical, dense).first()
    assert (got.conditional, got.jaccard) == (0.5, 0.25)
    assert metrics.failure_overlap(lexical, dense.limit(0)).first().conditional == 0.0


def test_independence(spark):
    counts = spark.createDataFrame([(1, 21), (2, 59), (3, 21), (4, 100), (6, 6)], "n_anchors int, n int")
    assert metrics.independence(counts, 0.7645).first().predicted == 0.4603


@pytest.mark.parametrize("words,overlap", [(0, 0.0), (1, 0.0), (120, 0.0), (300, 0.25), (301, 0.5)])
def test_windows_keep_every_word(spark, words, overlap):
    body = " ".join(f"w{i}" for i in range(words))
    got = spark.createDataFrame([(body,)], "t string").select(chunk.windows(F.filter(F.split("t", " "), lambda w: w != ""), 64, overlap).alias("x")).first().x
    seen = [w for piece in got for w in piece.split()]
    assert set(seen) == set(body.split())
    assert all(len(p.split()) <= 64 for p in got)
    if not overlap:
        assert seen == body.split()


def test_overlap_guard():
    with pytest.raises(ValueError, match="overlap"):
        chunk.windows(F.col("x"), 10, 1.0)
    with pytest.raises(KeyError):
        chunk.chunk(None, "nothing")


def test_pack_skips_and_goes_on(spark):
    hits = spark.createDataFrame([(1, 1, 10, 50), (1, 2, 11, 80), (1, 3, 12, 40)], "qid long, rank int, chunk_id long, n_tokens long")
    assert [r.chunk_id for r in pack.pack(hits, 8, 100).orderBy("rank").collect()] == [10, 12]


def test_dedup_keeps_the_first(spark):
    hits = spark.createDataFrame([(1, 1, 10, ["a", "b"]), (1, 2, 11, ["a", "b"]), (1, 3, 12, ["c"])], "qid long, rank int, chunk_id long, tokens array<string>")
    assert [(r.chunk_id, r["rank"]) for r in pack.dedup(hits).orderBy("rank").collect()] == [(10, 1), (12, 2)]


def test_bm25_prefers_both_terms(spark):
    texts = ["the cat sat on the mat", "a dog ran home fast", "cat food is here now", "mat is blue today"]
    c = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    q = spark.createDataFrame([(0, "cat mat")], "qid long, query string")
    got = retrieve.bm25(q, c, 4).orderBy("rank").collect()
    assert got[0].chunk_id == 0
    assert all(r.score >= 0 for r in got)


def test_acl(spark):
    c = spark.createDataFrame([(1, ["a"]), (2, ["b", "c"])], "chunk_id long, acl array<string>")
    assert retrieve.visible(c, None).count() == 2
    assert retrieve.visible(c, F.array(F.lit("c"))).count() == 1
    assert retrieve.visible(c, F.array().cast("array<string>")).count() == 0


def test_first_sufficient_step(spark):
    steps = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "a")], "qid long, step int, item string")
    needs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "z")], "qid long, item string")
    assert rows(agent.first_sufficient(steps, needs)) == [(1, 1), (2, None)]


def test_progress_counts_a_retry(spark):
    e = spark.createDataFrame([("x", 1, 7, "fail", 1, 1), ("x", 1, 7, "pass", 2, 2)], "login string, unit int, thread int, kind string, ts int, event_id int")
    got = events.progress(e).first()
    assert (got.attempts, got.cleared, got.retries) == (2, 1, 1)


def test_waves_put_a_cycle_last(spark):
    units = spark.createDataFrame([(1,), (2,), (3,)], "unit long")
    requires = spark.createDataFrame([(1, 2), (2, 1)], "unit long, needs long")
    assert {r.unit: r.wave for r in events.waves(units, requires).collect()} == {3: 0, 1: 1, 2: 1}
    assert sorted(map(tuple, events.cycles(requires).collect())) == [(1, 1), (1, 2)]


def test_cache_and_prefix(spark):
    r = spark.createDataFrame([(1, "p"), (2, "q"), (3, "p"), (9, "p")], "seq int, prefix string")
    assert rows(economy.prompt_cache(r, 3)) == [(1, False), (2, False), (3, True), (9, False)]
    p = spark.createDataFrame([(1, 1, "abcd"), (1, 2, "abxy"), (2, 3, "abcd")], "tenant int, seq int, prompt string")
    assert rows(economy.prefix_share(p)) == [(1, 1, 0, 4), (1, 2, 2, 4), (2, 3, 0, 4)]


def test_ann_recall(spark):
    from lodestone.plans.registry import QUERIES

    got = {r.probes: r.recall for r in QUERIES["ann_ivf_recall"](spark, "/root/testdata/sf0.1").collect()}
    assert 0.9 <= got[embed.PROBES] <= got[10] <= got[12]
    walks = {r.nodes: r.recall for r in QUERIES["ann_graph_recall"](spark, "/root/testdata/sf0.01").collect()}
    assert walks["all"] >= 0.9 and walks["allowed"] >= 0.9


def test_text(spark):
    df = spark.createDataFrame([("The ERR_CONN x cats ran. AB-12 now!  Ok?",)], "t string")
    got = df.select(text.tokens(F.col("t")).alias("a"), text.identifiers(F.col("t")).alias("b"), text.sentences(F.col("t")).alias("c"), text.approx_tokens(F.col("t")).alias("d")).first()
    assert got.a == ["err_conn", "cats", "ran", "ab", "12", "now", "ok"]
    assert got.b == ["ERR_CONN", "AB-12"]
    assert got.c == ["The ERR_CONN x cats ran.", "AB-12 now!", "Ok?"]
    assert got.d == 10


def test_hashed_vectors_are_units(spark):
    df = spark.createDataFrame([(1, "some words"), (2, "other ones")], "chunk_id long, text string")
    got = embed.hashed(df).groupBy("chunk_id").agg(F.sum(F.col("value") * F.col("value")).alias("n")).collect()
    assert all(abs(r.n - 1) < 1e-4 for r in got)


def test_waves_are_as_many_as_a_chain_is_long(spark):
    from lodestone.operators import events

    units = spark.createDataFrame([(i,) for i in range(60)], "unit long")
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 55)] + [(56, 57), (57, 58), (58, 56), (59, 58), (55, 99)], "unit long, needs long")
    got = {r.unit: r.wave for r in events.waves(units, chain).collect()}
    assert got == {i: i for i in range(55)} | {i: 55 for i in range(55, 60)}
    assert sorted(map(tuple, events.cycles(chain).collect())) == [(56, 56), (56, 57), (56, 58)]
    twice = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (4, 3), (5, 5), (6, 1)], "unit long, needs long")
    assert sorted(map(tuple, events.cycles(twice).collect())) == [(1, 1), (1, 2), (3, 3), (3, 4), (5, 5)]
    assert events.cycles(twice.limit(0)).count() == 0


def test_what_patterns_require():
    from lodestone.operators.pattern_index import required

    grams = lambda *words: frozenset(w[i : i + 3] for w in words for i in range(len(w) - 2))
    assert required("licen[cs]e") == [[grams("licen")]]
    assert required("Of The") == [[grams("of the")]]
    assert required("(apache|gnu general) licen") == [[grams("apache"), grams("gnu general")], [grams(" licen")]]
    assert required("abc?def") == [[grams("def")]]
    assert required("(abc)*x") == required(r"\d{3}-\d{4}") == required("ab|cdef") == required("a(") == required("étés") == []
    assert required("(?:abcd){2}") == [[grams("abcd")]]
    assert required("x(?=abc)y(?!def)") == []


def test_best_of_slices_are_the_best_of_all():
    """Ties go to the smaller id, -inf and nan are no scores, and slices of any width give the same."""
    import numpy as np

    from lodestone.operators import retrieve

    rng = np.random.default_rng(1)
    scores, ids = rng.integers(0, 5, (7, 90)).astype(float), rng.permutation(90)
    scores[0], scores[1, ::2], scores[2, 3:] = -np.inf, np.nan, -np.inf
    want = [(r, i, s) for r in range(7) for s, i in sorted((-scores[r, c], ids[c]) for c in range(90) if scores[r, c] > -np.inf)[:10]]
    for step in (4, 33, 90):
        got = None
        for low in range(0, 90, step):
            part = retrieve.best_of(scores[:, low : low + step], ids[low : low + step], 10)
            got = part if got is None else retrieve.merged(got, part, 10)
        assert [(r, i, -s) for r, i, s in zip(*got, strict=True)] == want
    assert retrieve.width(2_000) * 2_000 <= retrieve.PRODUCTS and retrieve.width(10**9) == 1


def test_inverted_lists_make_no_rows_of_pairs(spark):
    """A pair that a query looks at is never a row of a join, and all cells give the exact result."""
    from lodestone.operators import retrieve

    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").selectExpr("vec_id AS chunk_id", "embedding AS vector")
    q = v.filter("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "qid")
    centers = embed.ivf_build(v, 16)
    found = embed.ivf_search(q, v, centers, 16)
    assert "Join" not in found._jdf.queryExecution().toString()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, retrieve.knn(q, v, 10).collect()))
