"""Queries and operators without SQL against plain versions of the same."""

import collections
import math
import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import STOP_WORDS
from lodestone.operators import agent, chunk, context, embed, index, judge, metrics, pack, rerank, retrieve
from lodestone.plans.registry import QUERIES
from lodestone.sources import corpora

SF = "/root/testdata/sf0.001"


def tokens(text):
    found = [t.lower() for t in re.findall(r"[A-Za-z_][A-Za-z0-9_]+|[0-9]+(?:\.[0-9]+)?", text)]
    return [t for t in found if len(t) > 1 and t not in STOP_WORDS]


def sentences(text):
    return [s for s in (x.strip(" ") for x in re.sub(r"([.!?])[ \t\n\x0b\f\r]+", "\\1\x01", text).split("\x01")) if s]


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def by_doc(rows):
    out = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.ordinal)):
        out[r.doc_id].append(r.text)
    return out


def test_recursive_chunks(spark, docs):
    got = by_doc(QUERIES["chunk_recursive"](spark, SF).collect())
    per = max(20, int(128 * 0.75))
    for i, text in docs.items():
        paragraphs = [p for p in (re.sub(r"\s+", " ", x, flags=re.A).strip(" ") for x in text.split("\n")) if p]
        parts = [y for p in paragraphs for y in (sentences(p) if len(p.split(" ")) > per else [p])]
        pieces, current, n = [], "", 0
        for part in parts:
            size = len(part.split(" "))
            if n and n + size > per:
                pieces.append(current)
                current, n = part, size
            else:
                current, n = (f"{current} {part}" if n else part), n + size
        if n:
            pieces.append(current)
        want = []
        for k, piece in enumerate(pieces):
            before = pieces[k - 1].split(" ") if k else []
            want.append(" ".join([*before[-max(1, int(len(before) * 0.1)) :], piece]) if k else piece)
        assert got.get(i, []) == [w.strip(" ") for w in want]


def test_semantic_chunks(spark, docs):
    got = by_doc(QUERIES["chunk_semantic"](spark, SF).collect())
    per = max(20, int(128 * 0.75))
    for i, text in docs.items():
        want, current, last, n = [], "", set(), 0
        for s in sentences(text):
            t, size = set(tokens(s)), len(re.split(r"[ \t\n\x0b\f\r]+", s))
            close = bool(last | t) and len(last & t) / len(last | t) >= 0.22
            if n and not (close and n + size <= per):
                want.append(current)
                current, n = s, size
            else:
                current, n = (f"{current} {s}" if n else s), n + size
            last = t
        if n:
            want.append(current)
        assert got.get(i, []) == [w.strip(" ") for w in want]


def test_semantic_chunks_of_odd_texts(spark):
    """White space, marks, single digits, copies of an id and nulls; pieces are counted before a document becomes rows."""
    odd = ["", "   ", "\n", "One two. One two!\tOne\x0btwo?\x0cZwei.", "A 1 b. 1 2 3. 1.5 x_y 1.5. 1.5!", "\x01alpha beta\x01alpha beta. \n\nalpha  beta.", "Ünïcode Straße. straße ünïcode!  \u00a0İstanbul K. ſ K. No end ", "the of. the of. cats and 7 dogs. CATS AND DOGS", " ".join(["same words again."] * 80), "\r\nends\r\n"]
    rows = [*enumerate(odd), (3, "A copy of an id. A copy of an id."), (77, None), (None, "No id here. None there.")]
    got = chunk.semantic(spark.createDataFrame(rows, "doc_id long, text string"), 40, 0.22)
    want, total = [], collections.Counter()
    for i, text in rows:
        pieces, current, last, n = [], "", set(), 0
        for s in sentences(text or ""):
            t, size = set(tokens(s)), len(re.split(r"[ \t\n\x0b\f\r]+", s))
            close = bool(last | t) and len(last & t) / len(last | t) >= 0.22
            if n and not (close and n + size <= 30):
                pieces.append(current)
                current, n = s, size
            else:
                current, n = (f"{current} {s}" if n else s), n + size
            last = t
        pieces += [current] if n else []
        total[i] += len(pieces)
        want += [(str(i), k, p.strip(" ")) for k, p in enumerate(pieces)]
    found = got.collect()
    assert sorted((str(r.doc_id), r.ordinal, r.text) for r in found) == sorted(want)
    assert all(r.n_chunks == total[r.doc_id] for r in found)
    assert next(r.chunk_id for r in found if r.doc_id == 6 and r.ordinal == 0).startswith("6:0:")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Window") and "aggregate(" not in plan
    assert chunk.semantic(spark.createDataFrame([(1, None)], "doc_id long, text string")).count() == 0


def test_anchors_are_searched_where_texts_are_read(spark, monkeypatch):
    """Anchors of any length, copies of them and nulls, in one block and in many; no text is joined."""
    norm = lambda x: re.sub(r"[ \t\n\x0b\f\r]+", " ", x).strip(" ").lower()
    anchors = [(1, 0, "alpha beta gamma"), (1, 1, " Alpha\n BETA\tgamma "), (2, 0, "tea"), (3, 0, "a b"), (4, 0, ""), (5, 0, None), (6, 0, "  "), (7, 0, "pha beta gam"), (8, 0, "É x y Ü"), (9, 0, "one one one one"), (10, 0, "gone for good"), (11, 0, "a\u00a0b c d")]
    texts = [(1, "ALPHA beta\r\ngamma tea"), (2, None), (3, ""), (4, "xa bx é X y\x0bü"), (5, "one one one"), (6, "so one one one one, steak"), (7, "a\u00a0b C  d"), (7, "tea"), (None, "tea leaves")]
    a, t = spark.createDataFrame(anchors, "qid long, anchor_idx int, anchor string"), spark.createDataFrame(texts, "chunk_id long, text string")
    want = {(q, i, c) for q, i, x in anchors for c, y in texts if x and norm(x) and y is not None and norm(x) in norm(y)}
    for block in (20_000, 2):
        monkeypatch.setattr(retrieve, "ANCHOR_BLOCK", block)
        got = retrieve.resolve_gold(a, t)
        found = [tuple(r) for r in got.select("qid", "anchor_idx", "chunk_id").collect()]
        assert len(found) == len(set(found)) and set(found) == want
    assert "Contains(" not in got._jdf.queryExecution().toString() and "SortMergeJoin" not in got._jdf.queryExecution().toString()
    none = chunk.boundary_damage(a.filter("qid = 10").select("anchor"), t.select(F.col("chunk_id").alias("doc_id"), "text"), t).first()
    assert (none.in_documents, none.in_chunks, none.damage) == (0, 0, 0.0)
    cut = chunk.boundary_damage(a.select("anchor"), t, t.filter("chunk_id <> 1")).first()
    assert (cut.in_documents, cut.in_chunks, cut.damage) == (8, 5, 0.375)


def test_arrays_of_chunks_are_made_once(spark):
    """Spark infers no filter that would make them anew."""
    docs = spark.createDataFrame([(1, "t", "some words here\n\n" + "more " * 99), (2, "t", None), (3, "t", " "), (3, "t", "again\n")], "doc_id long, title string, text string")
    for strategy, n in (("fixed", 4), ("structural", 5), ("recursive", 3), ("parent", 4)):
        got = chunk.chunk(docs, strategy, size_tokens=64)
        assert not re.search(r"Filter .*size\(", got._jdf.queryExecution().optimizedPlan().toString())
        assert (strategy, got.count()) == (strategy, n)


def test_quota(spark):
    rng = np.random.default_rng(3)
    names = ["alpha", "beta", "gamma"]
    hits, entities, want = [], [], {}
    for q in range(40):
        mine = [n for n in names if rng.random() < 0.7]
        entities += [(q, n) for n in mine]
        own = [(r, 100 * q + r, " ".join(n for n in names if rng.random() < 0.4) + " Text", int(rng.integers(5, 40))) for r in range(1, 12)]
        hits += [(q, *h) for h in own]
        ids, used = [], 0
        per = max(1, 5 // max(1, len(mine)))
        for e in mine:
            n = 0
            for _, c, text, size in own:
                if n < per and c not in ids and e in text.lower() and used + size <= 90:
                    ids.append(c)
                    used, n = used + size, n + 1
        reserved = len(ids)
        for _, c, _, size in own:
            if len(ids) < 5 and c not in ids and used + size <= 90:
                ids.append(c)
                used += size
        want[q] = [(c, k + 1, k < reserved) for k, c in enumerate(ids)]
    got = collections.defaultdict(list)
    for r in pack.quota(spark.createDataFrame(hits, "qid long, rank int, chunk_id long, text string, n_tokens int"), spark.createDataFrame(entities, "qid long, entity string"), 5, 90).orderBy("qid", "place").collect():
        got[r.qid].append((r.chunk_id, r.place, r.reserved))
    assert got == want


def test_loop(spark):
    """The loop against the same one question at a time, over a search that shares words."""
    texts = {i: t for i, t in enumerate(["alpha runs the plant", "beta bought gamma firm", "gamma firm makes tea", "delta sells tea cups", "alpha left beta", "cups of tea are hot"])}
    asked = {1: "who runs the firm that beta bought and what tea does gamma make", 2: "alpha plant", 3: "nothing known here at all", 4: "tea cups and hot cups"}

    def search(query):
        scored = sorted(((-len(set(tokens(query)) & set(tokens(t))), i) for i, t in texts.items() if set(tokens(query)) & set(tokens(t))))
        return [(i, k) for k, (_, i) in enumerate(scored[:2], 1)]

    parts = {r.qid: r.subs for r in spark.createDataFrame(list(asked.items()), "qid long, query string").select("qid", agent.decompose(F.col("query")).alias("subs")).collect()}
    want, turns = {}, collections.defaultdict(list)
    for qid, question in asked.items():
        found, issued, target, reason, n_done = {}, set(), question, None, 0
        missing = []
        for n in range(1, 5):
            query = question if n == 1 else f"{question} {target}"
            norm = " ".join(sorted(set(tokens(query))))
            if norm in issued:
                reason = "repeated query"
                break
            issued.add(norm)
            new = [i for i, _ in search(query) if i not in found]
            found |= dict.fromkeys(new)
            n_done = n
            cover = [max((len(set(tokens(s)) & set(tokens(texts[i]))) / len(set(tokens(s))) if tokens(s) else 1.0 for i in found), default=0.0 if tokens(s) else 1.0) for s in parts[qid]]
            missing = [s for s, c in zip(parts[qid], cover) if c < 0.6]
            turns[qid].append((n, target, len(new), not missing))
            if not missing or not new:
                reason = "sufficient" if not missing else "no new evidence"
                break
            target = missing[0] if missing else question
        want[qid] = (n_done, reason or "turn cap", missing)

    def retrieved(queries):
        rows = [(r.qid, i, texts[i], k) for r in queries.collect() for i, k in search(r.query)]
        return spark.createDataFrame(rows, "qid long, chunk_id long, text string, rank int")

    results, log, evidence = agent.search_loop(spark.createDataFrame(list(asked.items()), "qid long, query string"), retrieved, 4, 0.6)
    assert {r.qid: (r.turns, r.stop_reason, r.missing) for r in results.collect()} == want
    got = collections.defaultdict(list)
    for r in log.orderBy("qid", "n").collect():
        got[r.qid].append((r.n, r.target, r.n_new, r.sufficient))
    assert got == turns
    said = spark.createDataFrame([(q, "an answer") for q in asked], "qid long, answer string")
    partial = {r.qid: r.answer for r in agent.partial_answers(said, results).collect()}
    assert all(("PARTIAL" in a) == (want[q][1] != "sufficient") for q, a in partial.items())
    gold = spark.createDataFrame([(1, 0, 1), (1, 1, 3), (2, 0, 0)], "qid long, anchor_idx int, chunk_id long")
    packed = evidence.filter("chunk_id <> 1").select("qid", "chunk_id")
    scores = {r.qid: r for r in agent.trace_scores(results, spark.createDataFrame(list(asked.items()), "qid long, query string"), evidence, packed, gold).collect()}
    assert (scores[1].found_then_lost, scores[2].evidence_retention, scores[3].evidence_retention) == (1, 1.0, None)
    assert scores[2].stopped_well and not scores[3].stopped_well
    stats = {r.measure: r.value for r in agent.loop_stats(log, evidence, packed, spark.createDataFrame(list(asked.items()), "qid long, query string")).collect()}
    assert stats["overlap in turn 1"] == 1.0
    again, _, _ = agent.search_loop(spark.createDataFrame([(3, asked[3])], "qid long, query string"), retrieved, 4, 0.6, single_shot=True)
    assert again.first().turns == 1


def test_latent_space_is_close_to_the_exact_one(spark, docs):
    some = {i: t for i, t in docs.items() if tokens(t)}
    model = embed.lsa_fit(spark.createDataFrame(list(some.items()), "chunk_id long, text string"), 64)
    n_terms = model.terms.count()
    assert n_terms == len({t for x in some.values() for t in tokens(x)})
    got = {r.chunk_id: np.array(r.vector) for r in embed.lsa_encode(spark.createDataFrame([*some.items(), (-1, "zzzz 000")], "chunk_id long, text string"), model, 64).collect()}
    assert not got.pop(-1).any()
    vocab = {t: k for k, t in enumerate(sorted({t for x in some.values() for t in tokens(x)}))}
    df = collections.Counter(t for x in some.values() for t in set(tokens(x)))
    rows = np.zeros((len(some), len(vocab)))
    for k, x in enumerate(some.values()):
        for t, n in collections.Counter(tokens(x)).items():
            rows[k, vocab[t]] = (1 + math.log(n)) * (math.log((1 + len(some)) / (1 + df[t])) + 1)
    _, _, v = np.linalg.svd(rows, full_matrices=False)
    exact = rows @ v[:64].T
    exact /= np.linalg.norm(exact, axis=1, keepdims=True)
    mine = np.array([got[i] for i in some])
    a, b = (x @ x.T for x in (exact, mine))
    upper = np.triu_indices(len(some), 1)
    assert np.corrcoef(a[upper], b[upper])[0, 1] > 0.95
    assert np.allclose(np.linalg.norm(mine, axis=1), 1)


def test_vectors_of_texts_and_tokens(spark):
    frame = spark.createDataFrame([(1, "Some  Words"), (2, "éß漢"), (3, None), (4, "")], "chunk_id long, text string")
    flat = {(r.chunk_id, r.bucket): r.value for r in embed.hashed(frame.filter("text <> ''")).collect()}
    got = {r.chunk_id: r.vector for r in embed.hashed_vectors(frame).collect()}
    for i in (1, 2):
        assert got[i] == [pytest.approx(flat.get((i, b), 0.0), abs=1e-6) for b in range(192)]
    assert not any(got[3]) and len(got[4]) == 192
    one = embed.token_vectors(frame.limit(1)).collect()
    assert [(r.at, r.token) for r in one] == [(0, "some"), (1, "words")]


def test_learnt_weights_rank_like_the_labels(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] + 0.2 * rng.normal(size=300) > 0.8).astype(int)
    pairs = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "f double, g double, label int")
    got = rerank.fit_logistic(pairs, ["f", "g"])
    w = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    mean = (w[:, None] * x).sum(0) / w.sum()
    scale = np.sqrt((w[:, None] * (x - mean) ** 2).sum(0) / w.sum())
    beta = np.zeros(3)
    for _ in range(20_000):
        p = 1 / (1 + np.exp(-(x @ beta[:2] + beta[2])))
        slope = np.r_[(x * (w * (p - y))[:, None]).sum(0) / w.sum() + 0.02 * beta[:2] * scale**2, (w * (p - y)).sum() / w.sum()]
        beta -= 0.5 * slope
    assert [got["f"], got["g"], got["bias"]] == [pytest.approx(b, abs=0.03) for b in beta]
    names = {r.feature for r in QUERIES["reranker_weights"](spark, SF).collect()}
    assert names == set(rerank.WEIGHTS)


def test_rerankers(spark):
    q = spark.createDataFrame([(1, "red tea")], "qid long, query string")
    c = spark.createDataFrame([(1, "green cups", "t"), (2, "red tea here", "t"), (3, "tea", "t")], "chunk_id long, text string, title string")
    hits = spark.createDataFrame([(1, 1, 3.0, 1), (1, 2, 2.0, 2), (1, 3, 1.0, 3)], "qid long, chunk_id long, score double, rank int")
    order = lambda df: [r.chunk_id for r in df.orderBy("rank").collect()]
    assert order(rerank.reranker("none")(hits, q, c)) == [1, 2, 3]
    assert order(rerank.reranker("late")(hits, q, c)) == [2, 3, 1]
    crossed = rerank.reranker("cross")(hits, q, c).orderBy("rank").collect()
    assert crossed[-1].chunk_id == 1 and [r.score for r in crossed] == sorted((r.score for r in crossed), reverse=True)
    assert order(rerank.external(hits, q, c, lambda qs, ts: [len(t) for t in ts], depth=2)) == [2, 1, 3]
    with pytest.raises(KeyError):
        rerank.reranker("llm")
    with pytest.raises(KeyError):
        rerank.logistic(hits)


def test_names_of_traces(spark):
    for r in QUERIES["trace_ids"](spark, SF).limit(50).collect():
        assert r.trace_id == str(uuid.uuid5(uuid.NAMESPACE_URL, f"trace/{r.event_id}"))


def test_synthetic_corpus(spark):
    a, facts = corpora.synthetic(spark, 60)
    b, _ = corpora.synthetic(spark.newSession(), 60)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    found = {r.doc_id: r.text for r in a.collect()}
    assert all(r.anchor in found[r.doc_id] for r in facts.collect())
    assert {r.source for r in a.collect()} == {"newswire", "filings", "incident"}


def test_choices_by_name(spark):
    with pytest.raises(KeyError):
        retrieve.hybrid(None, None, "nothing")
    with pytest.raises(KeyError):
        context.place_gold(None, None, "nowhere")
    assert set(chunk.STRATEGIES) == {"fixed", "recursive", "structural", "semantic", "contextual", "late", "parent"}
    docs = spark.createDataFrame([(1, "t", " ".join(f"w{i}" for i in range(700)))], "doc_id long, title string, text string")
    assert chunk.chunk(docs, "parent").count() > 3
    said = chunk.contextual(docs.withColumn("entities", F.array().cast("array<string>")), describe=lambda d: d.select("doc_id", F.lit("numbered words").alias("about")))
    assert said.first().text.startswith("From a document about numbered words.")


def test_exact_answers_and_gate(spark):
    rows = spark.createDataFrame([(1, " The  Cat ", "the cat"), (2, "a cat", "the cat")], "qid long, answer string, gold string")
    assert [r.correct for r in judge.answer_correct(rows, exact=True).orderBy("qid").collect()] == [1.0, 0.0]
    q = spark.createDataFrame([(1, "how much was paid for tea")], "qid long, query string")
    blocks = spark.createDataFrame([(1, 1, "Tea was paid for by the firm. Tea was paid for with 12 coins.", 0.2)], "qid long, rank int, text string, score double")
    got = judge.extractive(q, blocks, most=1).first()
    assert got.answer == "Tea was paid for with 12 coins. [S1]" and got.citations == ["S1"]
    assert not judge.extractive(q, blocks, least_score=0.5).first().sufficient


def test_units_and_versions(spark, tmp_path):
    (tmp_path / "u1.json").write_text('{"uid": "u1", "track": "a", "needs": ["u0"], "bars": [{"metric": "m", "threshold": 0.5, "direction": "at_least"}]}')
    got = corpora.units(spark, str(tmp_path)).first()
    assert (got.uid, got.needs, got.bars[0].threshold) == ("u1", ["u0"], 0.5)
    aliases = spark.createDataFrame([("live", "v1")], "alias string, index_version string")
    scores = spark.createDataFrame([("v1", 0.5), ("v2", 0.4)], "index_version string, score double")
    assert index.swap_if_better(aliases, "live", scores).first().index_version == "v1"
    assert index.swap_if_better(aliases, "live", scores.replace(0.4, 0.6)).first().index_version == "v2"


def test_metrics_of_documents(spark):
    gold = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "qid long, doc_id long")
    found = spark.createDataFrame([(1, 9, 1), (1, 1, 2)], "qid long, doc_id long, rank int")
    assert tuple(metrics.document_metrics(found, gold).first()) == (0.25, 0.0, 0.25, 2)
    assert tuple(metrics.document_metrics(found, gold.limit(0)).first()) == (0.0, 0.0, 0.0, 0)
    rows = spark.createDataFrame([(float(v),) for v in [5, 1, 1, 3, 2, 4, 4, 4, 9, 7]], "x double")
    assert metrics.ranked_value(rows, "x", 0.95).first().value == 7.0
    assert metrics.ranked_value(rows, "x", 0.9, from_zero=True).first().value == 9.0


def test_latent_queries_have_rows(spark):
    assert QUERIES["lsa_dense"](spark, SF).filter("rank = 1").count() == 40
    assert QUERIES["synthetic_corpus"](spark, SF).count() == 200


def test_approximate_search_against_exact(spark):
    """Recall at two sizes, and a share of vectors scored that falls as they grow."""
    from lodestone.plans.registry import QUERIES

    shares = []
    for sf in ("sf0.01", "sf0.1"):
        best = QUERIES["ann_coded_recall"](spark, f"/root/testdata/{sf}").orderBy("probes", "rescored").collect()[-1]
        assert best.recall >= 0.9 and best.coded < 1
        shares.append(best.scored)
    assert shares[1] < shares[0] / 2


def test_neighbours_of_neighbours_against_exact(spark):
    import numpy as np
    from lodestone.operators import ann

    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, vector array<double>")
    got = {}
    for r in ann.nn_descent(vectors, 8, 20).collect():
        got.setdefault(r.node, []).append(r.nb)
    scores = x @ x.T
    np.fill_diagonal(scores, -2)
    want = np.argsort(-scores, axis=1)[:, :8]
    assert all(len(got[i]) == 8 and i not in got[i] for i in range(400))
    assert np.mean([len(set(got[i]) & set(want[i])) / 8 for i in range(400)]) >= 0.9
    assert ann.nn_descent(vectors.limit(1), 8).count() == 0


def test_a_graph_by_blocks_is_exact_and_moves_no_neighbourhoods(spark, monkeypatch):
    """Over tiles and blocks that vectors don't fill, with ties, a vector of nan and more neighbours asked for than there are."""
    import numpy as np
    from lodestone.operators import ann

    monkeypatch.setattr(ann, "TILE", 16)
    monkeypatch.setattr(ann, "nn_descent", None)
    x = np.random.default_rng(5).integers(-2, 3, (130, 4)).astype(float)
    x[7] = np.nan
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, vector array<double>")
    scores = x @ x.T
    for m, block, nodes in ((5, 30, 130), (5, 1000, 130), (9, 3, 6)):
        known = [i for i in range(nodes) if i != 7]
        want = {(i, j, scores[i, j], r + 1) for i in known for r, (_, j) in enumerate(sorted((-scores[i, j], j) for j in known if j != i)[:m])}
        some = vectors.filter(f"chunk_id < {nodes}")
        assert set(map(tuple, ann.graph_by_blocks(some, m, block).collect())) == want
    assert ann.neighbours(vectors.limit(1), 8).count() == 0
    assert ann.neighbours(vectors.limit(0), 8).count() == 0


def test_neighbours_are_exact_at_any_size(spark, monkeypatch):
    """No number of vectors turns to a guess, and pairs of blocks beyond the partitions they are dealt to all meet."""
    import numpy as np
    from lodestone.operators import ann

    monkeypatch.setattr(ann, "WHOLE", 50, raising=False)
    monkeypatch.setattr(ann, "nn_descent", None)
    monkeypatch.setattr(ann, "DEALT", 2, raising=False)
    x = np.random.default_rng(8).integers(-3, 4, (120, 6)).astype(float)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, vector array<double>")
    scores = x @ x.T
    want = {(i, j, scores[i, j], r + 1) for i in range(120) for r, (_, j) in enumerate(sorted((-scores[i, j], j) for j in range(120) if j != i)[:7])}
    assert set(map(tuple, ann.neighbours(vectors, 7).collect())) == want
    assert set(map(tuple, ann.graph_by_blocks(vectors, 7, 20).collect())) == want


def test_scores_of_postings_are_no_rows_of_a_shuffle(spark, monkeypatch):
    """Rows a chunk give what exploded terms do: slices of a few chunks, blocks of a few queries, empty and null texts,
    letters whose lower case is ASCII or longer, terms that no chunk has."""
    from lodestone.operators import retrieve

    texts = ["Alpha beta ALPHA 3.14 x", "", None, "\u212aelvin kelvin \u0130stanbul beta", "the and of", "beta_1 3.14 3.1.4 gamma", "gamma " * 40 + "beta", "alpha, beta; gamma"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    queries = spark.createDataFrame([(1, "alpha beta beta"), (2, "elvin kelvin gamma"), (3, "nowhere"), (4, "3.14 beta"), (5, "istanbul stanbul"), (6, "the")], "qid long, query string")
    old = retrieve.postings(queries, chunks, cut=retrieve.cut_terms(chunks))
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 2)
    monkeypatch.setattr(retrieve, "PRODUCTS", 9)
    new = retrieve.postings(queries, chunks)
    for n, k1, b in ((2, 1.5, 0.75), (9, 0.9, 0.4)):
        found = retrieve.score(new, n, k1, b)
        assert old.packed is None and not any(x in found._jdf.queryExecution().toString() for x in ("Join", "Window"))
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, retrieve.score(old, n, k1, b).collect()))
    rows = lambda p: sorted(map(tuple, p.hit.select("chunk_id", "term", "dl", "tf").collect()))
    assert rows(new) == rows(old)
    assert retrieve.bm25(queries.limit(0), chunks).count() == 0 == retrieve.bm25(queries, chunks.limit(0)).count()


def test_trigrams_by_table_are_those_by_hash(spark, monkeypatch):
    """Letters that the table has no place for, white space alone, empty and null texts; and trigrams are hashed once."""
    import numpy as np
    from lodestone.operators import embed

    texts = ["Some  words, some\tWORDS", "", " ", None, "a", "\u00e4\u00f6\u00fc \U0001f600 \u4e2d\u6587", "abc" * 50]
    table = embed._Trigrams(192)
    monkeypatch.setattr(embed, "LETTERS", 12)
    small = embed._Trigrams(192)
    want = []
    for text in texts:
        padded = " " + embed._WHITE.sub(" ", (text or "").lower()) + " "
        total = np.zeros(192)
        for i in range(len(padded) - 2):
            h = embed._cell(padded[i : i + 3])
            total[h % 192] += 1 if h >> 8 & 1 else -1
        want.append(total if text is not None else np.zeros(192))
        assert (small.of(padded) == total).all()
    monkeypatch.undo()
    for text, total in zip(texts, want, strict=True):
        if text is not None:
            padded = " " + embed._WHITE.sub(" ", text.lower()) + " "
            assert (table.of(padded) == total).all()
            with monkeypatch.context() as m:
                m.setattr(embed, "_cell", None)
                assert (table.of(padded) == total).all()
    df = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    for r in embed.hashed_vectors(df).collect():
        assert r.vector == list(np.round(want[r.chunk_id] / (np.sqrt((want[r.chunk_id] ** 2).sum()) or 1), 6))


def test_features_cut_only_the_texts_of_hits(spark):
    """A text that no hit names is neither cut nor dealt; a hit named twice keeps both of its rows."""
    from lodestone.operators import rerank

    fails = F.when(F.col("chunk_id") == 3, F.raise_error(F.lit("cut"))).otherwise(F.col("body"))
    chunks = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma"), (3, "x")], "chunk_id long, body string").select("chunk_id", fails.alias("text"), F.lit("alpha").alias("title"))
    hits = spark.createDataFrame([(7, 1, 1), (7, 2, 2), (8, 1, 1)], "qid long, chunk_id long, rank int")
    queries = spark.createDataFrame([(7, "alpha beta"), (8, "gamma")], "qid long, query string")
    got = {(r.qid, r.chunk_id): r for r in rerank.pair_features(hits, queries, chunks).collect()}
    assert got.keys() == {(7, 1), (7, 2), (8, 1)} and got[7, 1].title == 0.5 and got[8, 1].title == 0


def test_questions_of_one_leg_make_no_vectors(spark, monkeypatch):
    from lodestone.operators import embed

    monkeypatch.setattr(embed, "_trigrams", None)
    monkeypatch.setattr(embed, "hashed_vectors", None)
    assert QUERIES["fault_isolation"](spark, "/root/testdata/sf0.001").count() > 0


def test_an_entity_does_not_lower_the_texts_again(spark):
    from lodestone.operators import pack

    chunks = spark.createDataFrame([(1, "Alpha beta"), (2, "ALPHA"), (3, None)], "chunk_id long, text string")
    entities = spark.createDataFrame([(7, "alpha"), (7, "Beta"), (8, "beta")], "qid long, entity string")
    got = pack.entity_shares(spark.createDataFrame([(7, 1), (7, 2)], "qid long, chunk_id long"), chunks, entities)
    joins = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert not any("lower(text" in x and "qid" not in x and "Inner, Contains(lower" in x for x in joins) and any("Contains(_t" in x for x in joins)
    assert sorted(map(tuple, got.collect())) == [(7, 0.333333, 2.0), (8, None, 1.0)]


def test_blocks_of_an_index_need_not_all_be_read(spark, monkeypatch, tmp_path):
    """Texts of one common and a few rare words: what is found equals a full search, and less is read."""
    import random

    from lodestone.operators import lexical_index, retrieve

    rng = random.Random(6)
    rows = [(i, " ".join(["common"] * rng.randint(1, 30) + [f"rare{rng.randrange(60)}" for _ in range(3)])) for i in range(900)] + [(900, None), (901, "")]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string")
    asked = spark.createDataFrame([(0, "common rare3 rare7"), (1, "rare5 rare5 common"), (2, "nothing known"), (3, "common")], "qid long, query string")
    monkeypatch.setattr(lexical_index, "BLOCK", 16)
    monkeypatch.setattr(lexical_index, "PART", 200)
    index = lexical_index.add(lexical_index.Index(str(tmp_path / "index")), "v1", chunks)
    hits, cost = lexical_index.search(index, asked, 5)
    full = lambda c: sorted(map(tuple, retrieve.bm25(asked, c, 5).collect()))
    assert sorted(map(tuple, hits.collect())) == full(chunks)
    read = {r.qid: (r.read, r.held) for r in cost.collect()}
    assert all(r < h / 2 for q, (r, h) in read.items() if q < 2)
    fresh = spark.createDataFrame([(5, "rare3 rare3 common"), (2000, "rare7")], "chunk_id long, text string")
    later = lexical_index.add(index, "v2", fresh, chunks.filter("chunk_id % 3 = 1").select("chunk_id"))
    live = chunks.filter("chunk_id % 3 <> 1 AND chunk_id <> 5").unionByName(fresh)
    assert sorted(map(tuple, lexical_index.search(later, asked, 5)[0].collect())) == full(live)
    assert sorted(map(tuple, lexical_index.search(lexical_index.compact(later, spark, "v3", live), asked, 5)[0].collect())) == full(live)
    assert [(r.seg, r.chunks, r.dead) for r in lexical_index.stored(later, spark).orderBy("seg").collect()] == [(0, 902, 302), (1, 2, 0)]


def test_latent_space_by_blocks_of_texts(spark, docs, monkeypatch):
    """Many blocks of texts and slices of their terms give what one gives, and no term's vector is moved once a text."""
    frame = spark.createDataFrame([*docs.items(), (-1, None), (-2, "")], "chunk_id long, text string")
    one = {r.chunk_id: np.array(r.vector) for r in embed.lsa_encode(frame, embed.lsa_fit(frame, 32), 32).collect()}
    monkeypatch.setattr(embed, "ENTRIES", 700)
    monkeypatch.setattr(embed, "SLICE", 50)
    rows, blocks = embed._rows(frame)
    assert blocks > 3 and rows.count() == len(docs) + 2
    moved = []
    added = embed._added
    monkeypatch.setattr(embed, "_added", lambda parts: added(moved.append(parts.filter("part = 0").count()) or parts))
    model = embed.lsa_fit(frame, 32)
    pairs = {(r.block, h) for r in rows.collect() for h in r.h}
    assert moved == [len(pairs)] * 2 and len(pairs) < sum(len(r.h) for r in rows.collect())
    many = {r.chunk_id: np.array(r.vector) for r in embed.lsa_encode(frame, model, 32).collect()}
    assert not many[-1].any() and not many[-2].any() and many.keys() == one.keys()
    # directions may turn round, their products may not
    a, b = (np.array([x[i] for i in docs]) for x in (one, many))
    assert np.allclose(a @ a.T, b @ b.T, atol=1e-3)


def test_a_latent_space_moves_what_was_asked_for_and_cuts_its_texts_once(spark, docs, monkeypatch):
    frame = spark.createDataFrame([*docs.items(), (-1, None)], "chunk_id long, text string")
    cut, rows = [], embed._rows
    monkeypatch.setattr(embed, "_rows", lambda texts: cut.append(1) or rows(texts))
    model = embed.lsa_fit(frame, 16)
    assert model.terms.agg(F.max(F.size("v"))).first()[0] == 16
    again = {r.chunk_id: r.vector for r in embed.lsa_encode(frame, model, 16, rows=model.rows).collect()}
    assert len(cut) == 1 and again.keys() == docs.keys() | {-1}
    assert all(np.allclose(r.vector, again[r.chunk_id], atol=1e-9) for r in embed.lsa_encode(frame, model, 16).collect()) and len(cut) == 2


def test_a_folder_of_blocks_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """Terms that aren't hot are dealt by more than their folder, each term to one task, and found as before."""
    import glob

    from lodestone.operators import lexical_index, retrieve

    words = [f"word{i}" for i in range(200)]
    chunks = spark.createDataFrame([(i, " ".join(words[(i * k) % 200] for k in range(1, 40))) for i in range(60)], "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "word3 word7 word9"), (2, "word100 word4")], "qid long, query string")
    monkeypatch.setattr(lexical_index, "SLOT", 10)
    monkeypatch.setattr(lexical_index, "FOLDERS", 2)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = lexical_index.add(lexical_index.Index(str(tmp_path / "index")), "v1", chunks)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert all(len(glob.glob(f"{tmp_path}/index/v1/blocks/folder={i}/*.parquet")) > 1 for i in range(2))
    assert sorted(map(tuple, lexical_index.search(index, asked, 5)[0].collect())) == sorted(map(tuple, retrieve.bm25(asked, chunks, 5).collect()))


def test_compaction_cuts_no_text_and_scores_make_no_rows_of_terms(spark, tmp_path, monkeypatch):
    """Plain texts are cut once, by no row a term; hot terms, slices, null texts, whole segments of none, ids and queries of texts."""
    from lodestone.operators import lexical_index, retrieve

    monkeypatch.setattr(lexical_index, "kept", (lambda real: lambda df: planned.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))(lexical_index.kept))
    monkeypatch.setattr(lexical_index, "DEALT", 30)
    monkeypatch.setattr(lexical_index, "TEXTS", 7)
    monkeypatch.setattr(lexical_index, "PART", 20)
    monkeypatch.setattr(lexical_index, "QUERY_BLOCK", 2)
    planned = []
    chunks = spark.createDataFrame([(f"c{i:03}", " ".join(["common"] * (i % 4 + 1) + [f"word{i % 9}", f"word{i % 5}", "Word3"])) for i in range(90)] + [("null", None), ("none", "")], "chunk_id string, text string")
    asked = spark.createDataFrame([("q1", "common word3 word3"), ("q2", "word7 word4"), ("q3", "word1 absent")], "qid string, query string")
    index = lexical_index.add(lexical_index.Index(str(tmp_path / "index")), "v1", chunks)
    fresh = spark.createDataFrame([("c005", "common word7 word7"), ("d", "word4")], "chunk_id string, text string")
    later = lexical_index.add(index, "v2", fresh, chunks.filter("chunk_id < 'c003'").select("chunk_id"))
    live = chunks.filter("chunk_id > 'c002' AND chunk_id <> 'c005'").unionByName(fresh)
    boom = live.withColumn("text", F.raise_error(F.lit("cut")).cast("string"))
    want = sorted(map(tuple, retrieve.bm25(asked, live, 5).collect()))
    whole = lexical_index.compact(later, spark, "v3", boom)
    for found in (later, whole):
        assert sorted(map(tuple, lexical_index.search(found, asked, 5)[0].collect())) == want
    assert not any("regexp_extract_all(coalesce(text" in p or "regexp_extract_all(text" in p for p in planned)
    blocks = whole.read(spark, "blocks")
    assert blocks.filter("term = 'common'").select("part").distinct().count() > 1
    assert {(r.term, r.chunk_id) for r in blocks.select("term", F.explode("postings.chunk_id").alias("chunk_id")).collect()} == {(t, r.chunk_id) for r in live.collect() for t in tokens(r.text or "")}


def test_the_loop_cuts_texts_and_makes_vectors_once(spark, monkeypatch):
    """However many turns there are, terms and vectors of the chunks are made once for the files."""
    from lodestone.operators import retrieve
    from lodestone.plans import base, retrieval

    monkeypatch.setattr(base, "_made", {})
    cut, made = [], []
    cut_terms, hashed_vectors = retrieve.cut_terms, embed.hashed_vectors
    monkeypatch.setattr(retrieve, "cut_terms", lambda *a, **b: cut.append(1) or cut_terms(*a, **b))
    monkeypatch.setattr(embed, "hashed_vectors", lambda texts, key="chunk_id", *a, **b: made.append(key) or hashed_vectors(texts, key, *a, **b))
    results, _, _ = retrieval.looped(spark, SF, 2, 2.0)
    assert results.filter("turns = 2").count() > 0
    assert len(cut) == 1 and made.count("chunk_id") == 1 and made.count("qid") == 2
