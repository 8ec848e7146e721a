"""Retrieval and answer metrics as aggregates over (qid, chunk_id, rank) and gold (qid, anchor, chunk_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def anchors_found(questions: DataFrame, gold: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """(qid, anchor_idx, first_rank): rank of the first hit within ``k`` that holds the anchor, or null."""
    near = hits.filter(F.col("rank") <= k).select("qid", "chunk_id", "rank")
    return gold.join(questions.select("qid"), "qid").join(near, ["qid", "chunk_id"], "left").groupBy("qid", "anchor_idx").agg(F.min("rank").alias("first_rank"))


def retrieval_metrics(questions: DataFrame, gold: DataFrame, hits: DataFrame, k: int = 8) -> DataFrame:
    """evidence_recall, full_chain, mrr and greedy ndcg of each question; null, not 0, without gold (qid, anchor_idx, chunk_id)."""
    per = anchors_found(questions, gold, hits, k).groupBy("qid").agg(
        F.round(F.avg(F.col("first_rank").isNotNull().cast("int")), 6).alias("evidence_recall"),
        F.min(F.col("first_rank").isNotNull().cast("double")).alias("full_chain"),
        F.round(F.coalesce(1 / F.min("first_rank"), F.lit(0.0)), 6).alias("mrr"),
    )
    return questions.select("qid").join(per, "qid", "left").join(greedy_ndcg(gold, hits, k), "qid", "left").select("qid", "evidence_recall", "full_chain", "mrr", "ndcg")


def greedy_ndcg(gold: DataFrame, hits: DataFrame, k: int = 10) -> DataFrame:
    """nDCG when a chunk may hold several anchors: each hit credits the first anchor not credited yet."""
    holds = gold.groupBy("qid", "chunk_id").agg(F.sort_array(F.collect_set("anchor_idx")).alias("anchors"))
    ranked = hits.filter(F.col("rank") <= k).join(holds, ["qid", "chunk_id"]).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "anchors"))).alias("h"))
    n_anchors = gold.groupBy("qid").agg(F.countDistinct("anchor_idx").alias("n"))
    kind = gold.schema["anchor_idx"].dataType.simpleString()
    fold = F.expr(
        f"aggregate(h, named_struct('seen', cast(array() AS array<{kind}>), 'gain', 0.0D), "
        "(s, x) -> named_struct('seen', if(size(array_except(x.anchors, s.seen)) > 0, concat(s.seen, slice(filter(x.anchors, a -> NOT array_contains(s.seen, a)), 1, 1)), s.seen), "
        "'gain', if(size(array_except(x.anchors, s.seen)) > 0, s.gain + 1 / log2(x.rank + 1), s.gain)), s -> s.gain)"
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    return n_anchors.join(ranked.select("qid", fold.alias("gain")), "qid", "left").select("qid", F.round(F.coalesce("gain", F.lit(0.0)) / ideal, 6).alias("ndcg"))


def context_precision(hits: DataFrame, gold: DataFrame, questions: DataFrame, k: int = 8) -> DataFrame:
    """Share of the packed chunks that are gold; 0 for questions without packed chunks or gold."""
    flagged = hits.filter(F.col("rank") <= k).join(gold.select("qid", "chunk_id").distinct().withColumn("g", F.lit(1)), ["qid", "chunk_id"], "left")
    per = flagged.groupBy("qid").agg(F.avg(F.coalesce("g", F.lit(0))).alias("p"))
    return questions.select("qid").join(per, "qid", "left").select("qid", F.round(F.coalesce("p", F.lit(0.0)), 6).alias("context_precision"))


def abstention(rows: DataFrame, is_null: Column, abstained: Column) -> DataFrame:
    """Precision, recall and F1 of abstaining, false answers and over-refusals, in one row."""
    tp, fp, fn = (F.count_if(c) for c in (is_null & abstained, ~is_null & abstained, is_null & ~abstained))
    counts = rows.agg(tp.alias("tp"), fp.alias("over_refusals"), fn.alias("false_answers"))
    p = F.when(F.col("tp") + F.col("over_refusals") > 0, F.col("tp") / (F.col("tp") + F.col("over_refusals")))
    r = F.when(F.col("tp") + F.col("false_answers") > 0, F.col("tp") / (F.col("tp") + F.col("false_answers")))
    f1 = F.when((p > 0) & (r > 0), 2 * p * r / (p + r)).otherwise(0.0)
    return counts.select(F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"), "false_answers", "over_refusals")


def ranked_value(rows: DataFrame, column: str, share: float, from_zero: bool = False) -> DataFrame:
    """One row (value): the value at int(share n) of the sorted non-null values, counted from 1, or from 0.

    Values are counted first, so what is sorted in one place is one row a distinct value.
    """
    counts = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    before = counts.withColumn("upto", F.sum("n").over(Window.orderBy("value")))
    at = counts.agg(F.sum("n").alias("total")).select((F.floor(F.col("total") * share) + 1 if from_zero else F.greatest(F.lit(1), F.floor(F.col("total") * share))).alias("at"))
    return before.crossJoin(F.broadcast(at)).filter(F.col("upto") >= F.col("at")).agg(F.min("value").alias("value"))


def slice_report(rows: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """Means of metrics over the values of a column; "?" where it is missing."""
    return rows.groupBy(F.coalesce(F.col(by).cast("string"), F.lit("?")).alias(by)).agg(F.count("*").alias("n"), *(F.round(F.avg(m), 3).alias(m) for m in metrics))


def failure_overlap(lexical: DataFrame, dense: DataFrame) -> DataFrame:
    """Of two sets of missed questions (qid): conditional, Jaccard, and what only one missed."""
    both = lexical.select("qid", F.lit(1).alias("l"), F.lit(0).alias("d")).unionByName(dense.select("qid", F.lit(0).alias("l"), F.lit(1).alias("d"))).groupBy("qid").agg(F.max("l").alias("l"), F.max("d").alias("d"))
    return both.agg(F.sum("d").alias("n_dense"), F.sum("l").alias("n_lexical"), F.sum(F.col("l") * F.col("d")).alias("n_both"), F.count("*").alias("n_either")).select(
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_dense", "n_lexical", "n_both", "n_either")),
        F.round(F.when(F.col("n_dense") > 0, F.col("n_both") / F.col("n_dense")).otherwise(0.0), 6).alias("conditional"),
        F.round(F.when(F.col("n_either") > 0, F.col("n_both") / F.col("n_either")).otherwise(0.0), 6).alias("jaccard"),
    )


def independence(gold_counts: DataFrame, p: float) -> DataFrame:
    """Full-chain recall that independent evidence would give: the mean of p ** anchors over (n_anchors, n)."""
    return gold_counts.agg(F.round(F.sum(F.col("n") * F.pow(F.lit(p), F.col("n_anchors"))) / F.sum("n"), 4).alias("predicted"))


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two labels, 1 if chance agreement is certain, with raw agreement."""
    cells = pairs.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("t"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("agree"))
    left, right = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy(F.col("b").alias("a")).agg(F.sum("n").alias("nb"))
    chance = left.join(right, "a").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("c"))
    joined = total.crossJoin(chance).withColumns({"po": F.col("agree") / F.col("t"), "pe": F.col("c") / (F.col("t") * F.col("t"))})
    value = F.when(F.col("pe") == 1, F.lit(1.0)).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe")))
    return joined.select(F.round(value, 6).alias("kappa"), F.round("po", 6).alias("agreement"), F.col("t").alias("n"))


#: Chances of at most so many draws of a row (Poisson with mean 1).
DRAWS = (0.367879441, 0.735758882, 0.919698603, 0.981011843, 0.996340153, 0.999405815, 0.999916759)


def resampled_means(rows: DataFrame, n_boot: int, seed: int = 11) -> DataFrame:
    """(rep, m): means of (qid, d) over resamples. How often a row is drawn comes from an md5 of replicate and
    id, so any engine draws alike, one scan suffices, and sums are made from partial ones."""
    rep = F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))
    drawn = rows.select("qid", "d", rep.alias("rep"))
    digest = F.md5(F.encode(F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), F.col("qid").cast("string")), "UTF-8"))
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / 4294967296.0
    times = F.lit(len(DRAWS))
    for n, chance in reversed(list(enumerate(DRAWS))):
        times = F.when(F.col("u") < chance, n).otherwise(times)
    weighted = drawn.withColumn("u", u).withColumn("w", times)
    return weighted.groupBy("rep").agg(F.sum(F.col("w") * F.col("d")).alias("s"), F.sum("w").alias("n")).filter("n > 0").select("rep", F.round(F.col("s") / F.col("n"), 9).alias("m"))


def paired_bootstrap(pairs: DataFrame, n_boot: int = 200, seed: int = 11) -> DataFrame:
    """Confidence interval of mean(b - a) over (qid, a, b), both known, by resampling."""
    rows = pairs.filter(F.col("a").isNotNull() & F.col("b").isNotNull()).select("qid", (F.col("b") - F.col("a")).alias("d"))
    ordered = resampled_means(rows, n_boot, seed).agg(F.sort_array(F.collect_list("m")).alias("ms"), F.round(F.avg(F.when(F.col("m") > 0, 1.0).otherwise(0.0)), 6).alias("p_better"))
    low = F.element_at("ms", F.lit(int(0.025 * n_boot) + 1))
    high = F.element_at("ms", F.lit(int(0.975 * n_boot)))
    delta = rows.agg(F.round(F.avg("d"), 6).alias("delta"))
    out = delta.crossJoin(ordered).select("delta", F.round(low, 6).alias("lo"), F.round(high, 6).alias("hi"), "p_better")
    return out.withColumn("verdict", F.when((F.col("lo") > 0) | (F.col("hi") < 0), "real").otherwise("inside the noise band"))


def noise_band(rows: DataFrame, n_boot: int = 400, seed: int = 3) -> DataFrame:
    """One row (lo, hi, band) of a single run's (qid, d): the tenth resampled mean from either end, and half the way between."""
    ms = resampled_means(rows.filter(F.col("d").isNotNull()), n_boot, seed).agg(F.sort_array(F.collect_list("m")).alias("ms"))
    return ms.select(F.element_at("ms", 11).alias("lo"), F.element_at("ms", -10).alias("hi")).select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), F.round((F.col("hi") - F.col("lo")) / 2, 4).alias("band"))


def agreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Kappa of two labels with its strength and whether a judge of such agreement is of use."""
    k = F.col("kappa")
    band = F.when(k < 0.2, "poor").when(k < 0.4, "fair").when(k < 0.6, "moderate").when(k < 0.8, "substantial").otherwise("almost perfect")
    return kappa(pairs, a, b).select("kappa", "agreement", band.alias("strength"), (k >= 0.6).alias("usable"), "n")


def recall_of(gold: DataFrame, hits: DataFrame, name: str) -> DataFrame:
    """(qid, <name>, <name>_chain): share of a question's anchors that a hit of any rank holds, and whether all are."""
    per = gold.join(hits.select("qid", "chunk_id").distinct().withColumn("in", F.lit(1)), ["qid", "chunk_id"], "left").groupBy("qid", "anchor_idx").agg(F.max(F.coalesce("in", F.lit(0))).alias("f"))
    return per.groupBy("qid").agg(F.round(F.avg("f"), 6).alias(name), F.min("f").cast("double").alias(f"{name}_chain"))


def ann_recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row (recall): the share of exact neighbours (qid, chunk_id) that an approximate search found."""
    both = exact.select("qid", "chunk_id").join(found.select("qid", "chunk_id").distinct().withColumn("f", F.lit(1)), ["qid", "chunk_id"], "left")
    return both.agg(F.round(F.avg(F.coalesce("f", F.lit(0))), 6).alias("recall"))


def citation_accuracy(answers: DataFrame, packed: DataFrame, gold: DataFrame) -> DataFrame:
    """(qid, resolvable, on_gold) of (qid, citations): shares of cited places that are packed (qid, rank, chunk_id),
    and that hold gold; null without citations."""
    cited = answers.select("qid", F.explode(F.array_distinct("citations")).alias("sid")).withColumn("rank", F.expr("try_cast(substring(sid, 2) AS INT)"))
    at = cited.join(packed.select("qid", "rank", "chunk_id"), ["qid", "rank"], "left")
    known = gold.select("qid", "chunk_id").distinct().withColumn("g", F.lit(1))
    per = at.join(known, ["qid", "chunk_id"], "left").groupBy("qid").agg(F.round(F.avg(F.col("chunk_id").isNotNull().cast("int")), 6).alias("resolvable"), F.round(F.avg(F.coalesce("g", F.lit(0))), 6).alias("on_gold"))
    return answers.select("qid").join(per, "qid", "left")


def evaluate(questions: DataFrame, anchors: DataFrame, gold: DataFrame, candidates: DataFrame, packed: DataFrame, answers: DataFrame, k: int = 8, stable_tokens: int = 0, rates=None) -> DataFrame:
    """One row a question with all that reports are made of: what its evidence was, where it got lost, what was said.

    ``questions`` is (qid, query, answer), ``anchors`` (qid, anchor_idx), ``packed`` (qid, chunk_id, rank,
    n_tokens), ``answers`` (qid, answer, citations). A question whose anchors no chunk holds is a null one.
    """
    from lodestone.functions.text import approx_tokens
    from lodestone.operators import judge, rerank
    from lodestone.operators.economy import Rates

    rates = rates or Rates()
    asked = anchors.groupBy("qid").agg(F.countDistinct("anchor_idx").alias("hops"))
    resolved = gold.groupBy("qid").agg(F.countDistinct("anchor_idx").alias("gold_items"))
    mine = packed.groupBy("qid").agg(F.sum("n_tokens").alias("evidence_tokens"))
    correct = judge.answer_correct(questions.select("qid", F.col("answer").alias("gold")).join(answers.select("qid", "answer"), "qid"))
    rows = questions.select("qid", "query").join(asked, "qid", "left").join(resolved, "qid", "left").join(mine, "qid", "left")
    rows = rows.join(recall_of(gold, packed, "evidence_recall"), "qid", "left").join(recall_of(gold, candidates, "recall_at_n"), "qid", "left")
    near = retrieval_metrics(questions, gold, candidates, k).select("qid", "ndcg")
    first = anchors_found(questions, gold, candidates, 1 << 30).groupBy("qid").agg(F.round(F.coalesce(1 / F.min("first_rank"), F.lit(0.0)), 6).alias("mrr"))
    rows = rows.join(near, "qid", "left").join(first, "qid", "left").join(context_precision(packed, gold, questions, 1 << 30), "qid", "left")
    rows = rows.join(rerank.ceiling(questions, gold, candidates, 1 << 30), "qid", "left").join(answers.select("qid", "answer"), "qid", "left").join(correct, "qid", "left")
    rows = rows.join(citation_accuracy(answers, packed, gold), "qid", "left")
    rows = rows.withColumns({"gold_items": F.coalesce("gold_items", F.lit(0)), "is_null": F.col("gold_items").isNull(), "abstained": judge.abstained(F.col("answer"))})
    tokens_in = F.lit(stable_tokens) + F.coalesce("evidence_tokens", F.lit(0)) + approx_tokens(F.col("query"))
    tokens_out = F.when(F.col("abstained"), 6).otherwise(F.greatest(F.lit(8), F.floor(F.length("answer") / 4).cast("int")))
    rows = rows.withColumns({"answer_correct": F.when(F.col("is_null"), F.col("abstained").cast("double")).otherwise(F.col("correct")), "unresolved_gold": F.col("hops") - F.col("gold_items"), "tokens_in": tokens_in.cast("long"), "tokens_out": tokens_out.cast("long")})
    rows = rows.withColumn("cost_usd", F.round(rates.cost(F.col("tokens_in"), F.col("tokens_out")), 8))
    names = ["hops", "is_null", "gold_items", "unresolved_gold", "evidence_recall", "recall_at_n", "ndcg", "mrr", "context_precision", "ceiling", "answer", "abstained", "answer_correct"]
    return rows.select("qid", *names, F.col("evidence_recall_chain").alias("full_chain"), F.col("recall_at_n_chain").alias("full_chain_at_n"), F.col("resolvable").alias("citation_resolvable"), F.col("on_gold").alias("citation_on_gold"), "tokens_in", "tokens_out", "cost_usd")


QUALITY = ["evidence_recall", "full_chain", "ndcg", "mrr", "context_precision", "answer_correct"]


def summarize(rows: DataFrame, counters: tuple[str, ...] = ("tokens_in", "tokens_out", "cost_usd")) -> DataFrame:
    """A run in one row: means of what is known, scores of abstaining, means and p95 of the counters."""
    from lodestone.operators._state import kept

    rows = kept(rows)
    means = rows.agg(F.count("*").alias("n"), *(F.round(F.avg(m), 6).alias(m) for m in (*QUALITY, *counters)))
    out = means.crossJoin(abstention(rows, F.col("is_null"), F.col("abstained")).withColumnsRenamed({"precision": "abstention_precision", "recall": "abstention_recall", "f1": "abstention_f1"}))
    for c in counters:
        out = out.crossJoin(ranked_value(rows, c, 0.95).select(F.col("value").alias(f"{c}_p95")))
    return out


def compare_runs(runs: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """(run, n, ...): means of each named run's rows."""
    parts = [rows.agg(F.count("*").alias("n"), *(F.round(F.avg(k), 4).alias(k) for k in keys)).select(F.lit(name).alias("run"), "*") for name, rows in runs.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def slice_deltas(base: DataFrame, run: DataFrame, by: str, metric: str, tolerance: float = 0.02) -> DataFrame:
    """(slice, base, run, delta, regressed): a run's means against a baseline's in each slice; an average can
    improve while a slice gets worse."""
    def means(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(F.col(by).alias("slice")).agg(F.avg(metric).alias(name))

    both = means(base, "base").join(means(run, "run"), "slice").withColumn("delta", F.col("run") - F.col("base"))
    return both.select("slice", F.round("base", 6).alias("base"), F.round("run", 6).alias("run"), F.round("delta", 6).alias("delta"), (F.col("delta") < -tolerance).alias("regressed"))


def gate(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(metric, baseline, current, delta, gate) of (metric, current) and (metric, baseline, tolerance)."""
    delta = F.round(F.col("current") - F.col("baseline"), 6)
    return baseline.join(current, "metric").select("metric", "baseline", "current", delta.alias("delta"), F.when(delta < -F.col("tolerance"), "BLOCK").otherwise("ok").alias("gate"))


def within_ceilings(ledger: DataFrame, ceilings: dict[str, float]) -> DataFrame:
    """A ledger of runs with a flag for each ceiling that a run keeps to."""
    return ledger.withColumns({f"{name}_ok": F.col(name) <= most for name, most in ceilings.items()})


def diagnosis(rows: DataFrame) -> DataFrame:
    """(case, n, share): answerable questions answered rightly without evidence, wrongly with all of it, or with
    some of several anchors missing; null questions that were answered."""
    answerable = ~F.col("is_null")
    cases = {
        "lucky": answerable & (F.col("answer_correct") >= 1) & (F.col("evidence_recall") == 0),
        "blind": answerable & (F.col("answer_correct") == 0) & (F.col("full_chain") >= 1),
        "half chain": answerable & (F.col("gold_items") >= 2) & (F.col("evidence_recall") > 0) & (F.col("evidence_recall") < 1),
        "false answer": F.col("is_null") & ~F.col("abstained"),
    }
    counts = rows.agg(*(F.count_if(c).alias(name) for name, c in cases.items()), F.count_if(answerable).alias("of"), F.count_if(F.col("is_null")).alias("null_of"))
    of = F.when(F.col("case") == "false answer", F.col("null_of")).otherwise(F.col("of"))
    return counts.unpivot(["of", "null_of"], list(cases), "case", "n").select("case", "n", F.round(F.when(of > 0, F.col("n") / of), 6).alias("share"))


def threshold_sweep(rows: DataFrame, thetas: list[float]) -> DataFrame:
    """(theta, precision, recall, f1, best): abstaining below each theta on (is_null, top), the best F1 flagged."""
    grid = rows.sparkSession.createDataFrame([(float(t),) for t in thetas], "theta double")
    low = F.col("top") < F.col("theta")
    counts = rows.join(F.broadcast(grid)).groupBy("theta").agg(F.count_if(low & F.col("is_null")).alias("tp"), F.count_if(low & ~F.col("is_null")).alias("fp"), F.count_if(~low & F.col("is_null")).alias("fn"))
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    scored = counts.select("theta", p.alias("p"), r.alias("r")).withColumn("f1", F.round(F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0), 6))
    best = scored.agg(F.min_by("theta", F.struct(-F.col("f1"), F.col("theta"))).alias("at"))
    return scored.crossJoin(F.broadcast(best)).select("theta", F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), "f1", (F.col("theta") == F.col("at")).alias("best"))


def quartiles(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, p25, p50, p75) of a value."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), *(F.round(F.percentile(value, p), 6).alias(f"p{int(100 * p)}") for p in (0.25, 0.5, 0.75)))


def document_metrics(results: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """One row (recall, full_chain, mrr, n) over the questions of gold (qid, doc_id); a question without results counts as 0."""
    near = results.filter(F.col("rank") <= k).groupBy("qid", "doc_id").agg(F.min("rank").alias("rank"))
    per = gold.select("qid", "doc_id").distinct().join(near, ["qid", "doc_id"], "left").groupBy("qid").agg(F.avg(F.col("rank").isNotNull().cast("int")).alias("r"), F.min(F.col("rank").isNotNull().cast("int")).alias("c"), F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("m"))
    return per.agg(F.round(F.coalesce(F.avg("r"), F.lit(0.0)), 6).alias("recall"), F.round(F.coalesce(F.avg("c"), F.lit(0.0)), 6).alias("full_chain"), F.round(F.coalesce(F.avg("m"), F.lit(0.0)), 6).alias("mrr"), F.count("*").alias("n"))


def independence_report(gold: DataFrame, hits: DataFrame) -> DataFrame:
    """Full-chain recall as measured, and as independent evidence would give it from the mean recall of questions
    (macro) and of anchors (micro)."""
    from lodestone.operators._state import kept

    per = kept(recall_of(gold, hits, "r").join(gold.groupBy("qid").agg(F.countDistinct("anchor_idx").alias("k")), "qid"))
    means = per.agg(F.avg("r").alias("macro"), (F.sum(F.round(F.col("r") * F.col("k"))) / F.sum("k")).alias("micro"), F.avg("r_chain").alias("full"))
    guess = per.crossJoin(F.broadcast(means)).agg(F.avg(F.pow("macro", "k")).alias("pa"), F.avg(F.pow("micro", "k")).alias("pi"))
    names = {"macro": "macro", "micro": "micro", "full": "full_chain", "pa": "predicted_macro", "pi": "predicted_micro"}
    out = means.crossJoin(guess)
    return out.select(*(F.round(c, 4).alias(n) for c, n in names.items()), F.round(F.col("full") - F.col("pa"), 4).alias("delta_macro"), F.round(F.col("full") - F.col("pi"), 4).alias("delta_micro"))


def diff_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """(qid, chunk_id, old_rank, new_rank, change) of two runs' hits."""
    both = old.select("qid", "chunk_id", F.col("rank").alias("old_rank")).join(new.select("qid", "chunk_id", F.col("rank").alias("new_rank")), ["qid", "chunk_id"], "full")
    change = F.when(F.col("old_rank").isNull(), "added").when(F.col("new_rank").isNull(), "dropped").when(F.col("old_rank") == F.col("new_rank"), "same").otherwise("moved")
    return both.select("chunk_id", "qid", "old_rank", "new_rank", change.alias("change"))
