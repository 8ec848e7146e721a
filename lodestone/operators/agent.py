"""Parts of an agent's search loop, for all questions at once."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import IDENTIFIER, tokens


def decompose(question: Column, most: int = 3) -> Column:
    """Sub-questions: a relative clause first, then the parts between conjunctions of three words or more."""
    q = F.regexp_replace(F.trim(question), r"\?+$", "")
    outer, inner = F.trim(F.regexp_extract(q, r"(?is)^(.*?)\bthat\b(.*)$", 1)), F.trim(F.regexp_extract(q, r"(?is)^(.*?)\bthat\b(.*)$", 2))
    clause = q.rlike(r"(?i)\bthat\b") & (F.size(F.split(inner, r"\s+")) > 2)
    relative = F.when(clause, F.array(F.concat(F.lit("Which entity "), inner, F.lit("?")), F.concat(outer, F.lit(" (of that entity)?")))).otherwise(F.array().cast("array<string>"))
    parts = F.transform(F.split(F.regexp_replace(q, r"\band\b|;", "\x01"), "\x01"), lambda x: F.trim(x))
    long = F.transform(F.filter(parts, lambda p: F.size(F.split(p, r"\s+")) >= 3), lambda p: F.concat(p, F.lit("?")))
    found = F.slice(F.array_distinct(F.concat(relative, long)), 1, most)
    return F.when(F.size(found) > 0, found).otherwise(F.array(question))


def choose_tool(question: Column) -> Column:
    """Retriever for a sub-question, by its shape. The wordings that tell."""
    return (
        F.when(question.rlike(IDENTIFIER), "lexical")
        .when(question.rlike(r"\b(file|path|function|class|def |import )\b"), "grep")
        .when(question.rlike(r"(?i)\b(why|how|approach|strategy|concept|mean|difference)\b"), "dense")
        .otherwise("hybrid")
    )


def query_class(question: Column, is_null: Column) -> Column:
    """What a question demands of a retriever. The wordings that tell."""
    return (
        F.when(question.rlike(r"ERR_[A-Z_]+"), "identifier")
        .when(F.contains(question, F.lit("pause between")), "lexical gap")
        .when(F.contains(question, F.lit("headquartered in")) | F.contains(question, F.lit("-based")), "descriptor")
        .when(is_null, "null")
        .otherwise("named entity")
    )


#: Wordings that ask for more than one piece of evidence.
RELATIVE = r"(?i)\bthat\b.*\b(acquired|took over|bought|runs)\b"
COMPARING = r"(?i)\b(which came first|before or after|grew faster|higher revenue|speed up or slow down|already generally available)\b"


def looks_multihop(questions: DataFrame, names: DataFrame) -> DataFrame:
    """(qid, multihop) of (qid, query): two of the names (name) or a comparing wording; only the question is read."""
    named = questions.join(F.broadcast(names.select("name").distinct()), F.contains(F.lower("query"), F.lower("name"))).groupBy("qid").agg(F.count("*").alias("n"))
    worded = F.col("query").rlike(RELATIVE) | F.col("query").rlike(COMPARING)
    return questions.select("qid", "query").join(named, "qid", "left").select("qid", ((F.coalesce("n", F.lit(0)) >= 2) | worded).alias("multihop"))


def router_scores(routed: DataFrame, truth: DataFrame) -> DataFrame:
    """One row (precision, recall, routed) of (qid, multihop) against (qid, hops)."""
    m, t = F.col("multihop"), F.col("hops") >= 2
    counts = routed.join(truth, "qid").agg(F.count_if(m & t).alias("tp"), F.count_if(m & ~t).alias("fp"), F.count_if(~m & t).alias("fn"), F.count_if(m).alias("r"), F.count("*").alias("n"))
    one = F.lit(1)
    return counts.select(F.round(F.col("tp") / F.greatest(one, F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.col("tp") / F.greatest(one, F.col("tp") + F.col("fn")), 6).alias("recall"), F.round(F.col("r") / F.col("n"), 6).alias("routed"))


def sufficiency(subs: DataFrame, evidence: DataFrame, threshold: float = 0.34) -> DataFrame:
    """(qid, sufficient, covered, total): sub-questions (qid, sub) that a text of (qid, text) covers."""
    parts = subs.select("qid", "sub", F.array_distinct(tokens(F.col("sub"))).alias("t"))
    against = parts.join(evidence.select("qid", F.array_distinct(tokens(F.col("text"))).alias("e")), "qid", "left")
    share = F.when(F.size("t") == 0, 1.0).otherwise(F.coalesce(F.size(F.array_intersect("t", "e")) / F.size("t"), F.lit(0.0)))
    best = against.groupBy("qid", "sub").agg(F.max(share).alias("b"))
    return best.groupBy("qid").agg(F.bool_and(F.col("b") >= threshold).alias("sufficient"), F.count_if(F.col("b") >= threshold).alias("covered"), F.count("*").alias("total"))


def first_sufficient(steps: DataFrame, needs: DataFrame) -> DataFrame:
    """(qid, step): the first step at which (qid, step, item) has gathered all of (qid, item); null if none."""
    seen = steps.join(needs, ["qid", "item"]).groupBy("qid", "item").agg(F.min("step").alias("step"))
    have = seen.groupBy("qid").agg(F.count("*").alias("n"), F.max("step").alias("step"))
    total = needs.groupBy("qid").agg(F.countDistinct("item").alias("need"))
    return total.join(have, "qid", "left").select("qid", F.when(F.col("n") == F.col("need"), F.col("step")).alias("step"))


def search_loop(questions: DataFrame, retrieve, turns: int = 5, threshold: float = 0.34, single_shot: bool = False, seconds: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The loop over all questions; each turn is one round of jobs for the open ones.

    ``retrieve(queries)`` returns (qid, chunk_id, text, rank) for (qid, query, tool). The first turn asks the
    question; later ones ask it together with the first sub-question that the evidence doesn't cover. A
    question stops when its evidence suffices, when a turn brings nothing new, when a query was asked before,
    after one turn if ``single_shot``, after ``seconds`` of the whole loop, or at the last turn.

    Returns results (qid, turns, stop_reason, missing), turns (qid, n, target, tool, query, n_new,
    sufficient) and evidence (qid, chunk_id, text, turn, rank).
    """
    from lodestone.operators._state import kept

    started = time.monotonic()
    q = kept(questions.select("qid", "query"))
    subs = kept(q.select("qid", F.posexplode(decompose(F.col("query"))).alias("n", "sub")).withColumn("t", F.array_distinct(tokens(F.col("sub")))))
    state = q.select("qid", F.lit(None).cast("string").alias("stop_reason"), F.lit(0).alias("turns"), F.col("query").alias("target"), F.array().cast("array<string>").alias("issued"), F.array().cast("array<string>").alias("missing"))
    state = kept(state)
    evidence = log = None
    for turn in range(1, turns + 1):
        open_ = state.filter(F.col("stop_reason").isNull())
        if open_.isEmpty():
            break
        asked = open_.join(q, "qid").withColumn("ask", F.col("query") if turn == 1 else F.concat("query", F.lit(" "), "target"))
        norm = F.array_join(F.array_sort(F.array_distinct(tokens(F.col("ask")))), " ")
        asked = kept(asked.withColumn("norm", norm).withColumn("again", F.array_contains("issued", F.col("norm"))).select("qid", "target", "ask", "norm", "again", choose_tool(F.col("target")).alias("tool")))
        fresh = asked.filter(~F.col("again"))
        got = retrieve(fresh.select("qid", F.col("ask").alias("query"), "tool")).select("qid", "chunk_id", "text", "rank")
        new = got if evidence is None else got.join(evidence.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti")
        new = kept(new.withColumn("turn", F.lit(turn)))
        evidence = new if evidence is None else kept(evidence.unionByName(new))
        against = subs.join(fresh.select("qid"), "qid").join(evidence.select("qid", F.array_distinct(tokens(F.col("text"))).alias("e")), "qid", "left")
        share = F.when(F.size("t") == 0, 1.0).otherwise(F.coalesce(F.size(F.array_intersect("t", "e")) / F.size("t"), F.lit(0.0)))
        covered = against.groupBy("qid", "n", "sub").agg(F.max(share).alias("b"))
        gaps = F.transform(F.sort_array(F.collect_list(F.when(F.col("b") < threshold, F.struct("n", "sub")))), lambda x: x["sub"])
        enough = covered.groupBy("qid").agg(gaps.alias("gaps"))
        some = new.groupBy("qid").agg(F.count("*").alias("n_new"))
        step = kept(asked.join(enough, "qid", "left").join(some, "qid", "left").withColumn("n_new", F.coalesce("n_new", F.lit(0))).withColumn("sufficient", F.coalesce(F.size("gaps") == 0, F.lit(False))))
        entry = step.filter(~F.col("again")).select("qid", F.lit(turn).alias("n"), "target", "tool", F.col("ask").alias("query"), "n_new", "sufficient")
        log = entry if log is None else log.unionByName(entry)
        late = seconds is not None and time.monotonic() - started > seconds
        reason = (
            F.when(F.col("again"), "repeated query")
            .when(F.col("sufficient"), "sufficient")
            .when(F.col("n_new") == 0, "no new evidence")
            .when(F.lit(single_shot and turn == 1), "single shot")
            .when(F.lit(late), "deadline")
            .when(F.lit(turn == turns), "turn cap")
        )
        after = step.select("qid", reason.alias("why"), "again", "norm", "gaps")
        both = state.join(after, "qid", "left")
        went = F.col("norm").isNotNull()
        counted = went & ~F.col("again")
        following = F.when(F.size("gaps") > 0, F.col("gaps")[0]).otherwise(F.col("question"))
        both = both.join(q.select("qid", F.col("query").alias("question")), "qid")
        state = kept(
            both.select(
                "qid",
                F.coalesce("stop_reason", "why").alias("stop_reason"),
                F.when(counted, F.lit(turn)).otherwise(F.col("turns")).alias("turns"),
                F.when(counted, following).otherwise(F.col("target")).alias("target"),
                F.when(counted, F.concat("issued", F.array("norm"))).otherwise(F.col("issued")).alias("issued"),
                F.when(counted, F.col("gaps")).otherwise(F.col("missing")).alias("missing"),
            )
        )
    return state.select("qid", "turns", "stop_reason", "missing"), log, evidence


def partial_answers(answers: DataFrame, results: DataFrame) -> DataFrame:
    """(qid, answer): what was found, marked as partial where the loop stopped before its evidence sufficed."""
    gap = F.when(F.size("missing") > 0, F.array_join(F.slice("missing", 1, 2), ", ")).otherwise("part of the question")
    note = F.concat("answer", F.lit("\n\nPARTIAL: the loop stopped because of: "), "stop_reason", F.lit(". Unconfirmed: "), gap, F.lit("."))
    whole = (F.col("stop_reason") == "sufficient") | F.contains("answer", F.lit("INSUFFICIENT_EVIDENCE"))
    return answers.join(results, "qid").select("qid", F.when(whole, F.col("answer")).otherwise(note).alias("answer"))


def trace_scores(results: DataFrame, questions: DataFrame, evidence: DataFrame, packed: DataFrame, gold: DataFrame) -> DataFrame:
    """Scores of the search itself: how well questions were taken apart, turns against the fewest needed, evidence
    gathered and kept, what was found and then lost, and whether the loop stopped for the right reason."""
    subs = questions.select("qid", F.posexplode(decompose(F.col("query"))).alias("n", "sub"))
    touched = subs.join(evidence.select("qid", F.array_distinct(tokens(F.col("text"))).alias("e")), "qid", "left").groupBy("qid", "n").agg(F.max(F.coalesce(F.arrays_overlap(tokens(F.col("sub")), "e"), F.lit(False)).cast("int")).alias("c"))
    quality = touched.groupBy("qid").agg(F.round(F.avg("c"), 3).alias("decomposition_quality"))

    def anchors(hits: DataFrame, name: str) -> DataFrame:
        flagged = gold.join(hits.select("qid", "chunk_id").distinct().withColumn(name, F.lit(1)), ["qid", "chunk_id"], "left")
        return flagged.groupBy("qid", "anchor_idx").agg(F.max(F.coalesce(name, F.lit(0))).alias(name))

    both = anchors(evidence, "found").join(anchors(packed, "kept"), ["qid", "anchor_idx"])
    per = both.groupBy("qid").agg(F.count("*").alias("k"), F.round(F.avg("found"), 3).alias("cumulative_evidence_recall"), F.round(F.avg("kept"), 3).alias("evidence_retention"), F.count_if((F.col("found") == 1) & (F.col("kept") == 0)).alias("found_then_lost"))
    fewest = F.greatest(F.lit(1), F.coalesce("k", F.lit(0)))
    out = results.join(quality, "qid", "left").join(per, "qid", "left")
    efficiency = F.round(F.least(F.lit(1.0), fewest / F.greatest(F.lit(1), "turns")), 3)
    return out.select("qid", "turns", "stop_reason", "decomposition_quality", efficiency.alias("turn_efficiency"), "cumulative_evidence_recall", "evidence_retention", F.coalesce("found_then_lost", F.lit(0)).alias("found_then_lost"), (F.col("stop_reason") == "sufficient").alias("stopped_well"))


def loop_stats(turns: DataFrame, evidence: DataFrame, packed: DataFrame, questions: DataFrame) -> DataFrame:
    """(measure, value): drift of the queries by turn, evidence gathered and packed, tools a turn."""
    q = questions.select("qid", F.array_distinct(tokens(F.col("query"))).alias("q0"))
    shared = turns.join(q, "qid").select("n", (F.size(F.array_intersect("q0", tokens(F.col("query")))) / F.greatest(F.lit(1), F.size("q0"))).alias("v"))
    drift = shared.groupBy("n").agg(F.avg("v").alias("value")).select(F.concat(F.lit("overlap in turn "), F.col("n").cast("string")).alias("measure"), "value")
    tools = turns.groupBy("qid").agg((F.countDistinct("tool") / F.count("*")).alias("v")).agg(F.avg("v").alias("value")).select(F.lit("tools a turn").alias("measure"), "value")

    def size(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("qid").agg(F.count("*").alias("v")).agg(F.avg("v").alias("value")).select(F.lit(name).alias("measure"), "value")

    out = drift.unionByName(tools).unionByName(size(evidence, "chunks gathered")).unionByName(size(packed, "chunks packed"))
    return out.select("measure", F.round("value", 6).alias("value"))


def escalated(first: DataFrame, subs_covered: DataFrame, looped: DataFrame) -> DataFrame:
    """(qid, mode, turns, tokens): single answers (qid, tokens) whose sub-questions (qid, sufficient) are covered stay,
    others pay for each turn of the loop (qid, turns, tokens)."""
    rows = first.select("qid", F.col("tokens").alias("once")).join(subs_covered, "qid").join(looped.select("qid", "turns", F.col("tokens").alias("each")), "qid")
    stay = F.col("sufficient")
    return rows.select("qid", F.when(stay, "single").otherwise("escalated").alias("mode"), F.when(stay, 1).otherwise(F.col("turns")).alias("turns"), F.when(stay, F.col("once")).otherwise(F.col("each") * F.greatest(F.lit(1), "turns")).alias("tokens"))
