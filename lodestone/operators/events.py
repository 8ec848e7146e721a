"""Event analytics: progress folds, digests, activity, and waves of prerequisites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators._state import kept


def progress(events: DataFrame) -> DataFrame:
    """Per login, from (login, unit, thread, kind, ts, event_id): attempts, cleared, still_open, retries, hints, last_active.

    A retry is a grade on a thread that already failed; open are units that were tried and not cleared.
    """
    before = Window.partitionBy("login", "thread").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    failed = F.coalesce(F.max((F.col("kind") == "fail").cast("int")).over(before), F.lit(0)) == 1
    graded = F.col("kind").isin("fail", "pass")
    rows = events.withColumn("retry", graded & failed)
    return rows.groupBy("login").agg(
        F.count_if(graded).alias("attempts"),
        F.count_distinct(F.when(F.col("kind") == "pass", F.col("unit"))).alias("cleared"),
        (F.count_distinct(F.when(graded, F.col("unit"))) - F.count_distinct(F.when(F.col("kind") == "pass", F.col("unit")))).alias("still_open"),
        F.count_if("retry").alias("retries"),
        F.count_if(F.col("kind") == "hint").alias("hints"),
        F.max("ts").alias("last_active"),
    )


def digest(events: DataFrame, since, until) -> DataFrame:
    """Per unit within a time span: graded, cleared, hints, and the share that cleared."""
    inside = events.filter((F.col("ts") >= F.lit(since)) & (F.col("ts") < F.lit(until)))
    graded, cleared = F.count_if(F.col("kind").isin("fail", "pass")), F.count_if(F.col("kind") == "pass")
    return inside.groupBy("unit").agg(graded.alias("graded"), cleared.alias("cleared"), F.count_if(F.col("kind") == "hint").alias("hints"), F.round(F.when(graded > 0, cleared / graded), 6).alias("share"))


def stages(cleared: DataFrame, tracks: DataFrame, names: DataFrame) -> DataFrame:
    """(login, stage): the furthest track that a login has cleared a unit of.

    ``cleared`` is (login, unit) with a null unit for a login that has cleared none, ``tracks`` (unit, track),
    ``names`` (track, nth, stage).
    """
    total = tracks.agg(F.countDistinct("unit").alias("all"))
    placed = cleared.distinct().join(tracks, "unit", "left").join(names, "track", "left")
    per = placed.groupBy("login").agg(F.countDistinct(F.when(F.col("track").isNotNull(), F.col("unit"))).alias("n"), F.count("unit").alias("some"), F.max(F.struct("nth", "stage")).alias("far"))
    first = names.agg(F.min_by("stage", "nth").alias("first"))
    stage = F.when(F.col("some") == 0, "Starting").when(F.col("n") >= F.col("all"), "Complete").otherwise(F.coalesce(F.col("far.stage"), F.col("first")))
    return per.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(first)).select("login", stage.alias("stage"))


def failing_checks(events: DataFrame, most: int = 10) -> DataFrame:
    """(check_name, n, share): the checks (array checks) that failed most often, with their share of failed grades."""
    failed = events.filter(F.col("kind") == "fail")
    total = failed.agg(F.count("*").alias("t"))
    counts = failed.select(F.explode("checks").alias("check_name")).groupBy("check_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "check_name").limit(most)
    return counts.crossJoin(F.broadcast(total)).select("check_name", "n", F.round(F.col("n") / F.greatest(F.col("t"), F.lit(1)), 6).alias("share"))


def graded(metrics: DataFrame, bars: DataFrame, checks: DataFrame) -> DataFrame:
    """(unit, n_bars, n_passed, passed): whether a unit's metrics (unit, metric, value) reach its bars (unit, metric,
    threshold, direction) and its checks (unit, ok) hold; a metric that isn't there fails."""
    both = bars.join(metrics, ["unit", "metric"], "left")
    good = F.when(F.col("direction") == "at_least", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    per = both.groupBy("unit").agg(F.count("*").alias("n_bars"), F.count_if(F.coalesce(good, F.lit(False))).alias("n_passed"))
    ok = F.coalesce(F.col("ok"), F.lit(False)) & (F.coalesce("n_bars", F.lit(0)) == F.coalesce("n_passed", F.lit(0)))
    return checks.join(per, "unit", "left").select("unit", F.coalesce("n_bars", F.lit(0)).alias("n_bars"), F.coalesce("n_passed", F.lit(0)).alias("n_passed"), ok.alias("passed"))


def heat(threads: DataFrame) -> DataFrame:
    """(thread, heat) of (thread, comments, humans, reactions)."""
    return threads.select("thread", (3 * F.col("comments") + 2 * F.col("humans") + F.col("reactions")).alias("heat"))


def unlocked(units: DataFrame, requires: DataFrame, done: DataFrame) -> DataFrame:
    """Units not done whose prerequisites (unit, needs) all are (unit)."""
    waiting = requires.join(done.select(F.col("unit").alias("needs")), "needs", "left_anti").select("unit").distinct()
    return units.select("unit").join(done.select("unit"), "unit", "left_anti").join(waiting, "unit", "left_anti")


def waves(units: DataFrame, requires: DataFrame) -> DataFrame:
    """(unit, wave): units whose prerequisites (unit, needs) all are in earlier waves, from 0.

    What is left when no unit is ready (cycles, what depends on them or on units that don't exist) forms the last
    wave. A round a wave; each keeps what remains only.
    """
    rest = kept(units.select("unit").distinct())
    edges = kept(requires.select("unit", "needs").distinct().join(rest, "unit", "left_semi"))
    done, wave = None, 0
    while True:
        ready = kept(rest.join(edges.select("unit").distinct(), "unit", "left_anti").withColumn("wave", F.lit(wave)))
        last = ready.isEmpty()
        ready = rest.withColumn("wave", F.lit(wave)) if last else ready
        done = ready if done is None else done.unionByName(ready)
        if last:
            return done
        # plans grow with each wave unless what is done is written now and then
        done = kept(done) if wave % 20 == 19 else done
        rest = kept(rest.join(ready, "unit", "left_anti"))
        edges = kept(edges.join(ready.select(F.col("unit").alias("needs")), "needs", "left_anti"))
        wave += 1


def cycles(requires: DataFrame) -> DataFrame:
    """(cycle, unit): the units that are their own prerequisites over some steps, by the least unit of those that are
    each other's.

    Units without prerequisites or dependants are trimmed until none is left; then the least unit is sent along
    the edges until nothing changes, and what leads back to it among those it reached is one component.
    """
    edges = kept(requires.select(F.col("unit").alias("a"), F.col("needs").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL").distinct())
    found = edges.filter("a = b").select(F.col("a").alias("cycle"), F.col("a").alias("unit"))
    edges = kept(edges.filter("a <> b"))
    while True:
        n = edges.count()
        while n:  # trimmed on both sides
            edges = kept(edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
            left = edges.count()
            if left == n:
                break
            n = left
        if not n:
            return found.groupBy("unit").agg(F.min("cycle").alias("cycle")).select("cycle", "unit")
        color = kept(edges.select(F.col("a").alias("unit")).distinct().withColumn("c", F.col("unit")))
        changed = True
        while changed:
            sent = edges.join(color, edges["a"] == color["unit"]).groupBy("b").agg(F.min("c").alias("s"))
            moved = kept(color.join(sent, color["unit"] == sent["b"], "left").select("unit", F.least("c", F.coalesce("s", "c")).alias("c"), (F.col("s") < F.col("c")).alias("moved")))
            changed = not moved.filter("moved").isEmpty()
            color = moved.select("unit", "c")
        inside = edges.join(color.select(F.col("unit").alias("a"), F.col("c").alias("ca")), "a").join(color.select(F.col("unit").alias("b"), F.col("c").alias("cb")), "b")
        inside = kept(inside.filter("ca = cb").select("a", "b", F.col("ca").alias("c")))
        back = kept(color.filter("unit = c").select("unit", "c"))
        while True:
            more = inside.join(back.select(F.col("unit").alias("b"), "c"), ["b", "c"]).select(F.col("a").alias("unit"), "c").distinct()
            more = kept(more.join(back, ["unit", "c"], "left_anti"))
            if more.isEmpty():
                break
            back = kept(back.unionByName(more))
        sizes = back.groupBy("c").agg(F.count("*").alias("n")).filter("n > 1")
        found = kept(found.unionByName(back.join(sizes, "c").select(F.col("c").alias("cycle"), "unit")))
        edges = kept(edges.join(back.select(F.col("unit").alias("a")), "a", "left_anti").join(back.select(F.col("unit").alias("b")), "b", "left_anti").select("a", "b"))
