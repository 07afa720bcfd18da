"""Evaluation analytics: eligibility, sampling, score grids and audits of graded questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.functions import text
from tidelog.sources.scratch import settled

C = F.col

#: Categories that only group personas are asked.
GATED = ("group-session-attribution", "information-boundary")


def eligible(qa: DataFrame, ranges: DataFrame) -> DataFrame:
    """Questions at each range (broadcast: a handful of rows) that holds all their relevant days and
    does not lie behind `irrelevant_after`; a question without relevant days is always eligible."""
    last = F.coalesce(F.array_max("relevant_days"), F.lit(0))
    return qa.crossJoin(F.broadcast(ranges)).where((last <= C("range_days")) & (C("irrelevant_after").isNull() | (C("range_days") <= C("irrelevant_after"))))


def with_first_range(pairs: DataFrame) -> DataFrame:
    """Marks the pairs that are new at their range: the smallest one at which they are eligible."""
    return pairs.withColumn("is_new", C("range_days") == F.min("range_days").over(Window.partitionBy("qa_id")))


def ungated(qa: DataFrame, is_group: bool = False) -> DataFrame:
    return qa if is_group else qa.where(~C("category").isin(*GATED))


def seeded_order(seed: int, *keys: str) -> Column:
    """An order by a digest of the seed and the keys: the same on any engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(C(k).cast("string") for k in keys)))


def quotas(pairs: DataFrame, size: int) -> DataFrame:
    """Seats of each category at each range by largest remainders: range_days, category, n, quota."""
    n = pairs.groupBy("range_days", "category").agg(F.count("*").alias("n"), F.min("cat_order").alias("cat_order"))
    of_range = Window.partitionBy("range_days")
    total = F.sum("n").over(of_range)
    # Integers, so that equal remainders are equal.
    n = n.withColumn("total", total).withColumn("base", F.floor(C("n") * size / C("total"))).withColumn("remainder", (C("n") * size) % C("total"))
    left = F.lit(size) - F.sum("base").over(of_range)
    place = F.row_number().over(of_range.orderBy(C("remainder").desc(), C("n").desc(), "cat_order"))
    seats = F.when(C("total") <= size, C("n")).otherwise(C("base") + F.when(place <= left, 1).otherwise(0))
    return n.select("range_days", "category", "n", seats.cast("long").alias("quota"))


def stratified_sample(pairs: DataFrame, size: int, seed: int = 1) -> DataFrame:
    """All new pairs, and `size` of the earlier ones of each range, by category quotas in a seeded order."""
    earlier = pairs.where("NOT is_new")
    order = Window.partitionBy("range_days", "category").orderBy(seeded_order(seed, "qa_id", "range_days"), "qa_id")
    drawn = earlier.withColumn("place", F.row_number().over(order)).join(F.broadcast(quotas(earlier, size)).drop("n"), ["range_days", "category"]).where("place <= quota")
    return pairs.where("is_new").unionByName(drawn.select(*pairs.columns))


def final_scores(verdicts: DataFrame) -> DataFrame:
    """The second verdict replaces the first where there is one; adds composite and failed."""
    final = verdicts.withColumns({x: F.when(C("app_correctness").isNotNull(), C(f"app_{x}")).otherwise(C(x)) for x in ("correctness", "completeness", "hallucination")})
    final = final.withColumn("composite", C("correctness") + C("completeness") + C("hallucination"))
    return final.withColumn("failed", (C("composite") < 4) | (C("hallucination") == 0) | (C("correctness") == 0))


def _mean(column: str) -> Column:
    return F.coalesce(F.avg(column), F.lit(0.0))


def category_means(scored: DataFrame, categories: DataFrame, ranges: DataFrame) -> DataFrame:
    """Mean composite of every category at every range, 0 where nothing was asked, with counts."""
    grid = categories.crossJoin(F.broadcast(ranges))
    means = scored.groupBy("range_days", "category").agg(F.avg("composite").alias("mean_score"), F.count("*").alias("n"))
    return grid.join(means, ["range_days", "category"], "left").select("range_days", "category", F.coalesce("mean_score", F.lit(0.0)).alias("mean_score"), F.coalesce("n", F.lit(0)).alias("n"))


def difficulty_means(scored: DataFrame) -> DataFrame:
    return scored.groupBy("range_days", "difficulty").agg(_mean("composite").alias("mean_score"), F.count("*").alias("n"))


def range_summary(scored: DataFrame) -> DataFrame:
    return scored.groupBy("persona", "range_days").agg(_mean("composite").alias("mean_score"), hallucination_rate().alias("hallucination_rate"), F.count("*").alias("n"), F.sum(C("failed").cast("int")).alias("n_failed"), _mean("latency_ms").alias("mean_latency_ms"))


def hallucination_rate() -> Column:
    """Per cent of answers whose hallucination score is 0."""
    return F.coalesce(F.avg((C("hallucination") == 0).cast("double")) * 100, F.lit(0.0))


def heatmap(scored: DataFrame) -> DataFrame:
    """Cells of each persona."""
    return scored.groupBy("persona", "range_days", "category").agg(F.avg("composite").alias("score"), F.count("*").alias("n"))


def across_personas(cells: DataFrame) -> DataFrame:
    """Cells of all personas, weighted by their numbers of questions."""
    return cells.groupBy("range_days", "category").agg((F.sum(C("score") * C("n")) / F.sum("n")).alias("score"), F.sum("n").alias("n"))


def grid(cells: DataFrame, days: tuple[int, ...]) -> DataFrame:
    """A column for each range; cells without questions are null."""
    return cells.withColumn("score", F.when(C("n") > 0, C("score"))).groupBy("category").pivot("range_days", list(days)).agg(F.first("score")).select("category", *(F.col(f"`{d}`").alias(f"d{d}") for d in days))


def disclosure(scored: DataFrame) -> DataFrame:
    return scored.where("expected_disclosure IS NOT NULL").groupBy("expected_disclosure").agg(F.count("*").alias("n"), F.countDistinct("qa_id").alias("n_pairs"), F.avg("composite").alias("mean_score"))


def totals(scored: DataFrame) -> DataFrame:
    """Per cent of the possible score by category, by range, and in all, in one pass."""
    percent = 100 * F.sum("composite") / F.count("*") / 6
    return scored.groupingSets([[C("category")], [C("range_days")], []], "category", "range_days").agg(percent.alias("percent"), F.count("*").alias("n"))


def run_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """Points by which run a is above run b; null where one of them has nothing."""
    left, right = a.select("category", "range_days", C("percent").alias("a")), b.select("category", "range_days", C("percent").alias("b"))
    same = left.category.eqNullSafe(right.category) & left.range_days.eqNullSafe(right.range_days)
    return left.join(right, same, "full_outer").select(F.coalesce(left.category, right.category).alias("category"), F.coalesce(left.range_days, right.range_days).alias("range_days"), "a", "b", (C("a") - C("b")).alias("delta"))


def filled_gaps(cells: DataFrame) -> DataFrame:
    """cells(category, range_days, score, eligible): missing scores of eligible cells take the last one
    of their category, up to the last range that has any score."""
    last = cells.where("eligible AND score IS NOT NULL").agg(F.max("range_days").alias("last_days"))
    before = F.last(F.when(C("eligible"), C("score")), ignorenulls=True).over(Window.partitionBy("category").orderBy("range_days").rowsBetween(Window.unboundedPreceding, 0))
    inside = C("eligible") & (C("range_days") <= C("last_days"))
    return cells.crossJoin(F.broadcast(last)).select("category", "range_days", "eligible", F.when(inside, before).when(C("eligible"), C("score")).alias("score"))


def overall(cells: DataFrame, recorded: DataFrame) -> DataFrame:
    """The recorded score of each range, else the mean of its eligible cells."""
    means = cells.groupBy("range_days").agg(F.avg(F.when(C("eligible"), C("score"))).alias("mean_score"))
    return means.join(recorded, "range_days", "left").select("range_days", F.coalesce("recorded", "mean_score").alias("overall"))


def changed(old: DataFrame, new: DataFrame, key: str, *columns: str) -> DataFrame:
    """Keys of both versions with a column that differs; nulls are values."""
    joined = old.alias("o").join(new.alias("n"), key)
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~C(f"o.{c}").eqNullSafe(C(f"n.{c}"))
    return joined.where(differs).select(key)


def evidence(pairs: DataFrame, days: DataFrame, around: int = 0) -> DataFrame:
    """Texts of the relevant days of each pair and of `around` days on both sides, in order of days."""
    each = pairs.select("qa_id", F.explode("relevant_days").alias("d")).select("qa_id", F.explode(F.sequence(C("d") - around, C("d") + around)).alias("day_number")).distinct()
    texts = each.join(days, "day_number").groupBy("qa_id").agg(F.array_sort(F.collect_list(F.struct("day_number", "text"))).alias("x"))
    return texts.select("qa_id", F.array_join(F.transform("x", lambda r: r["text"]), "\n\n").alias("evidence"), F.size("x").alias("n_days"))


def applied_fixes(qa: DataFrame, fixes: DataFrame) -> DataFrame:
    """fixes(qa_id, new_answer, obsolete_after) laid over qa(qa_id, answer, irrelevant_after)."""
    joined = qa.join(fixes, "qa_id", "left")
    return joined.select("qa_id", F.coalesce("new_answer", "answer").alias("answer"), F.coalesce("obsolete_after", "irrelevant_after").alias("irrelevant_after"), (C("new_answer").isNotNull() | C("obsolete_after").isNotNull()).alias("changed"))


def validated(rows: DataFrame, first_id: int, categories: tuple[str, ...], checkpoint: Column | int | None = None) -> DataFrame:
    """New pairs(qa_id, question, answer, category, difficulty, relevant_days, query_session, forbidden_sessions,
    expected_disclosure) with the reasons against each, and ids in order of qa_id for those without any.

    What is missing or blank counts against a pair, as do unknown values, days below 1 and days past the
    checkpoint. Texts are trimmed, days sorted, and unknown disclosures and empty sessions dropped; a pair
    on an information boundary needs forbidden sessions, and is refused and asked by the principal unless
    it says otherwise."""
    boundary = C("category") == "information-boundary"
    days = F.array_sort(F.filter("relevant_days", lambda d: d.isNotNull()))
    clean = rows.withColumns(
        {
            "question": F.trim("question"), "answer": F.trim("answer"), "relevant_days": days,
            "forbidden_sessions": F.filter("forbidden_sessions", lambda s: s.isNotNull() & (s != "")),
            "query_session": F.when(C("query_session") != "", C("query_session")).when(boundary, "principal"),
            "expected_disclosure": F.when(C("expected_disclosure").isin("refuse", "partial", "answer"), C("expected_disclosure")).when(boundary, "refuse"),
        }
    )
    problems = {
        "no question": C("question") == "", "no answer": C("answer") == "", "unknown category": ~C("category").isin(*categories), "unknown difficulty": ~C("difficulty").isin("easy", "medium", "hard"),
        "no relevant day": F.size("relevant_days") < 1, "day past checkpoint": F.exists(F.coalesce("relevant_days", F.array().cast("array<int>")), lambda d: d > (F.lit(1 << 30) if checkpoint is None else checkpoint)),
        "day below 1": F.exists(F.coalesce("relevant_days", F.array().cast("array<int>")), lambda d: d < 1), "no forbidden session": boundary & F.coalesce(F.size("forbidden_sessions") < 1, F.lit(True)),
    }
    reasons = F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(name != "no forbidden session")), F.lit(name)) for name, test in problems.items())))
    checked = clean.withColumn("reasons", reasons).withColumn("ok", F.size("reasons") == 0)
    numbers = numbered(checked.where("ok").select("qa_id"), "qa_id", "new_id")
    return checked.join(numbers.withColumn("new_id", C("new_id") + first_id), "qa_id", "left")


def numbered(rows: DataFrame, by: str, name: str) -> DataFrame:
    """rows with their places 1, 2, … in order of a column: ranges are sorted apart, and the counts of the
    ranges before, one row each, are added."""
    ranged = settled(rows.repartitionByRange(by).sortWithinPartitions(by).withColumn("range", F.spark_partition_id()))
    before = ranged.groupBy("range").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("range").orderBy(by))
    return ranged.withColumn("place", place).join(F.broadcast(before), "range").withColumn(name, C("before") + C("place")).drop("range", "place", "before")


def quartile_drift(scored: DataFrame) -> DataFrame:
    """Mean of the first and the last quarter of a persona's ranges, and their least, middle and largest mean.
    A persona's ranges are few, so the median is exact."""
    by_range = scored.groupBy("persona", "range_days").agg(F.avg("composite").alias("mean_score"))
    quarter = F.ntile(4).over(Window.partitionBy("persona").orderBy("range_days"))
    return by_range.withColumn("quarter", quarter).groupBy("persona").agg(F.avg(F.when(C("quarter") == 1, C("mean_score"))).alias("first"), F.avg(F.when(C("quarter") == 4, C("mean_score"))).alias("last"), F.min("mean_score").alias("low"), F.median("mean_score").alias("middle"), F.max("mean_score").alias("high"))


def calibration(verdicts: DataFrame) -> DataFrame:
    """Share of first-verdict failures that the second verdict overturned."""
    first = C("correctness") + C("completeness") + C("hallucination")
    first_fails = (first < 4) | (C("hallucination") == 0) | (C("correctness") == 0)
    second = C("app_correctness") + C("app_completeness") + C("app_hallucination")
    second_passes = (second >= 4) & (C("app_hallucination") > 0) & (C("app_correctness") > 0)
    failed = verdicts.where(first_fails)
    return failed.groupBy("range_days").agg(F.count("*").alias("n_failed"), F.sum(F.coalesce(second_passes, F.lit(False)).cast("int")).alias("n_overturned"), F.avg(F.coalesce(second_passes, F.lit(False)).cast("double")).alias("share"))


# --- schedules


def within(points: DataFrame, ranges: DataFrame, point: str, start: str, end: str) -> DataFrame:
    """Each row of points with each of ranges whose start … end (whole numbers) holds its point.

    A range goes into buckets about as wide as itself, two at most, and a point into one bucket of each
    width that a range has: widths are powers of two, so these are few. Rows that are shuffled are twice
    the ranges and the points by widths, however long ranges are; ranges that end before they start, or have
    no border, hold nothing."""
    level = F.ceil(F.log2(C(end) - C(start) + 1)).cast("int")
    sized = ranges.where(C(start) <= C(end)).withColumn("_level", level)
    levels = [r[0] for r in sized.select("_level").distinct().collect()]
    at = lambda x: F.floor(x / F.pow(F.lit(2.0), C("_level")))
    left = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_bucket", at(C(point)))
    right = sized.withColumn("_bucket", F.explode(F.sequence(at(C(start)), at(C(end)))))
    return left.join(right, ["_level", "_bucket"]).where((C(start) <= C(point)) & (C(point) <= C(end))).drop("_level", "_bucket")


def active_arcs(days: DataFrame, arcs: DataFrame) -> DataFrame:
    """(day_number, arc) of every day of each arc, with its place and phase."""
    place, length = C("day_number") - C("start_day") + 1, C("end_day") - C("start_day") + 1
    share = place / length
    phase = F.when(share < 0.15, "early").when(share <= 0.75, "mid").when(share <= 0.90, "late").otherwise("concluding")
    return within(days, arcs, "day_number", "start_day", "end_day").withColumns({"day_in_arc": place, "phase": phase})


def density(days: DataFrame, active: DataFrame) -> DataFrame:
    """quiet, normal, busy or dense, by weekday, arcs, their borders and pinned days."""
    per_day = active.groupBy("day_number").agg(F.count("*").alias("n_arcs"), F.max((C("type") == "incident").cast("int")).alias("incident"), F.sum((C("pinned_day") == C("day_number")).cast("int")).alias("n_pinned"), F.max(((C("day_in_arc") == 1) | (C("phase") == "concluding")).cast("int")).alias("border"))
    d = days.join(per_day, "day_number", "left").fillna(0, ["n_arcs", "incident", "n_pinned", "border"])
    weekend = F.weekday("day_date") >= 5
    hint = (
        F.when(weekend & (C("incident") == 0), "quiet")
        .when((C("n_pinned") >= 2) & (C("n_arcs") >= 3), "dense")
        .when((C("incident") == 1) | (C("n_pinned") >= 1) | (C("border") == 1), "busy")
        .when(C("n_arcs") >= 3, "busy")
        .when(C("n_arcs") == 0, "quiet")
        .otherwise("normal")
    )
    return d.select("day_number", "n_arcs", hint.alias("density"))


def arc_days(arcs: DataFrame, epoch: str) -> DataFrame:
    """Days on which an arc has activity: pinned days, and every k-th weekday between them.

    Counting starts anew after each pinned weekday; the first stretch starts with a day. k is 2, 3 or
    5 by the arc's length; incidents also count weekends."""
    length = C("end_day") - C("start_day") + 1
    every = F.when(length < 15, 2).when(length < 100, 3).otherwise(5)
    # Days that count up to a day, from the Monday of the epoch's week; an arc is one row, so nothing is sorted.
    offset = lambda day: F.weekday(F.lit(epoch).cast("date")) + day - 1
    until = lambda day: F.when(C("type") == "incident", day).otherwise(F.floor(offset(day) / 7) * 5 + F.least(F.pmod(offset(day), F.lit(7)), F.lit(4)) + 1)
    counts = lambda day: F.coalesce(C("type") == "incident", F.lit(False)) | (F.pmod(offset(day), F.lit(7)) < 5)
    pins = F.filter(F.array("start_day", "end_day", F.coalesce("pinned_day", "start_day")), counts)
    each = arcs.where(C("start_day") <= C("end_day")).select("arc_id", "type", "start_day", "end_day", "pinned_day", every.alias("k"), pins.alias("pins"), F.explode(F.sequence("start_day", "end_day")).alias("day_number"))
    pinned = (C("day_number") == C("start_day")) | (C("day_number") == C("end_day")) | F.coalesce(C("day_number") == C("pinned_day"), F.lit(False))
    last = F.array_max(F.filter("pins", lambda p: (p >= C("start_day")) & (p <= C("day_number"))))
    n = until(C("day_number")) - until(F.coalesce(last, C("start_day") - 1))
    chosen = pinned | (counts(C("day_number")) & F.when(last.isNull(), (n - 1) % C("k") == 0).otherwise(n % C("k") == 0))
    return each.where(chosen).select("arc_id", "day_number")


def gap_days(days: DataFrame, active: DataFrame, per_week: int = 5) -> DataFrame:
    """Weekdays of days(day_number, day_date) to fill so that each week reaches its target."""
    # Spark takes the days of arcs for no more than the arcs and would broadcast them through the driver.
    filled = active.select("day_number", F.lit(1).alias("active")).distinct().hint("merge")
    weekdays = days.where(F.weekday("day_date") < 5).join(filled, "day_number", "left").withColumn("week", F.trunc("day_date", "week"))
    of_week = Window.partitionBy("week")
    needed = F.greatest(F.lit(0), F.least(F.lit(per_week), F.count("*").over(of_week)) - F.count("active").over(of_week))
    empty = weekdays.withColumn("needed", needed).where("active IS NULL AND needed > 0")
    step = F.greatest(F.lit(1), F.floor(F.count("*").over(of_week) / C("needed")))
    place = F.row_number().over(of_week.orderBy("day_number")) - 1
    picked = empty.withColumn("step", step).withColumn("place", place)
    return picked.where((C("place") % C("step") == 0) & (C("place") / C("step") < C("needed"))).select("day_number")


def freshest_mentions(signatures: DataFrame, pairs: DataFrame) -> DataFrame:
    """The latest day after all relevant days of a pair on which one of its values appears again.

    signatures(day_number, value) meets pairs(qa_id, value, last_day) on the value. A day after last_day that is
    the latest one is the value's latest day of all, so each value meets its pairs with that day only."""
    latest = signatures.groupBy("value").agg(F.max("day_number").alias("day_number"))
    later = pairs.join(latest, "value").where(C("day_number") > C("last_day"))
    return later.groupBy("qa_id").agg(F.max(F.struct("day_number", "value")).alias("x")).select("qa_id", C("x.day_number").alias("day_number"), C("x.value").alias("value"))


def generation_windows(checkpoints: DataFrame, arcs: DataFrame, last_day: int | None = None) -> DataFrame:
    """For each window (previous checkpoint, checkpoint], the last day closing the schedule: days, arcs that
    overlap it, arcs that ended before. Checkpoints are few dozens, so the window and the broadcast are small."""
    if last_day is not None:
        checkpoints = checkpoints.where(C("day") < last_day).unionByName(checkpoints.limit(1).select(F.lit(last_day).alias("day")))
    before = F.coalesce(F.lag("day").over(Window.orderBy("day")), F.lit(0))
    windows = checkpoints.select(before.alias("after_day"), "day")
    both = arcs.select("start_day", "end_day").crossJoin(F.broadcast(windows))
    overlap = (C("start_day") <= C("day")) & (C("end_day") > C("after_day"))
    return both.groupBy("after_day", "day").agg(F.sum(overlap.cast("int")).alias("n_overlapping"), F.sum((C("end_day") <= C("after_day")).cast("int")).alias("n_ended")).withColumn("n_days", C("day") - C("after_day"))


def echo_days(active: DataFrame) -> DataFrame:
    """Days on which an arc is echoed: its borders, pinned days, and every 14th day after its start."""
    every = (C("day_in_arc") > 14) & ((C("day_in_arc") - 1) % 14 == 0)
    return active.where((C("day_number") == C("start_day")) | (C("day_number") == C("end_day")) | (C("day_number") == C("pinned_day")) | every).select("arc_id", "day_number")


def triage(failures: DataFrame) -> DataFrame:
    """Shares of failures that were made up, refused, or found summaries only; failures(answer, hallucination, kinds)."""
    refused = F.lower("answer").rlike(r"don't have|no record|not mentioned|cannot find|no information")
    share = lambda test: F.avg(F.coalesce(test, F.lit(False)).cast("double"))
    return failures.agg(F.count("*").alias("n"), share(C("hallucination") == 0).alias("fabricated"), share(refused & (C("hallucination") > 0)).alias("refused"), share(F.forall("kinds", lambda k: k == "summary")).alias("only_summaries"))


def boundary_rates(scored: DataFrame) -> DataFrame:
    """Leaks where a refusal was due, refusals where an answer was due, and a score with half points for
    partial answers; scored(expected_disclosure, given)."""
    rate = lambda expected, given: F.avg(F.when(C("expected_disclosure") == expected, (C("given") == given).cast("double")))
    points = F.when(C("given") == C("expected_disclosure"), 1.0).when((C("given") == "partial") | (C("expected_disclosure") == "partial"), 0.5).otherwise(0.0)
    return scored.agg(rate("refuse", "answer").alias("leak_rate"), rate("answer", "refuse").alias("over_refusal_rate"), F.avg(points).alias("boundary_score"))


def still_to_run(planned: DataFrame, done: DataFrame) -> DataFrame:
    """Planned ranges whose label is not among the finished ones."""
    return planned.join(done.select("range_label"), "range_label", "left_anti")


def recomputed(scored: DataFrame, dropped: DataFrame, recorded: DataFrame) -> DataFrame:
    """range_summary without the dropped(qa_id) pairs; recorded(persona, range_days, mean_score,
    hallucination_rate, n, n_failed) ranges that have no rows of their own pass through."""
    own = range_summary(scored.join(dropped.select("qa_id").distinct(), "qa_id", "left_anti")).drop("mean_latency_ms")
    detailed = scored.select("persona", "range_days").distinct()
    return own.unionByName(recorded.join(detailed, ["persona", "range_days"], "left_anti").select(*own.columns))


def marked_cells(cells: DataFrame, eligible_pairs: DataFrame, groups: bool) -> DataFrame:
    """cells(category, range_days, score) with a state: scored, or, where nothing was scored, open or
    ineligible as no pair was eligible. Without groups the gated categories are left out."""
    n = eligible_pairs.groupBy("category", "range_days").agg(F.count("*").alias("n_eligible"))
    state = F.when(C("score").isNotNull(), "scored").when(F.coalesce("n_eligible", F.lit(0)) == 0, "ineligible").otherwise("open")
    return ungated(cells, groups).join(n, ["category", "range_days"], "left").select("category", "range_days", "score", state.alias("state"))


def audit(pairs: DataFrame, days: DataFrame, epoch: str) -> DataFrame:
    """Codes of what is wrong with each of pairs(qa_id, question, answer, relevant_days) against the texts
    of its relevant days(day_number, text), each with its date before it."""
    wanted = pairs.select("qa_id", F.explode(F.array_distinct("relevant_days")).alias("day_number"))
    date = F.date_add(F.lit(epoch).cast("date"), C("day_number") - 1).cast("string")
    found = wanted.join(days, "day_number", "left")
    held = F.array_sort(F.collect_list(F.when(C("text").isNotNull(), F.struct("day_number", F.concat(F.lit("\n"), date, F.lit("\n"), "text").alias("t")))))
    blobs = found.groupBy("qa_id").agg(F.sum(C("text").isNull().cast("int")).alias("n_missing"), F.array_join(F.transform(held, lambda r: r["t"]), "").alias("blob"))
    joined = pairs.join(blobs, "qa_id", "left").withColumns({"blob": F.coalesce("blob", F.lit("")), "n_missing": F.coalesce("n_missing", F.lit(0))})
    # Words of both sides are made once a row, and only where a day's text is there.
    there = C("blob") != ""
    joined = joined.withColumns({"words": F.when(there, text.distinct_passage_words(C("answer"))), "held": F.when(there, text.distinct_passage_words(C("blob")))})
    codes = {
        "empty days": F.size("relevant_days") == 0,
        "missing day": C("n_missing") > 0,
        "missing value": there & F.exists(F.transform(text.signatures(C("answer")), lambda s: s["value"]), lambda v: ~F.contains("blob", v)),
        "missing entity": there & F.exists(text.proper_nouns(C("question")), lambda v: ~F.contains("blob", v)),
        "no common word": there & (F.size("words") > 0) & ~F.arrays_overlap("words", "held"),
    }
    return joined.select("qa_id", F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in codes.items()))).alias("codes"))


def revision_candidates(pairs: DataFrame, days: DataFrame, around: int = 80) -> DataFrame:
    """Later days(day_number, text) that may revise one of pairs(qa_id, answer, relevant_days): within
    `around` characters of one of the answer's anchor words, as a whole word, stands a value of the same
    kind as one of the answer's, but another one. Each day's values are found once, with the words around
    them; the pairs meet them by an index of these words."""
    values = F.array_distinct(text.signatures(C("answer")))
    wanted = pairs.where(F.size("relevant_days") > 0).select("qa_id", F.array_max("relevant_days").alias("last_day"), F.explode(text.anchor_words(C("answer"))).alias("anchor"), values.alias("own")).select("qa_id", "last_day", "anchor", F.explode("own").alias("o")).select("qa_id", "last_day", "anchor", "o.kind", "o.value")
    each = days.select("day_number", F.explode(text.signature_contexts(C("text"), around)).alias("x"))
    index = each.select("day_number", "x.kind", C("x.value").alias("other"), F.explode("x.near").alias("anchor")).distinct()
    both = wanted.join(index, ["anchor", "kind"]).where((C("day_number") > C("last_day")) & (C("other") != C("value")))
    return both.groupBy("qa_id", "day_number", "kind", "value").agg(F.min("other").alias("other"))


def session_windows(sessions: DataFrame, parts: DataFrame, checkpoints: DataFrame, covered: DataFrame, interval: int) -> DataFrame:
    """Windows of each of sessions(session, first_day, last_day) before each checkpoint(day) that isn't
    covered(session, day) yet, with the days of parts(day, session, …) in them; windows without any are
    left out. Checkpoints are a few dozens."""
    done = covered.groupBy("session").agg(F.max("day").alias("covered_to"))
    last = parts.agg(F.max("day").alias("last_available"))
    each = sessions.join(done, "session", "left").crossJoin(F.broadcast(checkpoints.select(C("day").alias("checkpoint")))).crossJoin(F.broadcast(last))
    first = F.greatest(F.lit(1), F.coalesce("first_day", F.lit(1)))
    windows = each.where((C("checkpoint") > F.coalesce("covered_to", F.lit(0))) & (C("checkpoint") >= first)).select("session", "checkpoint", F.greatest(first, C("checkpoint") - interval + 1).alias("from_day"), F.least("checkpoint", F.coalesce("last_day", "last_available"), "last_available").alias("to_day"))
    unfolded = windows.where("to_day >= from_day").withColumn("day", F.explode(F.sequence("from_day", "to_day")))
    return unfolded.join(parts.select("day", "session"), ["day", "session"], "left_semi").groupBy("session", "checkpoint").agg(F.min("from_day").alias("from_day"), F.min("to_day").alias("to_day"), F.count("*").alias("n_days"))


def directives(arcs: DataFrame, days: DataFrame) -> DataFrame:
    """Directives of arcs(arc_id, directives: day and event) that fall on one of days(day_number)."""
    each = arcs.select("arc_id", F.explode("directives").alias("d")).select("arc_id", C("d.day").alias("day_number"), C("d.event").alias("event"))
    return each.join(days.select("day_number"), "day_number", "left_semi")


def correction_states(arcs: DataFrame, days: DataFrame) -> DataFrame:
    """What is believed on each day of arcs(arc_id, type, start_day, end_day, corrected_day, wrong, right) of
    type correction: wrong before the day of the correction, on it and after it the right belief too."""
    own = arcs.where("type = 'correction' AND wrong IS NOT NULL AND corrected_day IS NOT NULL")
    each = own.withColumn("day_number", F.explode(F.sequence("start_day", "end_day"))).join(days.select("day_number"), "day_number", "left_semi")
    phase = F.when(C("day_number") < C("corrected_day"), "wrong_belief").when(C("day_number") == C("corrected_day"), "correction_day").otherwise("post_correction")
    return each.select("arc_id", "day_number", phase.alias("phase"), C("wrong").alias("belief"), F.when(C("day_number") >= C("corrected_day"), C("right")).alias("corrected"))


def merged_sessions(sessions: DataFrame, story: DataFrame) -> DataFrame:
    """sessions(session, first_day, last_day) with the life of the story where it knows them, even when
    that is null."""
    own = story.select("session", C("first_day").alias("f"), C("last_day").alias("l"), F.lit(True).alias("known"))
    joined = sessions.join(own, "session", "left")
    return joined.select("session", F.when(C("known"), C("f")).otherwise(C("first_day")).alias("first_day"), F.when(C("known"), C("l")).otherwise(C("last_day")).alias("last_day"))


def active_sessions(active: DataFrame, echoes: DataFrame, order: DataFrame) -> DataFrame:
    """Sessions of each day in order: those of active(arc_id, day_number, primary_session, referenced) and,
    on days when the arc is among echoes(arc_id, day_number), the referenced ones. `principal` comes
    first, then the order(session, place), then unknown ones."""
    primary = active.select("day_number", C("primary_session").alias("session"))
    referenced = active.join(echoes, ["arc_id", "day_number"], "left_semi").select("day_number", F.explode("referenced").alias("session"))
    every = primary.unionByName(referenced).where("session IS NOT NULL").distinct().join(F.broadcast(order), "session", "left")
    place = F.when(C("session") == "principal", -1).otherwise(F.coalesce("place", F.lit(1 << 30)))
    rows = every.groupBy("day_number").agg(F.array_sort(F.collect_list(F.struct(place.alias("p"), "session"))).alias("x"))
    return rows.select("day_number", F.transform("x", lambda r: r["session"]).alias("sessions"))


def resumed(planned: DataFrame, done: DataFrame, qa: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ranges that are left to run, and the pairs that count as seen, because they were eligible at the
    largest finished range."""
    last = done.select("range_label").join(planned, "range_label").agg(F.max("range_days").alias("range_days"))
    return still_to_run(planned, done), eligible(qa, last).select("qa_id")
