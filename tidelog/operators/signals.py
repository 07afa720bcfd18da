"""Usage and corpus signals: what a search log and dated notes say about what matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.functions import text
from tidelog.sources.scratch import spread
from tidelog.sources.scratch import settled

C = F.col

#: Weights of the signal kinds in the union.
WEIGHTS = {"hit_frequency": 0.25, "gap": 0.20, "entity": 0.15, "staleness": 0.15, "wisdom_drift": 0.25, "supersession": 0.15}


def reference_date(notes: DataFrame) -> DataFrame:
    """One row: the latest day of the notes."""
    return notes.agg(F.max("mem_date").alias("as_of"))


def in_window(rows: DataFrame, when: str, as_of: Column, days: int = 30) -> DataFrame:
    """Rows of the last `days` days up to as_of, both ends included."""
    return rows.where((C(when) >= as_of - F.make_interval(days=F.lit(days))) & (C(when) <= as_of))


def hit_frequency(hits: DataFrame, least: float = 0.2) -> DataFrame:
    """uri, n_hits, n_queries, score: half for hits and half for different queries, against the largest."""
    counts = hits.groupBy("uri").agg(F.count("*").alias("n_hits"), F.countDistinct("query").alias("n_queries"))
    top = counts.agg(F.max("n_hits").alias("top_hits"), F.max("n_queries").alias("top_queries"))
    score = 0.5 * C("n_hits") / C("top_hits") + 0.5 * C("n_queries") / C("top_queries")
    return counts.crossJoin(F.broadcast(top)).select("uri", "n_hits", "n_queries", score.alias("score")).where(C("score") > least)


def gaps(log: DataFrame, below: float = 0.3, least: int = 2) -> DataFrame:
    """Queries of log(ts, query, scores) whose best results are poor: query, n, mean_best, last_asked, score."""
    best = log.select(F.lower(F.trim("query")).alias("query"), "ts", F.coalesce(F.array_max("scores"), F.lit(0.0)).alias("best"))
    grouped = best.groupBy("query").agg(F.count("*").alias("n"), F.avg("best").alias("mean_best"), F.max("ts").alias("last_asked"))
    poor = grouped.where((C("mean_best") < below) & (C("n") >= least))
    return poor.withColumn("score", F.least(F.lit(1.0), C("n") / 5) * (1 - C("mean_best")))


def recurring_entities(notes: DataFrame, covered: DataFrame, least_days: int = 3) -> DataFrame:
    """Entities of at least so many days that covered(entity) does not hold: entity, n_days, score."""
    each = spread(notes.select("mem_date", "text")).select("mem_date", F.explode(text.light_entities(C("text"))).alias("entity"))
    days = each.groupBy("entity").agg(F.countDistinct("mem_date").alias("n_days")).where(C("n_days") >= least_days)
    return days.join(covered, "entity", "left_anti").withColumn("score", F.least(F.lit(1.0), C("n_days") / (3.0 * least_days)))


def stale_items(items: DataFrame, as_of: Column, after: int = 90) -> DataFrame:
    """Items(uri, date, text) older than `after` days; the date is the item's or the first one in its text."""
    dated = items.withColumn("date", F.coalesce("date", F.try_to_date(F.regexp_extract("text", text.ascii_bounds(r"\b(\d{4}-\d{2}-\d{2})\b"), 1), "yyyy-MM-dd")))
    age = F.datediff(as_of, "date")
    return dated.where(age > after).select("uri", age.alias("days_old"), F.least(F.lit(1.0), age / (2.0 * after)).alias("score"))


def superseding_notes(notes: DataFrame, as_of: Column, window: int = 30) -> DataFrame:
    """Notes in the window that say that something changed: uri, n_markers, score."""
    recent = notes.where((C("mem_date") >= F.date_sub(as_of, window)) & (C("mem_date") <= as_of)).withColumn("n_markers", text.supersession_markers(C("text")))
    fade = F.greatest(F.lit(0.5), 1 - F.datediff(as_of, "mem_date") / (2.0 * window))
    return recent.where(C("n_markers") > 0).select("uri", "n_markers", (F.least(F.lit(1.0), C("n_markers") / 3) * fade).alias("score"))


def drifting_entries(entries: DataFrame, queries: DataFrame, log_rows: DataFrame, shared: int = 2, least_log: int = 10) -> DataFrame:
    """Entries(entry_id, text) that no query shares so many keywords with, when the log is long enough.

    Keywords of an entry count as often as they occur, those of a query once. An entry that one asked keyword
    is enough for meets that word only. When two are enough, any others share two words with one query, so the
    different pairs of an entry's asked words are looked up among the different pairs of all queries: rows are
    the pairs of each text, however many entries and queries have a word. For more, what is left of the entries
    meets the different sets of the queries' words, by its words without the commonest one."""
    held = entries.select("entry_id", F.explode(text.signal_keywords(C("text"))).alias("word")).groupBy("entry_id", "word").agg(F.count("*").alias("n"))
    asked = settled(queries.select("query").distinct().select(F.array_sort(F.array_distinct(text.signal_keywords(C("query")))).alias("words")).distinct())
    common = asked.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n_queries"))
    known = settled(held.join(common, "word").groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("n_queries", "word", "n"))).alias("x")))
    enough = known.where(F.exists("x", lambda r: r["n"] >= shared)).select("entry_id")
    others = known.where(~F.exists("x", lambda r: r["n"] >= shared))
    if shared == 2:
        pairs = lambda df, words, *more: df.select(*more, F.explode(words).alias("a"), words.alias("all")).select(*more, "a", F.filter("all", lambda w: w > C("a")).alias("later")).select(*more, "a", F.explode("later").alias("b"))
        met = pairs(others, F.transform("x", lambda r: r["word"]), "entry_id").join(pairs(asked, C("words")).distinct(), ["a", "b"], "left_semi")
    else:
        rare = F.slice("x", 1, F.size("x") - 1)
        each = others.where(F.size("x") > 1).select("entry_id", "x", F.explode(rare).alias("r")).select("entry_id", "x", C("r.word").alias("word"))
        both = each.join(asked.select("words", F.explode("words").alias("word")), "word")
        met = both.where(F.aggregate("x", F.lit(0).cast("long"), lambda t, r: t + F.when(F.array_contains("words", r["word"]), r["n"]).otherwise(0)) >= shared)
    matched = enough.unionByName(met.select("entry_id")).distinct()
    long_enough = log_rows.agg((F.count("*") > least_log).alias("enough"))
    return entries.join(matched, "entry_id", "left_anti").crossJoin(F.broadcast(long_enough)).where("enough").select("entry_id", F.lit(0.5).alias("score"))


def weighted_union(**kinds: DataFrame) -> DataFrame:
    """Candidates of all kinds, each kind(key, score): kind, key, score times the kind's weight."""
    parts = [df.select(F.lit(kind).alias("kind"), C("key"), (C("score") * WEIGHTS[kind]).alias("score")) for kind, df in kinds.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def session_budget(candidates: DataFrame, n: int = 20) -> DataFrame:
    """The n best candidates. A top-n keeps n rows a task, so no task sorts them all."""
    return candidates.orderBy(C("score").desc(), "kind", "key").limit(n)


def page_hits(log: DataFrame, pages: Column) -> DataFrame:
    """Hits of pages in log(ts, query, results, scores): uri, n_hits, best_score, last_hit, n_queries."""
    each = log.select("ts", "query", F.explode(F.arrays_zip("results", "scores")).alias("x")).select("ts", "query", C("x.results").alias("uri"), C("x.scores").alias("score"))
    return each.where(pages).groupBy("uri").agg(F.count("*").alias("n_hits"), F.max("score").alias("best_score"), F.max("ts").alias("last_hit"), F.countDistinct("query").alias("n_queries"))


def log_status(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("n_entries"), F.min("ts").alias("oldest"))


def temporal_gaps(notes: DataFrame, summaries: DataFrame, log: DataFrame, few: int = 3) -> DataFrame:
    """Weeks with notes but without a summary(week), with their number of searches; `quiet` when few."""
    weeks = notes.groupBy(F.trunc("mem_date", "week").alias("week")).agg(F.count("*").alias("n_notes"))
    searches = log.groupBy(F.trunc(C("ts").cast("date"), "week").alias("week")).agg(F.count("*").alias("n_searches"))
    n = F.coalesce("n_searches", F.lit(0))
    return weeks.join(summaries, "week", "left_anti").join(searches, "week", "left").select("week", "n_notes", n.alias("n_searches"), (n < few).alias("quiet"))


def carried_over(candidates: DataFrame, chosen: DataFrame) -> DataFrame:
    """Candidates that the budget leaves for the next session."""
    return candidates.join(chosen.select("kind", "key"), ["kind", "key"], "left_anti")


def page_quality(events: DataFrame) -> DataFrame:
    """events(slug, event) of pages that were hit and then followed, discarded or overridden: how often each,
    and followed - 0.5 discarded - 2 overridden, as shares of the hits, between -1 and 1."""
    count = lambda kind: F.sum((C("event") == kind).cast("int"))
    rows = events.groupBy("slug").agg(*(count(kind).alias(kind) for kind in ("hit", "followed", "discarded", "overridden"))).where("hit > 0")
    score = (C("followed") - 0.5 * C("discarded") - 2 * C("overridden")) / C("hit")
    return rows.withColumn("score", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score)))


def followed_hits(log: DataFrame) -> DataFrame:
    """log(session, seq, kind, uri, cited) with `followed` for page hits whose next call in the session reads
    a note that the page cites."""
    order = Window.partitionBy("session").orderBy("seq")
    after = F.when(F.lead("kind").over(order) == "read", F.lead("uri").over(order))
    return log.withColumn("followed", (C("kind") == "page") & F.coalesce(F.array_contains("cited", after), F.lit(False))).where("kind = 'page'")


#: Phrases by which an answer hedges, and values that it may state.
HEDGES = r"(?i)couldn't find|no record of|not surfaced|closest match|I checked memory and didn't"
STATED = r"\$\d[\d,.]*[KMB]?|\d+(?:\.\d+)?%|\d+(?:\.\d+)?x"


def answer_flags(answers: DataFrame) -> DataFrame:
    """answers(id, question, answer, trace: read uris) that need a second look: a value is stated and only
    pages were read; the question names a day whose note wasn't read; the answer hedges."""
    only_pages = (F.size("trace") > 0) & F.forall("trace", lambda u: u.startswith("memory/wiki/"))
    day = F.regexp_extract("question", r"(?i)(?:as of|on|recorded on) (\d{4}-\d{2}-\d{2})", 1)
    unread = (day != "") & ~F.array_contains("trace", F.concat(F.lit("memory/"), day, F.lit(".md")))
    flags = {"value without a note": C("answer").rlike(STATED) & only_pages, "pinned date not read": unread, "hedging": C("answer").rlike(HEDGES)}
    return answers.select("id", F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in flags.items()))).alias("flags"))


def uncovered_promotions(promotions: DataFrame, typed: DataFrame) -> DataFrame:
    """promotions(file, name, …) that no typed item(file, name) covers by its file or its name."""
    return promotions.join(typed.select("file").distinct(), "file", "left_anti").join(typed.select("name").distinct(), "name", "left_anti").select(*promotions.columns)


def session_totals(items: DataFrame, examined: DataFrame) -> DataFrame:
    """Diary line of each session: how many items(session, kind) of each kind, and candidates that were
    examined(session, examined) out of all."""
    kinds = ("insight", "promotion", "contradiction", "gap", "op")
    counts = items.groupBy("session").agg(*(F.sum((C("kind") == k).cast("int")).alias(f"n_{k}") for k in kinds))
    seen = examined.groupBy("session").agg(F.sum(C("examined").cast("int")).alias("n_examined"), F.count("*").alias("n_candidates"))
    joined = counts.join(seen, "session", "full_outer")
    return joined.fillna(0)


def candidate_context(candidates: DataFrame, notes: DataFrame, edges: DataFrame, parents: DataFrame) -> DataFrame:
    """What a model gets with each of candidates(candidate_id, uris): the notes(uri, mem_date, text), those of
    the days beside them, and the summaries parents(uri, text) that edges(parent, child) give them."""
    own = candidates.select("candidate_id", F.explode(F.array_distinct("uris")).alias("uri")).join(notes.select("uri", "mem_date"), "uri")
    days = own.select("candidate_id", F.explode(F.array(*(F.date_add("mem_date", k) for k in (-1, 0, 1)))).alias("mem_date")).distinct()
    texts = days.join(notes, "mem_date").select("candidate_id", F.lit(0).alias("part"), "uri", "text")
    above = own.join(edges.select(C("child").alias("uri"), "parent"), "uri").select("candidate_id", C("parent").alias("uri")).distinct().join(parents, "uri").select("candidate_id", F.lit(1).alias("part"), "uri", "text")
    rows = texts.unionByName(above).groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct("part", "uri", "text"))).alias("x"))
    return rows.select("candidate_id", F.size("x").alias("n_parts"), F.array_join(F.transform("x", lambda r: F.concat(F.lit("["), r["uri"], F.lit("]\n"), r["text"])), "\n\n").alias("context"))
