"""Temporal roll-up: days to weeks to months, salience weights, parent vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.functions import dates, text
from tidelog.sources.scratch import spread
from tidelog.sources import memory

C = F.col

#: Shares of length, entities and decisions in a salience weight.
TOKEN_WEIGHT, ENTITY_WEIGHT, DECISION_WEIGHT = 0.4, 0.3, 0.3


def weekly_work(notes: DataFrame, summaries: DataFrame, as_of: Column, least: int = 3) -> DataFrame:
    """Closed ISO weeks with at least so many days and without a summary(period)."""
    weeks = notes.groupBy(dates.iso_week(C("mem_date")).alias("period")).agg(F.count("*").alias("n_days"), F.max(dates.week_thursday(C("mem_date"))).alias("thursday"))
    closed = weeks.where((C("n_days") >= least) & (F.date_add("thursday", 3) < as_of))
    return closed.join(summaries, "period", "left_anti").select("period", "n_days")


def monthly_work(weeks: DataFrame, summaries: DataFrame, least: int = 2) -> DataFrame:
    """Months, by the Thursdays of weeks(week_start), with enough weeks and without a summary(period)."""
    months = weeks.groupBy(dates.week_month(C("week_start")).alias("period")).agg(F.count("*").alias("n_weeks")).where(C("n_weeks") >= least)
    return months.join(summaries, "period", "left_anti")


def combined_text(notes: DataFrame, parent: Column, separator: str = "\n\n---\n\n") -> DataFrame:
    """The texts of each parent's days in order, joined. A parent is a week or a month: a bounded group."""
    each = notes.groupBy(parent.alias("parent")).agg(F.array_sort(F.collect_list(F.struct("mem_date", "text"))).alias("x"))
    return each.select("parent", F.array_join(F.transform("x", lambda r: r["text"]), separator).alias("text"), F.size("x").alias("n_days"))


def salience(notes: DataFrame, parent: Column) -> DataFrame:
    """Weights of each parent's children, which sum to 1: parent, uri, weight."""
    counted = spread(notes.select(parent.alias("parent"), "uri", "text")).select("parent", "uri", text.token_estimate(C("text")).alias("tokens"), F.size(text.entities(C("text"))).alias("entities"), text.decision_markers(C("text")).alias("decisions"))
    of_parent = Window.partitionBy("parent")

    def share(column: str) -> Column:
        return C(column) / F.greatest(F.max(column).over(of_parent), F.lit(1))

    raw = counted.withColumn("raw", TOKEN_WEIGHT * share("tokens") + ENTITY_WEIGHT * share("entities") + DECISION_WEIGHT * share("decisions"))
    total, n = F.sum("raw").over(of_parent), F.count("*").over(of_parent)
    return raw.select("parent", "uri", F.when(n == 1, 1.0).when(total > 0, C("raw") / total).otherwise(1 / n).alias("weight"))


def uniform(children: DataFrame, parent: str) -> DataFrame:
    return children.withColumn("weight", F.round(1 / F.count("*").over(Window.partitionBy(parent)), 2))


def weighted_vectors(children: DataFrame, parent: str, vector: str = "embedding", weight: str = "weight") -> DataFrame:
    """L2-normalised weighted mean of the child vectors of each parent: parent, vector, n_children.

    Sums by position are partial sums first, so a parent with very many children does no harm."""
    each = children.select(C(parent).alias("parent"), C(weight).alias("w"), F.posexplode(vector).alias("i", "x"))
    sums = each.groupBy("parent", "i").agg(F.sum(C("w") * C("x").cast("double")).alias("s"), F.count("*").alias("n"))
    rows = sums.groupBy("parent").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("v"), F.max("n").alias("n_children"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, r: t + r["s"] * r["s"]))
    return rows.withColumn("norm", norm).select("parent", F.transform("v", lambda r: F.when(C("norm") > 0, r["s"] / C("norm")).otherwise(0.0)).alias("vector"), "n_children")


def own_or_aggregate(children: DataFrame, aggregates: DataFrame, vectors: DataFrame) -> DataFrame:
    """The `#agg` vector of each child, else its own; children without any are left out."""
    joined = children.join(aggregates.select(C("uri"), C("vector").alias("a")), "uri", "left").join(vectors.select("uri", C("vector").alias("o")), "uri", "left")
    return joined.withColumn("vector", F.coalesce("a", "o")).drop("a", "o").where("vector IS NOT NULL")


def expected_pointers(weeks: DataFrame, notes: DataFrame) -> DataFrame:
    """The seven days of each week(week_start): parent, child uri, whether the note is there."""
    each = weeks.select(dates.iso_week(C("week_start")).alias("parent"), F.explode(F.sequence("week_start", F.date_add("week_start", 6))).alias("mem_date"))
    held = notes.select("mem_date", F.lit(True).alias("present")).distinct()
    return each.join(held, "mem_date", "left").select("parent", F.concat(F.lit("memory/"), C("mem_date").cast("string"), F.lit(".md")).alias("uri"), F.coalesce("present", F.lit(False)).alias("present"))


def expected_weeks(months: DataFrame, weeks: DataFrame) -> DataFrame:
    """The weeks whose Thursday lies in each month(month: its first day): parent, week, whether weeks(week_start)
    has it."""
    last = F.last_day("month")
    each = months.select(F.date_format("month", "yyyy-MM").alias("parent"), F.explode(F.sequence(F.trunc("month", "week"), F.trunc(last, "week"), F.expr("INTERVAL 7 DAYS"))).alias("week_start"))
    own = each.where(dates.week_month(C("week_start")) == C("parent"))
    held = weeks.select("week_start", F.lit(True).alias("present")).distinct()
    return own.join(held, "week_start", "left").select("parent", dates.iso_week(C("week_start")).alias("week"), F.coalesce("present", F.lit(False)).alias("present"))


def parent_rows(parents: DataFrame, vectors: DataFrame, kind: str) -> DataFrame:
    """Two index rows for each of parents(parent, text, vector): its summary under its own vector, and the
    aggregate of its children from vectors(parent, vector, n_children), where there is one."""
    meta = [F.lit(kind).alias("content_type"), C("parent").alias("period")]
    summary = parents.select(F.concat("parent", F.lit("#summary")).alias("uri"), *meta, F.lit("summary").alias("embedding_type"), C("text"), "vector")
    aggregate = parents.select("parent").join(vectors, "parent").select(F.concat("parent", F.lit("#agg")).alias("uri"), *meta, F.lit("agg").alias("embedding_type"), F.lit("").alias("text"), "vector")
    return summary.unionByName(aggregate)


def typed_memories(output: DataFrame, kinds: tuple[str, ...] = ("user", "feedback", "project", "reference")) -> tuple[DataFrame, DataFrame]:
    """Typed notes of model output(id, text), a JSON list of file and content: id, file, name, kind, body.
    Notes whose head names no kind that is known, even after plain values are quoted, are given apart."""
    each = output.select("id", F.explode(F.from_json("text", "array<struct<file: string, content: string>>")).alias("m")).select("id", "m.file", "m.content")
    front = memory.front_matter(C("content"))
    read = each.select("id", "file", front["name"].alias("name"), front["type"].alias("kind"), F.trim(memory.body(C("content"))).alias("body"))
    good = F.coalesce(C("kind").isin(*kinds) & (C("name") != "") & C("file").rlike(r"^[^/]+\.md$"), F.lit(False))
    return read.where(good), read.where(~good)


def wisdom_input(typed: DataFrame, pages: DataFrame, months: DataFrame) -> DataFrame:
    """What wisdom is distilled from, in order: typed notes, pages that are no redirects, the latest month."""
    latest = months.orderBy(C("period").desc()).limit(1)
    parts = [typed.select(F.lit("typed").alias("part"), C("slug").alias("name"), "text"), pages.where("redirect_to IS NULL").select(F.lit("wiki").alias("part"), C("slug").alias("name"), C("body").alias("text")), latest.select(F.lit("month").alias("part"), C("period").alias("name"), "text")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def counts_by_type(notes: DataFrame) -> DataFrame:
    return notes.groupBy("content_type").agg(F.count("*").alias("n"))


def patched(entries: DataFrame, patches: DataFrame, most: int = 20, budget: int = 4000, by: str | None = None) -> DataFrame:
    """entries(title, body, ord) after patches(title, op, body): removed, updated or added, then cut to
    `most` entries and `budget` characters in order. A patch keep_all leaves the entries as they are, whatever
    else is asked. With `by`, a column of both, there is one list for each of its values."""
    key = by or "_list"
    if by is None:
        entries, patches = (x.withColumn(key, F.lit(0)) for x in (entries, patches))
    kept = patches.where("op = 'keep_all'").select(key).distinct()
    asked = patches.where("op <> 'keep_all'").join(kept, key, "left_anti").select(key, "title", "op", C("body").alias("new_body"))
    joined = entries.join(asked, [key, "title"], "full_outer").where("op IS NULL OR op <> 'remove'")
    joined = joined.select(key, "title", F.coalesce("new_body", "body").alias("body"), F.coalesce("ord", F.lit(1 << 30)).alias("ord"))
    order = Window.partitionBy(key).orderBy("ord", "title")
    first = joined.withColumn("place", F.row_number().over(order)).where(C("place") <= most)
    so_far = F.sum(F.length("title") + F.length("body")).over(order)
    return first.withColumn("so_far", so_far).where(C("so_far") <= budget).select(*([by] if by else []), "title", "body")


def applied_completions(work: DataFrame, completions: DataFrame) -> DataFrame:
    """Summaries for work items(period, …) from completions(period, text, error); errors are skipped."""
    return work.join(completions.where("error IS NULL AND text IS NOT NULL"), "period")


#: What model output of a distillation holds. Sources are texts or objects with a uri: an object comes as its text.
_DISTILLED = "wisdom string, {k} array<struct<slug: string, category: string, name: string, description: string, body: string, sources: array<string>, related: array<string>>>"


def parsed_promotions(outputs: DataFrame) -> DataFrame:
    """Promotions in model outputs(id, text), a JSON object that may stand in a code fence: id, pos, slug, category,
    name (else the slug), description, body, sources (uris), related (valid slugs). An output that can't be
    read, or says no wisdom, gives none."""
    inner = F.regexp_replace(F.regexp_replace(F.trim("text"), r"\A```(?:json)?\s*\n", ""), r"\n```\s*\z", "")
    read = outputs.select("id", *(F.from_json(inner, _DISTILLED.format(k=k)).alias(k) for k in ("wiki_promotions", "wikiPromotions")))
    read = read.where(F.coalesce(F.trim("wiki_promotions.wisdom"), F.lit("")) != "")
    each = read.select("id", F.posexplode(F.coalesce("wiki_promotions.wiki_promotions", "wikiPromotions.wikiPromotions")).alias("pos", "p"))
    uri = lambda s: F.when(s.startswith("{"), F.get_json_object(s, "$.uri")).otherwise(s)
    sources = F.filter(F.transform("p.sources", uri), lambda s: s.isNotNull() & (s != ""))
    slug = F.trim("p.slug")
    name = F.when(F.coalesce("p.name", F.lit("")) != "", C("p.name")).otherwise(slug)
    return each.where("p IS NOT NULL").select("id", "pos", slug.alias("slug"), "p.category", name.alias("name"), F.coalesce("p.description", F.lit("")).alias("description"), "p.body", sources.alias("sources"), F.filter("p.related", text.valid_slug).alias("related"))


def validated_promotions(rows: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """Promotions(slug, category, body, sources) with what speaks against each."""
    problems = {"slug": ~text.valid_slug(C("slug")), "category": ~C("category").isin(*categories), "body": F.coalesce(F.trim("body"), F.lit("")) == "", "sources": F.size("sources") < 1}
    return rows.withColumn("problems", F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(True)), F.lit(name)) for name, test in problems.items()))))
