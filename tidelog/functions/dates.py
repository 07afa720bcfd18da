"""Column functions over dates: references in queries, dates of uris, affinity, recency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.functions.scan import matches, pattern
from tidelog.functions.text import ascii_bounds
from tidelog.sources.scratch import spread

_MONTH = "January|February|March|April|May|June|July|August|September|October|November|December"

# Cues for the present and for the first state.
LATEST = r"\b(?:latest|current|currently|now|as of (?:today|now)|at the end of|by the end of|stays? unchanged|kept (?:unchanged|the same)|recent(?:ly)?|today)\b"
EARLIEST = r"\b(?:original(?:ly)?|initial(?:ly)?|first (?:proposed|recorded|noted|established|set|captured)|at (?:first|the start|onset|kickoff)|kickoff|opening|inception|before .* (?:was|were) revised|earliest)\b"


def temporal_affinity(a: Column, b: Column, sigma: float = 30.0) -> Column:
    return F.exp(-F.abs(F.datediff(a, b)) / F.lit(sigma))


def recency_cue(query: Column) -> Column:
    text = F.lower(query)
    return F.when(text.rlike(ascii_bounds(LATEST)), "latest").when(text.rlike(ascii_bounds(EARLIEST)), "earliest")


#: The largest recency boost.
HIGHEST_RECENCY = 1.25


def recency_boost(date: Column, cue: Column, first: Column, last: Column) -> Column:
    """0.85 … HIGHEST_RECENCY by where the date lies between first and last; 1 without a cue or a span."""
    span = F.datediff(last, first)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.datediff(date, first) / span))
    return F.when(cue.isNull() | (span <= 0), 1.0).when(cue == "latest", 0.85 + 0.4 * t).otherwise(HIGHEST_RECENCY - 0.4 * t)


def iso_week(date: Column) -> Column:
    """`YYYY-Www`; the year is that of the week's Thursday."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), date).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(date).cast("string"), 2, "0"))


def week_thursday(date: Column) -> Column:
    return F.date_add(F.trunc(date, "week"), 3)


def week_month(date: Column) -> Column:
    """Month of the week's Thursday."""
    return F.date_format(week_thursday(date), "yyyy-MM")


def date_of_uri(uri: Column) -> Column:
    """A day, else the Thursday of an ISO week, else the 15th of a month."""
    day = F.try_to_date(F.regexp_extract(uri, r"\d{4}-\d{2}-\d{2}", 0), "yyyy-MM-dd")
    year, week = F.regexp_extract(uri, r"(\d{4})-W(\d{2})", 1), F.regexp_extract(uri, r"(\d{4})-W(\d{2})", 2)
    fourth = F.try_to_date(F.concat(year, F.lit("-01-04")), "yyyy-MM-dd")
    thursday = F.when(year != "", F.date_add(F.trunc(fourth, "week"), (week.try_cast("int") - 1) * 7 + 3))
    month = F.try_to_date(F.concat(F.regexp_extract(uri, r"(\d{4}-\d{2})(?!-?\d)", 1), F.lit("-15")), "yyyy-MM-dd")
    return F.coalesce(day, thursday, month)


def calendar_date(epoch: Column, day_number: Column) -> Column:
    return F.date_add(epoch, day_number - 1)


def with_dates(text: Column, epoch: Column) -> Column:
    """The text with the date of day N in place of each `day N`; the words before it stay."""
    numbers = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?i)\bday\s+(\d+)\b"), F.lit(1)))
    return F.aggregate(numbers, text, lambda t, n: F.regexp_replace(t, F.concat(F.lit(r"(?i)\bday\s+"), n, F.lit(r"\b")), calendar_date(epoch, n.cast("int")).cast("string")))


#: Vague times that are given a date.
VAGUE_TIMES = {
    "weekend": r"(?i)\b(?:the|that|this)\s+weekend(?:\s+(?:quiet|stabilization)\s+days?)?\b",
    "weekday": r"(?i)\b(?:the|that|this)\s+weekday(?:\s+(?:morning|rush))?\b",
    "part": r"(?i)\b(?:the|that|this)\s+(?:morning|evening|afternoon)\b",
}


def _falls_on(epoch: Column, weekday: str):
    return lambda d: F.date_format(calendar_date(epoch, d), "EEEE") == weekday


def anchored_times(text: Column, days: Column, epoch: Column) -> Column:
    """The text with a date behind each vague time: a named weekday gets the first of the relevant day
    numbers that is one, `the weekend` the first and last relevant weekend days, `that weekday` the
    first relevant weekday, parts of a day the first relevant day; without such a day the first
    relevant day counts. A text with an ISO date, or without relevant days, stays as it is."""
    date = lambda d: calendar_date(epoch, d)
    iso = lambda d: date(d).cast("string")
    first = iso(days[0])
    ends = F.array_sort(F.filter(days, lambda d: F.weekday(date(d)) >= 5))
    work = F.array_sort(F.filter(days, lambda d: F.weekday(date(d)) < 5))
    weekend = F.when(F.size(ends) >= 2, F.concat(iso(ends[0]), F.lit(" to "), iso(F.element_at(ends, -1)))).when(F.size(ends) == 1, iso(ends[0])).otherwise(first)
    weekday = F.when(F.size(work) > 0, iso(F.try_element_at(work, F.lit(1)))).otherwise(first)
    out = text
    for name in ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"):
        own = F.filter(days, _falls_on(epoch, name))
        anchor = F.when(F.size(own) > 0, iso(F.try_element_at(own, F.lit(1)))).otherwise(first)
        out = F.regexp_replace(out, F.lit(ascii_bounds(rf"(?i)\b({name})\b")), F.concat(F.lit("$1 ("), anchor, F.lit(")")))
    for name, anchor in (("weekend", weekend), ("weekday", weekday), ("part", first)):
        out = F.regexp_replace(out, F.lit(ascii_bounds(VAGUE_TIMES[name])), F.concat(F.lit("$0 ("), anchor, F.lit(")")))
    return F.when((F.size(days) > 0) & ~text.rlike(ascii_bounds(r"\b20\d{2}-\d{2}-\d{2}\b")), out).otherwise(text)


def range_series(start: Column, end: Column, step: Column) -> Column:
    """Days of the ranges from start to end, step by step; the end always closes the series."""
    return F.array_union(F.sequence(start, end, step), F.array(end))


def range_days(label: Column) -> Column:
    """Days of `Nd`, `Nmo` (30 each), `Ny` (365 each) and `full` (null: no limit)."""
    n = F.regexp_extract(label, r"^(\d+)(d|mo|y)$", 1).try_cast("int")
    unit = F.regexp_extract(label, r"^(\d+)(d|mo|y)$", 2)
    return F.when(unit == "d", n).when(unit == "mo", n * 30).when(unit == "y", n * 365)


_MONTHS_SHORT = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def _month_number(name: Column) -> Column:
    names = F.lit("".join(_MONTHS_SHORT))
    return ((F.position(F.lower(F.substring(name, 1, 3)), names) + 2) / 3).cast("int")


def _date(year: Column, month: Column, day: Column) -> Column:
    """Null where there is no such day."""
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.try_to_date(text, "yyyy-MM-dd")


def temporal_references(queries: DataFrame, now: Column) -> DataFrame:
    """All time references of queries(query_id, text): query_id, date, specificity, pattern_no, pos.

    Each pattern is a branch of (matches, how a match gives a date, specificity); month arithmetic
    clamps to the last day of a month. Bare years count only where nothing was found before them."""
    q = F.col("text")

    def g(pattern: str, k: int) -> Column:
        return F.regexp_extract(F.col("m"), pattern, k)

    num = lambda x: x.try_cast("int")
    # The patterns of time references, in the order in which they count.
    named_day = rf"(?i)\b({_MONTH})\s+(\d{{1,2}}),?\s+(\d{{4}})\b"
    iso_day = r"\b(\d{4})-(\d{2})-(\d{2})\b"
    named_month = rf"(?i)\b({_MONTH})\s+(\d{{4}})\b"
    iso_month = r"\b(\d{4})-(\d{2})\b(?!-\d{2})"
    quarter, quarter_last = r"(?i)\bQ([1-4])\s+(\d{4})\b", r"(?i)\bQ([1-4])\s+last\s+year\b"
    in_year, bare_year = r"(?i)\b(?:in|back\s+in|from|during)\s+(\d{4})\b", r"\b(20[12]\d)\b"
    weeks, months = r"(?i)\b(\d+)\s+weeks?\s+ago\b", r"(?i)\b(\d+)\s+months?\s+ago\b"
    middle = lambda n: (n - 1) * 3 + 2
    rules = [
        (named_day, _date(g(named_day, 3), _month_number(g(named_day, 1)), g(named_day, 2)), 4),
        (iso_day, _date(g(iso_day, 1), g(iso_day, 2), g(iso_day, 3)), 4),
        (named_month, _date(g(named_month, 2), _month_number(g(named_month, 1)), F.lit("15")), 3),
        (iso_month, _date(g(iso_month, 1), g(iso_month, 2), F.lit("15")), 3),
        (quarter, _date(g(quarter, 2), middle(num(g(quarter, 1))), F.lit("15")), 2),
        (quarter_last, _date(F.year(now) - 1, middle(num(g(quarter_last, 1))), F.lit("15")), 2),
        (in_year, F.when(num(g(in_year, 1)).between(1990, 2100), _date(g(in_year, 1), F.lit("7"), F.lit("1"))), 1),
        (bare_year, _date(g(bare_year, 1), F.lit("7"), F.lit("1")), 1),
        (r"(?i)\byesterday\b", F.date_sub(now, 1), 4),
        (r"(?i)\blast\s+week\b", F.date_sub(now, 7), 2),
        (weeks, F.date_sub(now, num(g(weeks, 1)) * 7), 2),
        (r"(?i)\blast\s+month\b", F.add_months(now, -1), 2),
        (months, F.add_months(now, -num(g(months, 1))), 2),
        (r"(?i)\blast\s+year\b", F.add_months(now, -12), 1),
        (r"(?i)\bthis\s+week\b", now, 2),
        (r"(?i)\bthis\s+month\b", now, 2),
    ]
    once = frozenset({8, 9, 11, 13, 14, 15})  # counted once, however often they occur
    months_named = _MONTHS_SHORT
    anchors = [months_named, ("-",), months_named, ("-",), ("q",), ("q",), ("in", "from", "during"), ("20",), ("yesterday",), ("last",), ("ago",), ("last",), ("ago",), ("last",), ("this",), ("this",)]
    scan = matches([pattern(p, *a) for (p, _, _), a in zip(rules, anchors)], once)
    each = spread(queries.select("query_id", "text")).select("query_id", F.explode(scan(q)).alias("x")).select("query_id", F.col("x.k").alias("pattern_no"), F.col("x.pos").alias("pos"), F.col("x.m").alias("m"))
    date, level = F.lit(None).cast("date"), F.lit(None).cast("int")
    for k, (_, value, specificity) in enumerate(rules):
        date, level = F.when(F.col("pattern_no") == k, value).otherwise(date), F.when(F.col("pattern_no") == k, specificity).otherwise(level)
    dated = each.select("query_id", date.alias("date"), level.alias("specificity"), "pattern_no", "pos").where("date is not null")
    earlier = F.max(F.when(F.col("pattern_no") < 7, 1).otherwise(0)).over(Window.partitionBy("query_id"))
    return dated.withColumn("earlier", earlier).where((F.col("pattern_no") != 7) | (F.col("earlier") == 0)).drop("earlier")


def best_reference(references: DataFrame) -> DataFrame:
    """The most specific reference of each query, of equals the first found."""
    order = Window.partitionBy("query_id").orderBy(F.col("specificity").desc(), "pattern_no", "pos")
    return references.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")
