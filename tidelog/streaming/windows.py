"""Windows of days over a stream, from counts by day that lie in a folder.

A stream's state would hold a row for each window that a day is in, in memory. Here each batch's counts by day
are a folder named by its id, as in sources.versions; a batch that is run again replaces its own folders with
the same rows. The watermark before a batch is the latest time of all earlier batches less `late`: rows of days
that ended by then are dropped, and windows that have ended by the watermark after the batch are written, each
once and in whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

C = F.col
DAY = 86_400
MICROS = DAY * 1_000_000


def day_number(ts: Column) -> Column:
    """Days from 1970-01-01, in UTC."""
    return F.floor(F.unix_seconds(ts) / DAY).cast("int")


class DayCounts:
    """Rows (day, keys, values) in a folder; values are named by (type, aggregate of rows, aggregate of values)."""

    def __init__(self, folder: str, keys: tuple[str, ...], values: dict[str, tuple[str, Column, Column]], late: str):
        self.folder, self.keys, self.values, self.late = folder.rstrip("/"), keys, values, late

    def _known(self, spark: SparkSession, batch_id: int) -> list[tuple[int, int | None, int | None]]:
        """Batch, latest day and watermark of the kept batches before this one."""
        if not batch_id:
            return []
        rows = spark.read.schema("last_day int, watermark long, batch long").parquet(f"{self.folder}/seen").where(C("batch") < batch_id)
        return [(r.batch, r.last_day, r.watermark) for r in rows.collect()]

    def _forget(self, spark: SparkSession, batches: list[int]) -> None:
        for path in (spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}/batch={b}") for b in batches for kind in ("counts", "seen")):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    def closing(self, folder: str, days: int, closed: Callable[[DataFrame, int, int], DataFrame]) -> Callable[[DataFrame, int], None]:
        """An upsert(batch, batch_id) for a stream of (ts, …): keeps its counts, and writes closed(rows, first,
        last), the windows that begin from the first to the last of these days, to the folder."""

        def upsert(batch: DataFrame, batch_id: int) -> None:
            spark = batch.sparkSession
            known = self._known(spark, batch_id)
            before = max((w for *_, w in known if w is not None), default=None)
            # The last day that the watermark has closed; rows of such days are late.
            shut = None if before is None else before // MICROS - 1
            rows = batch.withColumn("day", day_number(C("ts")))
            rows = rows if shut is None else rows.where(C("day") > shut)
            counts = rows.groupBy("day", *self.keys).agg(*(how.cast(kind).alias(name) for name, (kind, how, _) in self.values.items()))
            counts.sortWithinPartitions("day").write.mode("overwrite").parquet(f"{self.folder}/counts/batch={batch_id}")
            mark = F.unix_micros(F.max("ts") - F.expr(f"INTERVAL {self.late}"))
            seen = batch.agg(day_number(F.max("ts")).alias("last_day"), F.greatest(mark, F.lit(before).cast("long")).alias("watermark"))
            seen.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/seen/batch={batch_id}")
            after = spark.read.parquet(f"{self.folder}/seen/batch={batch_id}").first().watermark
            first, last = None if shut is None else shut - days + 2, -1 if after is None else after // MICROS - days
            # Batches whose days have all left the open windows are not read again.
            old = [b for b, day, _ in known if day is None or (first is not None and day < first)]
            wanted = [b for b, *_ in known if b not in old] + [batch_id]
            kinds = ", ".join(f"{name} {kind}" for name, (kind, *_) in self.values.items())
            schema = f"day int, {', '.join(f'{k} string' for k in self.keys)}, {kinds}"
            held = spark.read.schema(schema).parquet(*(f"{self.folder}/counts/batch={b}" for b in wanted)).where(C("day") <= last + days - 1)
            if len(wanted) > 1:
                held = held.groupBy("day", *self.keys).agg(*(again.alias(name) for name, (*_, again) in self.values.items()))
            if first is None:
                earliest = None if after is None else held.agg(F.min("day")).first()[0]
                first = last + 1 if earliest is None else earliest - days + 1
            held = held.where(C("day") >= first)
            # The first batch gives the folder its columns.
            if first <= last or not batch_id:
                closed(held, first, last).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
            self._forget(spark, [b for b in old if b < batch_id - 1])

        return upsert


def _start(day: Column) -> Column:
    return F.timestamp_seconds(day.cast("long") * DAY)


def hits_of_windows(rows: DataFrame, days: int, first: int, last: int) -> DataFrame:
    """start, end, uri, n_hits, n_queries of windows that begin on the days from first to last, from
    rows(day, uri, query, n), each once.

    Windows are not given copies of the rows: a row adds its hits to the windows that begin on its day or up to
    `days` - 1 days before it, and its query to those of them that the query's last day before doesn't
    reach already. Each uri has the sum of such changes for each day on which one happens, and the windows from
    one change to the next are alike."""
    own = Window.partitionBy("uri", "query").orderBy("day")
    begin = C("day") - (days - 1)
    before = F.lag("day").over(own)
    seen = rows.select("uri", "day", "n", F.greatest(begin, before + 1).alias("new"))
    none = F.lit(0).cast("long")
    one = F.lit(1).cast("long")
    parts = F.array(F.struct(begin.alias("at"), C("n"), F.when(C("new") == begin, one).otherwise(none).alias("q")), F.struct((C("day") + 1).alias("at"), (-C("n")).alias("n"), (-one).alias("q")))
    later = F.when(C("new") > begin, F.array(F.struct(C("new").alias("at"), none.alias("n"), one.alias("q")))).otherwise(F.slice(parts, 1, 0))
    each = seen.select("uri", F.inline(F.concat(parts, later)))
    changes = each.groupBy("uri", "at").agg(F.sum("n").alias("n"), F.sum("q").alias("q"))
    order = Window.partitionBy("uri").orderBy("at")
    runs = changes.select("uri", "at", F.sum("n").over(order).alias("n_hits"), F.sum("q").over(order).alias("n_queries"), F.lead("at").over(order).alias("next"))
    alike = runs.where((C("n_hits") > 0) & (C("at") <= last) & (C("next") > first))
    starts = F.sequence(F.greatest("at", F.lit(first)), F.least(C("next") - 1, F.lit(last)))
    found = alike.select(F.explode(starts).alias("s"), "uri", "n_hits", "n_queries")
    return found.select(_start(C("s")).alias("start"), _start(C("s") + days).alias("end"), "uri", "n_hits", "n_queries")


def gaps_of_windows(rows: DataFrame, days: int, first: int, last: int) -> DataFrame:
    """start, query, n, mean_best of windows that begin on the days from first to last, from rows(day, query, n,
    best: a sum), each once.

    A window is made by the query's first day in it, from that day's and the later days' rows, so there
    are only as many rows as days; sums are not differences, so equal windows have equal sums."""
    order = Window.partitionBy("query").orderBy("day")
    ahead = F.collect_list(F.struct("day", "n", "best")).over(order.rangeBetween(0, days - 1))
    since = rows.select("query", "day", ahead.alias("ahead"), F.lag("day").over(order).alias("before"))
    low = F.greatest(C("before") + 1, C("day") - (days - 1), F.lit(first))
    high = F.least(C("day"), F.lit(last))
    each = since.where((low <= high)).select("query", "ahead", F.explode(F.sequence(low, high)).alias("s"))
    within = F.filter("ahead", lambda r: r["day"] < C("s") + days)
    n = F.aggregate(within, F.lit(0).cast("long"), lambda t, r: t + r["n"])
    best = F.aggregate(within, F.lit(0.0), lambda t, r: t + r["best"])
    return each.select(_start(C("s")).alias("start"), "query", n.alias("n"), best.alias("best")).select("start", "query", "n", (C("best") / C("n")).alias("mean_best"))
