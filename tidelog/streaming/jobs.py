"""Incremental jobs with Structured Streaming.

Each job takes a streaming DataFrame or a folder and returns the started query, so that the caller
decides on triggers and waits. Sinks write to given folders; checkpoints lie beside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.streaming.windows import DayCounts, gaps_of_windows, hits_of_windows

C = F.col


def _trigger(writer, once: bool, every: str):
    return writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)


def watched_notes(spark: SparkSession, folder: str, upsert, checkpoint: str, once: bool = False, bundles: str | None = None) -> StreamingQuery:
    """Hands each batch of new or changed notes to upsert(batch, batch_id): uri, text, modified.

    A file in the folder is a note, and its path the uri. A file in the folder `bundles` has many, as JSON lines of
    uri and text: a file costs as much as some hundred notes. Batches that are run again after a failure carry the
    same id and rows."""
    files = spark.readStream.text(folder, wholetext=True, recursiveFileLookup=True)
    modified = F.col("_metadata.file_modification_time").alias("modified")
    notes = files.select(F.col("_metadata.file_path").alias("uri"), C("value").alias("text"), modified)
    if bundles is not None:
        many = spark.readStream.schema("uri string, text string").json(bundles, recursiveFileLookup=True)
        notes = notes.unionByName(many.select("uri", "text", modified))
    return _trigger(notes.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint), once, "2 seconds").start()


def captured_log(log: DataFrame, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends search-log rows (ts, …) to a table that is partitioned by day."""
    rows = log.withColumn("day", F.to_date("ts"))
    return _trigger(rows.writeStream.format("parquet").partitionBy("day").option("path", folder).option("checkpointLocation", checkpoint), once, "10 seconds").start()


def rolling_hits(hits: DataFrame, folder: str, checkpoint: str, days: int = 30, late: str = "1 day", once: bool = False) -> StreamingQuery:
    """Hits and different queries of each uri in windows of `days` days that move by one day. Rows later than
    `late` are dropped.

    Both numbers are exact. What is kept is one row for each day, uri and query, however often it hit; a
    window that closes is counted from these rows (DayCounts)."""
    one = hits.where("ts IS NOT NULL").select("ts", "uri", "query")
    counts = DayCounts(f"{checkpoint}/days", ("uri", "query"), {"n": ("long", F.count("*"), F.sum("n"))}, late)

    def closed(rows: DataFrame, first: int, last: int) -> DataFrame:
        return hits_of_windows(rows, days, first, last)

    return _trigger(one.writeStream.foreachBatch(counts.closing(folder, days, closed)).option("checkpointLocation", checkpoint), once, "1 minute").start()


def ingested_days(days: DataFrame, ingest, last: Column, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Hands the days up to `last` to ingest(batch, batch_id) in order of days within each batch."""

    def ordered(batch: DataFrame, batch_id: int) -> None:
        ingest(batch.where(C("day_number") <= last).dropDuplicates(["day_number"]).orderBy("day_number"), batch_id)

    return _trigger(days.writeStream.foreachBatch(ordered).option("checkpointLocation", checkpoint), once, "10 seconds").start()


def rolling_gaps(log: DataFrame, folder: str, checkpoint: str, days: int = 30, late: str = "1 day", once: bool = False) -> StreamingQuery:
    """How often each query of log(ts, query, scores) was asked, and its mean best score, in windows of
    `days` days that move by one day. Rows later than `late` are dropped. One row is kept for each day and
    query; a window that closes is summed from these rows (DayCounts)."""
    best = F.coalesce(F.array_max("scores"), F.lit(0.0))
    one = log.where("ts IS NOT NULL").select("ts", F.lower(F.trim("query")).alias("query"), best.alias("best"))
    counts = DayCounts(f"{checkpoint}/days", ("query",), {"n": ("long", F.count("*"), F.sum("n")), "best": ("double", F.sum("best"), F.sum("best"))}, late)

    def closed(rows: DataFrame, first: int, last: int) -> DataFrame:
        return gaps_of_windows(rows, days, first, last)

    return _trigger(one.writeStream.foreachBatch(counts.closing(folder, days, closed)).option("checkpointLocation", checkpoint), once, "1 minute").start()


def signal_pass(log: DataFrame, collect, checkpoint: str) -> StreamingQuery:
    """One scheduled pass over what the log has gained since the last one: collect(batch, batch_id). Run it
    by a timer; the checkpoint remembers how far it came."""
    return log.writeStream.foreachBatch(collect).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
