"""Rolling windows over a stream, against windows counted one by one, with late rows and several batches."""

import random
import tempfile
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tests.plan_rows import most_rows
from tidelog.streaming import jobs, windows

START = datetime(2024, 1, 1)


def run(spark, job, batches, schema, columns):
    """Rows of the job's folder when the batches come one after the other."""
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        job(spark.readStream.schema(schema).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/checkpoint", days=5, once=True).awaitTermination()
    found = spark.read.parquet(f"{folder}/out").select(F.datediff(F.col("start").cast("date"), F.lit(START.date())).alias("s"), *columns).collect()
    return sorted(map(tuple, found), key=repr)


def days_apart(seed, n, first, last):
    rng = random.Random(seed)
    return [(rng.randrange(first * 86_400, last * 86_400), rng.randrange(4)) for _ in range(n)]


def counted(batches, late=86_400, days=5):
    """Rows of each batch that are not late, and the day of the last watermark."""
    taken, mark = [], None
    for rows in batches:
        shut = None if mark is None else mark // 86_400 - 1
        taken += [r for r in rows if r[0] is not None and (shut is None or r[0] // 86_400 > shut)]
        mark = max([m for m in (mark, *(r[0] - late for r in rows if r[0] is not None)) if m is not None], default=None)
    last = mark // 86_400 - days
    return taken, range(min(r[0] // 86_400 for r in taken) - days + 1, last + 1)


# The third batch has late rows, the fourth nothing but a null time, the fifth closes windows after a long pause.
SECONDS = [days_apart(1, 60, 0, 9), days_apart(2, 40, 8, 14), days_apart(3, 40, 2, 16), [(None, 0)], [(40 * 86_400 + 5, 1)], [(41 * 86_400, 1), (90 * 86_400, 1)]]


def test_rolling_hits_equal_windows_one_by_one(spark):
    plain = [[(s, f"u{(s or 0) % 3}" if k else None, f"q{k}" if k < 3 else None) for s, k in b] for b in SECONDS]
    taken, starts = counted(plain)
    wanted = []
    for s in starts:
        for u in {r[1] for r in taken}:
            own = [r for r in taken if r[1] == u and s <= r[0] // 86_400 < s + 5]
            if own:
                wanted.append((s, u, len(own), len({r[2] for r in own})))
    batches = [[(None if s is None else START + timedelta(seconds=s), u, q) for s, u, q in b] for b in plain]
    found = run(spark, jobs.rolling_hits, batches, "ts timestamp, uri string, query string", ["uri", "n_hits", "n_queries"])
    assert len(wanted) > 50 and found == sorted(wanted, key=repr)


def test_rolling_gaps_equal_windows_one_by_one(spark):
    taken, starts = counted(SECONDS)
    wanted = []
    for s in starts:
        for k in range(4):
            own = [r for r in taken if r[1] == k and s <= r[0] // 86_400 < s + 5]
            if own:
                wanted.append((s, f"q{k}", len(own), round(sum(r[0] % 7 / 8 for r in own) / len(own), 9)))
    batches = [[(None if s is None else START + timedelta(seconds=s), f" Q{k}", [0.0, (s or 0) % 7 / 8]) for s, k in b] for b in SECONDS]
    found = run(spark, jobs.rolling_gaps, batches, "ts timestamp, query string, scores array<double>", ["query", "n", F.round("mean_best", 9)])
    assert len(wanted) > 30 and found == sorted(wanted, key=repr)


def test_rows_are_not_copied_to_each_window(spark):
    rows = spark.range(3000).select((F.col("id") % 3).cast("int").alias("day"), F.lit("u").alias("uri"), F.concat(F.lit("q"), F.col("id").cast("string")).alias("query"), F.lit(1).cast("long").alias("n"))
    assert most_rows(windows.hits_of_windows(rows, 30, -29, 2)) <= 3000 * 3
    days = spark.range(3).select(F.col("id").cast("int").alias("day"), F.lit("q").alias("query"), F.lit(1).cast("long").alias("n"), F.lit(0.5).alias("best"))
    assert most_rows(windows.gaps_of_windows(days, 30, -29, 2)) <= 32


def test_an_empty_stream_gives_no_rows(spark):
    assert run(spark, jobs.rolling_hits, [[(None, "u", "q")]], "ts timestamp, uri string, query string", ["uri"]) == []
