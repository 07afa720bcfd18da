"""Queries of the signal operators over the search log and the daily notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions import text
from tidelog.operators import signals
from tidelog.plans.text_queries import _SUPERSESSIONS, _keyword_sql, _LIGHT
from tidelog.sources import views
from tidelog.sources.scratch import settled
from tidelog.sources.views import sql

C = F.col


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


def _as_of(spark, sf):
    """The latest day of the notes, as a scalar subquery: bounds on dates filter before texts are read."""
    return signals.reference_date(views.daily(spark, sf)).scalar()


def g1_reference_date(spark, sf):
    return signals.reference_date(views.daily(spark, sf)).select(C("as_of").cast("string").alias("as_of"))


G1 = sql("v_daily", "SELECT CAST(max(mem_date) AS VARCHAR) AS as_of FROM v_daily")


def g2_log_window(spark, sf):
    log = views.search_log(spark, sf)
    last = log.agg(F.max("ts").alias("as_of"))
    return signals.in_window(log.crossJoin(F.broadcast(last)), "ts", C("as_of"), 7).groupBy("query").agg(F.count("*").alias("n"))


G2 = "SELECT event_type || ' ' || (user_id % 20 + 20 * (event_id // 2000)) AS query, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1"


def g3_hit_frequency(spark, sf):
    return _round(signals.hit_frequency(views.hits(spark, sf)), "score")


_G3 = """WITH c AS (SELECT uri, count(*) AS n_hits, count(DISTINCT query) AS n_queries FROM v_hits GROUP BY uri)
    SELECT uri, n_hits, n_queries, round(score, 9) AS score FROM (SELECT *, 0.5 * n_hits / (SELECT max(n_hits) FROM c) + 0.5 * n_queries / (SELECT max(n_queries) FROM c) AS score FROM c) WHERE score > 0.2"""
G3 = sql("v_hits", _G3)


def g4_gaps(spark, sf):
    return _round(signals.gaps(views.search_log(spark, sf)), "mean_best", "score").withColumn("last_asked", F.date_format("last_asked", "yyyy-MM-dd HH:mm:ss"))


_BEST = "WITH b AS (SELECT event_id, ts, lower(trim(query)) AS query, max(score) AS best FROM v_hits GROUP BY ALL), q AS (SELECT query, count(*) AS n, avg(best) AS mean_best, max(ts) AS last_asked FROM b GROUP BY query)"
G4 = sql("v_hits", _BEST + " SELECT query, n, round(mean_best, 9) AS mean_best, strftime(last_asked, '%Y-%m-%d %H:%M:%S') AS last_asked, round(least(1.0, n / 5) * (1 - mean_best), 9) AS score FROM q WHERE mean_best < 0.3 AND n >= 2")


def _covered(spark, sf):
    return views.table(spark, sf, "nation").select(F.lower("n_name").alias("entity"))


def g5_recurring_entities(spark, sf):
    return _round(signals.recurring_entities(views.daily(spark, sf), _covered(spark, sf)), "score")


G5 = sql(
    "v_daily",
    "WITH e AS (SELECT mem_date, lower(unnest(" + _LIGHT.replace("{more}", r"regexp_extract_all(text, '@(\w+)', 1)") + ")) AS entity FROM v_daily), n AS (SELECT entity, count(DISTINCT mem_date) AS n_days FROM e GROUP BY entity) "
    "SELECT entity, n_days, round(least(1.0, n_days / 9.0), 9) AS score FROM n WHERE n_days >= 3 AND entity NOT IN (SELECT lower(n_name) FROM nation)",
)


def _items(spark, sf):
    """Project and reference pages as items: some have a date, the others speak of one."""
    w = views.wiki(spark, sf).where(C("category").isin("project", "reference"))
    return w.select(C("slug").alias("uri"), F.when(C("doc_id") % 2 == 0, C("updated")).alias("date"), F.concat(F.lit("Begun "), C("updated").cast("string"), F.lit(". "), C("body")).alias("text"))


def g6_staleness(spark, sf):
    return _round(signals.stale_items(_items(spark, sf), _as_of(spark, sf)).withColumn("days_old", C("days_old").cast("long")), "score")


_G6 = """WITH a AS (SELECT slug AS uri, CAST(datediff('day', updated, (SELECT max(updated) FROM v_wiki)) AS BIGINT) AS days_old FROM v_wiki WHERE category IN ('project', 'reference'))
    SELECT uri, days_old, round(least(1.0, days_old / 180.0), 9) AS score FROM a WHERE days_old > 90"""
G6 = sql("v_wiki", _G6)


def g7_supersession(spark, sf):
    return _round(signals.superseding_notes(views.daily(spark, sf), _as_of(spark, sf)), "score")


G7 = sql(
    "v_daily",
    f"""WITH m AS (SELECT uri, CAST({_SUPERSESSIONS} AS BIGINT) AS n_markers, datediff('day', mem_date, (SELECT max(mem_date) FROM v_daily)) AS age FROM v_daily)
    SELECT uri, n_markers, round(least(1.0, n_markers / 3) * greatest(0.5, 1 - age / 60.0), 9) AS score FROM m WHERE n_markers > 0 AND age <= 30""",
)


def _entries(spark, sf):
    return views.table(spark, sf, "part").select(C("p_partkey").alias("entry_id"), F.concat(F.element_at(F.array(*map(F.lit, ("click", "error", "purchase", "other"))), (C("p_partkey") % 4 + 1).cast("int")), F.lit(" signal "), (C("p_partkey") % 700).cast("string"), F.lit(" "), C("p_name")).alias("text"))


def g8_wisdom_drift(spark, sf):
    log = views.search_log(spark, sf).withColumn("query", F.concat("query", F.lit(" "), (C("event_id") % 500).cast("string")))
    return signals.drifting_entries(_entries(spark, sf), log, log)


G8 = f"""WITH e AS (SELECT p_partkey AS entry_id, ['click', 'error', 'purchase', 'other'][p_partkey % 4 + 1] || ' signal ' || (p_partkey % 700) || ' ' || p_name AS text FROM part),
  w AS (SELECT entry_id, unnest({_keyword_sql(text.SIGNAL_STOP_WORDS, '', 2, 'text')}) AS word FROM e),
  q AS (SELECT DISTINCT event_type || ' ' || (user_id % 20 + 20 * (event_id // 2000)) || ' ' || (event_id % 500) AS query FROM events),
  a AS (SELECT DISTINCT query, unnest({_keyword_sql(text.SIGNAL_STOP_WORDS, '', 2, 'query')}) AS word FROM q),
  m AS (SELECT DISTINCT entry_id FROM (SELECT entry_id, query, count(*) AS n FROM w JOIN a USING (word) GROUP BY ALL) WHERE n >= 2)
  SELECT entry_id, CAST(0.5 AS DOUBLE) AS score FROM e WHERE entry_id NOT IN (SELECT entry_id FROM m) AND (SELECT count(*) FROM events) > 10"""


def _candidates(spark, sf):
    notes, as_of = views.daily(spark, sf), _as_of(spark, sf)
    return signals.weighted_union(
        hit_frequency=signals.hit_frequency(views.hits(spark, sf)).withColumnRenamed("uri", "key"),
        gap=signals.gaps(views.search_log(spark, sf)).withColumnRenamed("query", "key"),
        entity=signals.recurring_entities(notes, _covered(spark, sf)).withColumnRenamed("entity", "key"),
        staleness=signals.stale_items(_items(spark, sf), as_of).withColumnRenamed("uri", "key"),
        wisdom_drift=g8_wisdom_drift(spark, sf).select(C("entry_id").cast("string").alias("key"), "score"),
        supersession=signals.superseding_notes(notes, as_of).withColumnRenamed("uri", "key"),
    )


def g9_weighted_union(spark, sf):
    return _round(_candidates(spark, sf), "score")


_G9 = f"""WITH c AS (SELECT uri, count(*) AS n_hits, count(DISTINCT query) AS n_queries FROM v_hits GROUP BY uri),
  f AS (SELECT uri, 0.5 * n_hits / (SELECT max(n_hits) FROM c) + 0.5 * n_queries / (SELECT max(n_queries) FROM c) AS score FROM c),
  b AS (SELECT event_id, ts, lower(trim(query)) AS query, max(score) AS best FROM v_hits GROUP BY ALL), q AS (SELECT query, count(*) AS n, avg(best) AS mean_best FROM b GROUP BY query),
  a AS (SELECT slug, datediff('day', updated, (SELECT max(updated) FROM v_wiki)) AS age FROM v_wiki WHERE category IN ('project', 'reference')),
  m AS (SELECT uri, {_SUPERSESSIONS} AS n, datediff('day', mem_date, (SELECT max(mem_date) FROM v_daily)) AS age FROM v_daily),
  every AS (SELECT 'hit_frequency' AS kind, uri AS key, 0.25 * score AS score FROM f WHERE score > 0.2
    UNION ALL SELECT 'gap', query, 0.2 * least(1.0, n / 5) * (1 - mean_best) FROM q WHERE mean_best < 0.3 AND n >= 2
    UNION ALL SELECT 'staleness', slug, 0.15 * least(1.0, age / 180.0) FROM a WHERE age > 90
    UNION ALL SELECT 'entity', entity, 0.15 * score FROM ({G5})
    UNION ALL SELECT 'wisdom_drift', CAST(entry_id AS VARCHAR), 0.25 * score FROM ({G8})
    UNION ALL SELECT 'supersession', uri, 0.15 * least(1.0, n / 3) * greatest(0.5, 1 - age / 60.0) FROM m WHERE n > 0 AND age <= 30)
  SELECT kind, key, round(score, 9) AS score FROM every"""
G9 = sql("v_hits v_daily v_wiki", _G9)


def g10_session_budget(spark, sf):
    return _round(signals.session_budget(_round(_candidates(spark, sf), "score")), "score")


G10 = f"SELECT * FROM ({G9}) ORDER BY score DESC, kind, key LIMIT 20"


def g10_carried_over(spark, sf):
    """What the budget leaves for the next session."""
    every = settled(_round(_candidates(spark, sf), "score"))
    return signals.carried_over(every, signals.session_budget(every))


G10_REST = f"SELECT * FROM ({G9}) ORDER BY score DESC, kind, key OFFSET 20"


def g11_page_hits(spark, sf):
    hits = signals.page_hits(views.search_log(spark, sf), C("uri").like("memory/2024-0%"))
    return _round(hits, "best_score").withColumn("last_hit", F.date_format("last_hit", "yyyy-MM-dd HH:mm:ss"))


G11 = sql("v_hits", "SELECT uri, count(*) AS n_hits, round(max(score), 9) AS best_score, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_hit, count(DISTINCT query) AS n_queries FROM v_hits WHERE uri LIKE 'memory/2024-0%' GROUP BY uri")


def g12_gap_records(spark, sf):
    return signals.gaps(views.search_log(spark, sf)).select("query", C("n").alias("frequency"), C("last_asked").cast("date").cast("string").alias("last_asked"))


G12 = sql("v_hits", _BEST + " SELECT query, n AS frequency, CAST(CAST(last_asked AS DATE) AS VARCHAR) AS last_asked FROM q WHERE mean_best < 0.3 AND n >= 2")


def g13_log_status(spark, sf):
    return signals.log_status(views.search_log(spark, sf)).withColumn("oldest", C("oldest").cast("date").cast("string"))


G13 = "SELECT count(*) AS n_entries, CAST(CAST(min(ts) AS DATE) AS VARCHAR) AS oldest FROM events"


def g18_temporal_gaps(spark, sf):
    notes = views.daily(spark, sf)
    summaries = notes.where("doc_id % 21 = 0").select(F.trunc("mem_date", "week").alias("week")).distinct()
    return signals.temporal_gaps(notes, summaries, views.search_log(spark, sf)).withColumn("week", C("week").cast("string"))


G18 = sql(
    "v_daily",
    """WITH n AS (SELECT CAST(date_trunc('week', mem_date) AS DATE) AS week, count(*) AS n_notes FROM v_daily GROUP BY 1),
    s AS (SELECT DISTINCT CAST(date_trunc('week', mem_date) AS DATE) AS week FROM v_daily WHERE doc_id % 21 = 0),
    q AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS n FROM events GROUP BY 1)
    SELECT CAST(n.week AS VARCHAR) AS week, n_notes, coalesce(q.n, 0) AS n_searches, coalesce(q.n, 0) < 3 AS quiet FROM n LEFT JOIN q USING (week) WHERE n.week NOT IN (SELECT week FROM s)""",
)

QUERIES = {f.__name__: f for f in (g1_reference_date, g2_log_window, g3_hit_frequency, g4_gaps, g5_recurring_entities, g6_staleness, g7_supersession, g8_wisdom_drift, g9_weighted_union, g10_session_budget, g10_carried_over, g11_page_hits, g12_gap_records, g13_log_status, g18_temporal_gaps)}
ORACLE_SQL = {"g1_reference_date": G1, "g2_log_window": G2, "g3_hit_frequency": G3, "g4_gaps": G4, "g5_recurring_entities": G5, "g6_staleness": G6, "g7_supersession": G7, "g8_wisdom_drift": G8, "g9_weighted_union": G9, "g10_session_budget": G10, "g10_carried_over": G10_REST, "g11_page_hits": G11, "g12_gap_records": G12, "g13_log_status": G13, "g18_temporal_gaps": G18}
