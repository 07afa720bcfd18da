"""Queries of chunking, judge output, page operations and further evaluation analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions import text
from tidelog.operators import evals, graph
from tidelog.plans.eval_queries import _ACTIVE, _calendar, _final, _FINAL
from tidelog.sources import views
from tidelog.sources.views import sql

C = F.col


_SECTIONS = "\n\n## Follow-up\nfirst line\n\nsecond\n### Small\nend"


def t3_heading_chunks(spark, sf):
    """Whole notes with two more headings behind them."""
    chunks = views.daily(spark, sf).select("doc_id", F.posexplode(text.heading_chunks(F.concat("text", F.lit(_SECTIONS)))).alias("chunk_id", "c"))
    return chunks.select("doc_id", C("chunk_id").cast("long").alias("chunk_id"), F.sha2("c.text", 256).alias("text_sha256"), C("c.start_line").cast("long").alias("start_line"), C("c.end_line").cast("long").alias("end_line"))


T3 = sql(
    "v_daily",
    """WITH l AS (SELECT doc_id, text, len(string_split(text, chr(10))) AS n, position(chr(10) || chr(10) IN text) AS cut, length(text) <= 2047 AS whole FROM v_daily)
    SELECT doc_id, 0 AS chunk_id, CASE WHEN whole THEN sha256(trim(text, ' ' || chr(10) || chr(9) || chr(13))) ELSE sha256(substr(text, 1, cut - 1)) END AS text_sha256, 0 AS start_line, CASE WHEN whole THEN n ELSE 1 END AS end_line FROM l
    UNION ALL SELECT doc_id, 1, sha256(trim(substr(text, cut + 2), ' ' || chr(10) || chr(9) || chr(13))), 2, n FROM l WHERE NOT whole
    UNION ALL SELECT doc_id, CASE WHEN whole THEN 1 ELSE 2 END, sha256('## Follow-up' || chr(10) || 'first line' || chr(10) || chr(10) || 'second'), n + 1, n + 4 FROM l
    UNION ALL SELECT doc_id, CASE WHEN whole THEN 2 ELSE 3 END, sha256('### Small' || chr(10) || 'end'), n + 5, n + 6 FROM l""",
)


def t29_judge_scores(spark, sf):
    d = views.table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("Sure:\n```json\n{\"correctness\": "), (C("o_orderkey") % 5).cast("string"), F.lit(".4, \"completeness\": "), (C("o_custkey") % 3).cast("string"), F.when(C("o_orderkey") % 11 == 0, "").otherwise(F.lit(", \"hallucination\": 1}\n```"))).alias("output"))
    s = text.judge_scores(C("output"))
    return d.select("o_orderkey", s["correctness"].alias("correctness"), s["completeness"].alias("completeness"), s["hallucination"].alias("hallucination"), s["error"].alias("error"))


T29 = """SELECT o_orderkey, CASE WHEN ok THEN CAST(o_orderkey % 5 AS INT) END AS correctness, CASE WHEN ok THEN CAST(o_custkey % 3 AS INT) END AS completeness, CASE WHEN ok THEN 1 END AS hallucination, CASE WHEN NOT ok THEN 'bad output' END AS error
  FROM (SELECT *, o_orderkey % 5 <= 3 AND o_orderkey % 11 <> 0 AS ok FROM orders)"""


def t35_first_mention(spark, sf):
    words = F.array(F.lit("decided"), F.lit("budget"))
    return views.daily(spark, sf).select("doc_id", F.sha2(text.first_mention(C("text"), words), 256).alias("sentence_sha256"))


# RE2 looks at nothing behind a match: borders are marked first.
T35 = sql(
    "v_daily",
    r"""WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: contains(lower(x), 'decided') OR contains(lower(x), 'budget'))[1] AS x FROM v_daily)
    SELECT doc_id, sha256(CASE WHEN length(x) > 120 THEN substr(x, 1, 117) || '...' ELSE x END) AS sentence_sha256 FROM s""",
)


def w10_lint_counts(spark, sf):
    pages = views.wiki(spark, sf).withColumn("name", F.when(C("doc_id") % 13 == 0, F.lit("Else")).otherwise(C("name"))).withColumn("category", F.when(C("doc_id") % 17 == 0, F.lit("odd")).when(C("doc_id") % 19 == 0, None).otherwise(C("category")))
    return graph.lint_counts(pages, views.WIKI_CATEGORIES)


W10 = "SELECT count(*) AS n_scanned, CAST(sum(CAST(doc_id % 13 = 0 AS INT)) AS BIGINT) AS n_drifted, CAST(sum(CAST(doc_id % 17 = 0 OR doc_id % 19 = 0 AS INT)) AS BIGINT) AS n_uncategorised FROM documents"


def _claims(spark, sf):
    i = C("doc_id")
    return views.table(spark, sf, "documents").select(F.concat(F.lit("doc-"), (i % 97).cast("string")).alias("slug"), F.concat(F.lit("memory/"), (i % 11).cast("string")).alias("source"), F.concat(F.lit("fact "), i.cast("string")).alias("fact"), views.day(i % 300).alias("superseded_on"))


def w12_first_supersessions(spark, sf):
    return graph.first_supersessions(_claims(spark, sf)).withColumn("superseded_on", C("superseded_on").cast("string"))


_CLAIMS = "(SELECT 'doc-' || (doc_id % 97) AS slug, 'memory/' || (doc_id % 11) AS source, 'fact ' || doc_id AS fact, CAST(DATE '2024-01-01' + CAST(doc_id % 300 AS INT) AS VARCHAR) AS superseded_on FROM documents)"
_FIRST = f"(SELECT * FROM {_CLAIMS} QUALIFY row_number() OVER (PARTITION BY slug, source ORDER BY superseded_on, fact) = 1)"
W12 = f"SELECT slug, source, fact, superseded_on FROM {_FIRST}"


def w13_trajectories(spark, sf):
    found = graph.trajectories(graph.first_supersessions(_claims(spark, sf)))
    return found.select("slug", F.sha2("chronology", 256).alias("chronology_sha256"), F.size("sources").cast("long").alias("n_sources"))


W13 = f"SELECT slug, sha256(string_agg(superseded_on || ': ' || fact, '; ' ORDER BY superseded_on, fact)) AS chronology_sha256, count(DISTINCT source) AS n_sources FROM {_FIRST} GROUP BY slug HAVING count(*) >= 2"


def e16_boundary_rates(spark, sf):
    given = F.element_at(F.array(*map(F.lit, ("answer", "refuse", "partial"))), (C("correctness") % 3 + 1).cast("int"))
    found = evals.boundary_rates(views.verdicts(spark, sf).where("expected_disclosure IS NOT NULL").withColumn("given", given))
    return found.select(*(F.round(c, 9).alias(c) for c in found.columns))


E16 = sql(
    "v_eval",
    """WITH g AS (SELECT expected_disclosure AS e, ['answer', 'refuse', 'partial'][correctness % 3 + 1] AS given FROM v_eval WHERE expected_disclosure IS NOT NULL)
    SELECT round(avg(CASE WHEN e = 'refuse' THEN CAST(given = 'answer' AS INT) END), 9) AS leak_rate, round(avg(CASE WHEN e = 'answer' THEN CAST(given = 'refuse' AS INT) END), 9) AS over_refusal_rate,
      round(avg(CASE WHEN given = e THEN CAST(1 AS DOUBLE) WHEN given = 'partial' OR e = 'partial' THEN 0.5 ELSE 0 END), 9) AS boundary_score FROM g""",
)


def e26_freshest_mentions(spark, sf):
    found = views.daily(spark, sf).select((C("doc_id") + 1).alias("day_number"), F.explode(text.signatures(C("text"))).alias("s")).select("day_number", C("s.value").alias("value"))
    pairs = views.table(spark, sf, "part").select(C("p_partkey").alias("qa_id"), F.concat(F.lit("$"), (C("p_size") % 50).cast("string"), F.lit("M")).alias("value"), (C("p_partkey") % 800).alias("last_day"))
    return evals.freshest_mentions(found, pairs).select("qa_id", C("day_number").cast("long").alias("day_number"), "value")


_VALUES = "(" + " UNION ".join(f"SELECT doc_id + 1 AS day_number, unnest(regexp_extract_all(text, '{p}')) AS value FROM v_daily" for p in text.SIGNATURES.values()) + ")"
E26 = sql("v_daily", f"SELECT p_partkey AS qa_id, max(day_number) AS day_number, '$' || (p_size % 50) || 'M' AS value FROM part JOIN {_VALUES} ON value = '$' || (p_size % 50) || 'M' WHERE day_number > p_partkey % 800 GROUP BY p_partkey, p_size")


def e30_generation_windows(spark, sf):
    checkpoints = views.ranges(spark).select(C("range_days").alias("day"))
    return evals.generation_windows(checkpoints, views.arcs(spark, sf)).withColumn("n_days", C("n_days").cast("long"))


E30 = sql(
    "v_arcs v_ranges",
    """WITH w AS (SELECT coalesce(lag(range_days) OVER (ORDER BY range_days), 0) AS after_day, range_days AS day FROM v_ranges)
    SELECT after_day, day, CAST(sum(CAST(start_day <= day AND end_day > after_day AS INT)) AS BIGINT) AS n_overlapping, CAST(sum(CAST(end_day <= after_day AS INT)) AS BIGINT) AS n_ended, CAST(day - after_day AS BIGINT) AS n_days FROM v_arcs, w GROUP BY ALL""",
)


def e33_echo_days(spark, sf):
    return evals.echo_days(evals.active_arcs(_calendar(spark, sf), views.arcs(spark, sf)))


E33 = sql("v_arcs", f"SELECT a.arc_id, a.day_number FROM {_ACTIVE} a JOIN v_arcs v ON a.arc_id = v.arc_id WHERE a.day_number IN (v.start_day, v.end_day, v.pinned_day) OR (day_in_arc > 14 AND (day_in_arc - 1) % 14 = 0)")


def e39_still_to_run(spark, sf):
    done = _final(spark, sf).groupBy("range_label").agg(F.avg("composite").alias("m"), F.sum(C("failed").cast("int")).alias("n_failed")).where("m >= 3")
    return evals.still_to_run(views.ranges(spark).unionByName(spark.createDataFrame([("365d", 365)], "range_label string, range_days int")), done).select("range_label", "range_days")


E39 = sql("v_eval", f"SELECT * FROM (SELECT range_label, range_days FROM v_ranges UNION ALL SELECT '365d', 365) WHERE range_label NOT IN (SELECT range_label FROM {_FINAL} GROUP BY range_label HAVING avg(composite) >= 3)")


def e41_triage(spark, sf):
    answer = F.when(C("qa_id") % 4 == 0, "I don't have that").otherwise("It was 5")
    kinds = F.when(C("qa_id") % 3 == 0, F.array(F.lit("summary"), F.lit("summary"))).otherwise(F.array(F.lit("daily"), F.lit("summary")))
    found = evals.triage(_final(spark, sf).where("failed").select(answer.alias("answer"), "hallucination", kinds.alias("kinds")))
    return found.select("n", *(F.round(c, 9).alias(c) for c in ("fabricated", "refused", "only_summaries")))


E41 = sql("v_eval", f"SELECT count(*) AS n, round(avg(CAST(h = 0 AS INT)), 9) AS fabricated, round(avg(CAST(qa_id % 4 = 0 AND h > 0 AS INT)), 9) AS refused, round(avg(CAST(qa_id % 3 = 0 AS INT)), 9) AS only_summaries FROM {_FINAL} WHERE failed")

QUERIES = {f.__name__: f for f in (t3_heading_chunks, t29_judge_scores, t35_first_mention, w10_lint_counts, w12_first_supersessions, w13_trajectories, e16_boundary_rates, e26_freshest_mentions, e30_generation_windows, e33_echo_days, e39_still_to_run, e41_triage)}
ORACLE_SQL = {"t3_heading_chunks": T3, "t29_judge_scores": T29, "t35_first_mention": T35, "w10_lint_counts": W10, "w12_first_supersessions": W12, "w13_trajectories": W13, "e16_boundary_rates": E16, "e26_freshest_mentions": E26, "e30_generation_windows": E30, "e33_echo_days": E33, "e39_still_to_run": E39, "e41_triage": E41}
