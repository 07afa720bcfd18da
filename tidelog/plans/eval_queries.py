"""Queries of the evaluation analytics over questions, verdicts and arcs derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.operators import evals
from tidelog.sources import views
from tidelog.sources.views import sql

C = F.col


def _round(df, *columns):
    return df.withColumns({c: F.round(c, 9) for c in columns})


def _eligible(spark, sf):
    return evals.eligible(views.qa(spark, sf), views.ranges(spark))


_ELIGIBLE = "(SELECT * FROM v_qa, v_ranges WHERE coalesce(list_max(relevant_days), 0) <= range_days AND (irrelevant_after IS NULL OR range_days <= irrelevant_after))"
_FINAL = """(SELECT *, c + k + h AS composite, (c + k + h < 4 OR h = 0 OR c = 0) AS failed FROM (SELECT *, CASE WHEN app_correctness IS NOT NULL THEN app_correctness ELSE correctness END AS c,
  CASE WHEN app_correctness IS NOT NULL THEN app_completeness ELSE completeness END AS k, CASE WHEN app_correctness IS NOT NULL THEN app_hallucination ELSE hallucination END AS h FROM v_eval))"""


def _final(spark, sf):
    return evals.final_scores(views.verdicts(spark, sf))


def e1_eligible(spark, sf):
    return _eligible(spark, sf).select("qa_id", "range_days")


E1 = sql("v_qa v_ranges", f"SELECT qa_id, range_days FROM {_ELIGIBLE}")


def e2_new_or_earlier(spark, sf):
    return evals.with_first_range(_eligible(spark, sf)).select("qa_id", "range_days", "is_new")


E2 = sql("v_qa v_ranges", f"SELECT qa_id, range_days, range_days = min(range_days) OVER (PARTITION BY qa_id) AS is_new FROM {_ELIGIBLE}")


def e3_gated(spark, sf):
    return evals.ungated(_eligible(spark, sf)).groupBy("range_days", "category").agg(F.count("*").alias("n"))


E3 = sql("v_qa v_ranges", f"SELECT range_days, category, count(*) AS n FROM {_ELIGIBLE} WHERE category NOT IN ('group-session-attribution', 'information-boundary') GROUP BY ALL")


def e4_quotas(spark, sf):
    pairs = evals.with_first_range(_eligible(spark, sf)).where("NOT is_new").join(F.broadcast(views.categories(spark)), "category")
    return evals.quotas(pairs, 7)


E4 = sql(
    "v_qa v_ranges v_categories",
    f"""WITH p AS (SELECT *, range_days = min(range_days) OVER (PARTITION BY qa_id) AS is_new FROM {_ELIGIBLE}),
    n AS (SELECT range_days, category, count(*) AS n, min(cat_order) AS o FROM p JOIN v_categories USING (category) WHERE NOT is_new GROUP BY ALL),
    b AS (SELECT *, sum(n) OVER (PARTITION BY range_days) AS total FROM n), f AS (SELECT *, CAST(n * 7 // total AS BIGINT) AS base, (n * 7) % total AS rest FROM b),
    s AS (SELECT *, 7 - sum(base) OVER (PARTITION BY range_days) AS seats, row_number() OVER (PARTITION BY range_days ORDER BY rest DESC, n DESC, o) AS place FROM f)
    SELECT range_days, category, n, CAST(CASE WHEN total <= 7 THEN n ELSE base + CASE WHEN place <= seats THEN 1 ELSE 0 END END AS BIGINT) AS quota FROM s""",
)


def e4_stratified_sample(spark, sf):
    pairs = evals.with_first_range(_eligible(spark, sf)).join(F.broadcast(views.categories(spark)), "category")
    return evals.stratified_sample(pairs, 7).select("qa_id", "range_days", "is_new")


_SAMPLED = f"""WITH p AS (SELECT *, range_days = min(range_days) OVER (PARTITION BY qa_id) AS is_new FROM {_ELIGIBLE}),
    n AS (SELECT range_days, category, count(*) AS n, min(cat_order) AS o FROM p JOIN v_categories USING (category) WHERE NOT is_new GROUP BY ALL),
    b AS (SELECT *, sum(n) OVER (PARTITION BY range_days) AS total FROM n), f AS (SELECT *, CAST(n * 7 // total AS BIGINT) AS base, (n * 7) % total AS rest FROM b),
    s AS (SELECT *, 7 - sum(base) OVER (PARTITION BY range_days) AS seats, row_number() OVER (PARTITION BY range_days ORDER BY rest DESC, n DESC, o) AS place FROM f),
    t AS (SELECT range_days, category, CASE WHEN total <= 7 THEN n ELSE base + CASE WHEN place <= seats THEN 1 ELSE 0 END END AS quota FROM s),
    d AS (SELECT qa_id, range_days, category, row_number() OVER (PARTITION BY range_days, category ORDER BY md5(concat_ws(':', '1', qa_id, range_days)), qa_id) AS place FROM p WHERE NOT is_new)
    SELECT qa_id, range_days, is_new FROM p WHERE is_new UNION ALL SELECT qa_id, d.range_days, false FROM d JOIN t ON t.range_days = d.range_days AND t.category = d.category WHERE place <= quota"""
E4S = sql("v_qa v_ranges v_categories", _SAMPLED)


def e5_seeded_order(spark, sf):
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("range_days").orderBy(evals.seeded_order(7, "qa_id", "range_days"), "qa_id"))
    return _eligible(spark, sf).select("qa_id", "range_days", place.alias("place"))


E5 = sql("v_qa v_ranges", f"SELECT qa_id, range_days, row_number() OVER (PARTITION BY range_days ORDER BY md5(concat_ws(':', '7', qa_id, range_days)), qa_id) AS place FROM {_ELIGIBLE}")


def e8_final_scores(spark, sf):
    return _final(spark, sf).select("qa_id", "range_days", C("composite").cast("long").alias("composite"), "failed")


E8 = sql("v_eval", f"SELECT qa_id, range_days, composite, failed FROM {_FINAL}")


def e9_category_means(spark, sf):
    return _round(evals.category_means(_final(spark, sf), views.categories(spark), views.ranges(spark)), "mean_score")


E9 = sql("v_eval v_categories", f"SELECT r.range_days, c.category, round(coalesce(avg(composite), 0), 9) AS mean_score, count(composite) AS n FROM v_ranges r CROSS JOIN v_categories c LEFT JOIN {_FINAL} f ON f.range_days = r.range_days AND f.category = c.category GROUP BY ALL")


def e10_difficulty_means(spark, sf):
    return _round(evals.difficulty_means(_final(spark, sf)), "mean_score")


E10 = sql("v_eval", f"SELECT range_days, difficulty, round(avg(composite), 9) AS mean_score, count(*) AS n FROM {_FINAL} GROUP BY ALL")


def e12_range_summary(spark, sf):
    return _round(evals.range_summary(_final(spark, sf)), "mean_score", "hallucination_rate", "mean_latency_ms")


E12 = sql("v_eval", f"SELECT persona, range_days, round(avg(composite), 9) AS mean_score, round(avg(CASE WHEN h = 0 THEN 1.0 ELSE 0.0 END) * 100, 9) AS hallucination_rate, count(*) AS n, CAST(sum(CAST(failed AS INT)) AS BIGINT) AS n_failed, round(avg(latency_ms), 9) AS mean_latency_ms FROM {_FINAL} GROUP BY ALL")


def e13_heatmap(spark, sf):
    return _round(evals.across_personas(evals.heatmap(_final(spark, sf))), "score")


E13 = sql("v_eval", f"WITH c AS (SELECT persona, range_days, category, avg(composite) AS score, count(*) AS n FROM {_FINAL} GROUP BY ALL) SELECT range_days, category, round(sum(score * n) / sum(n), 9) AS score, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY ALL")


def e14_grid(spark, sf):
    cells = evals.category_means(evals.ungated(_final(spark, sf)), views.categories(spark), views.ranges(spark)).withColumnRenamed("mean_score", "score")
    return _round(evals.grid(cells, views.RANGES), *(f"d{d}" for d in views.RANGES))


_PIVOT = ", ".join(f"round(avg(CASE WHEN range_days = {d} THEN composite END), 9) AS d{d}" for d in views.RANGES)
E14 = sql("v_eval v_categories", f"SELECT c.category, {_PIVOT} FROM v_categories c LEFT JOIN {_FINAL} f ON f.category = c.category AND f.category NOT IN ('group-session-attribution', 'information-boundary') GROUP BY c.category")


def e15_disclosure(spark, sf):
    return _round(evals.disclosure(_final(spark, sf)), "mean_score")


E15 = sql("v_eval", f"SELECT expected_disclosure, count(*) AS n, count(DISTINCT qa_id) AS n_pairs, round(avg(composite), 9) AS mean_score FROM {_FINAL} WHERE expected_disclosure IS NOT NULL GROUP BY ALL")


def e17_totals(spark, sf):
    return _round(evals.totals(_final(spark, sf)), "percent")


_TOTALS = "SELECT category, range_days, 100.0 * sum(composite) / count(*) / 6 AS percent, count(*) AS n FROM {f} {w} GROUP BY GROUPING SETS ((category), (range_days), ())"
E17 = sql("v_eval", f"SELECT category, range_days, round(percent, 9) AS percent, n FROM ({_TOTALS.format(f=_FINAL, w='')})")


def e17_run_delta(spark, sf):
    scored = _final(spark, sf)
    return _round(evals.run_delta(*(evals.totals(scored.where(C("persona") == p)) for p in (0, 1))), "a", "b", "delta")


E17D = sql("v_eval", f"SELECT coalesce(a.category, b.category) AS category, coalesce(a.range_days, b.range_days) AS range_days, round(a.percent, 9) AS a, round(b.percent, 9) AS b, round(a.percent - b.percent, 9) AS delta FROM ({_TOTALS.format(f=_FINAL, w='WHERE persona = 0')}) a FULL JOIN ({_TOTALS.format(f=_FINAL, w='WHERE persona = 1')}) b ON a.category IS NOT DISTINCT FROM b.category AND a.range_days IS NOT DISTINCT FROM b.range_days")


def _gappy(spark, sf):
    """Cells of which some have no score, and some were never eligible."""
    scored = _final(spark, sf)
    means = evals.category_means(scored, views.categories(spark), views.ranges(spark))
    asked = evals.ungated(_eligible(spark, sf)).select("category", "range_days").distinct().withColumn("asked", F.lit(True))
    missing = (C("n") == 0) | ((F.length("category") + C("range_days")) % 4 == 0)
    return means.join(asked, ["category", "range_days"], "left").select("category", "range_days", C("asked").isNotNull().alias("eligible"), F.when(C("asked").isNotNull() & ~missing, C("mean_score")).alias("score"))


def e18_filled_gaps(spark, sf):
    return _round(evals.filled_gaps(_gappy(spark, sf)), "score")


_GAPPY = f"""WITH m AS (SELECT r.range_days, c.category, avg(composite) AS s, count(composite) AS n FROM v_ranges r CROSS JOIN v_categories c LEFT JOIN {_FINAL} f ON f.range_days = r.range_days AND f.category = c.category GROUP BY ALL),
  e AS (SELECT DISTINCT category, range_days FROM {_ELIGIBLE} WHERE category NOT IN ('group-session-attribution', 'information-boundary')),
  g AS (SELECT m.category, m.range_days, e.category IS NOT NULL AS eligible, CASE WHEN e.category IS NOT NULL AND n > 0 AND (length(m.category) + m.range_days) % 4 <> 0 THEN s END AS score FROM m LEFT JOIN e ON m.category = e.category AND m.range_days = e.range_days),
  l AS (SELECT max(range_days) AS last_days FROM g WHERE eligible AND score IS NOT NULL),
  f AS (SELECT category, range_days, eligible, CASE WHEN eligible AND range_days <= last_days THEN last_value(score IGNORE NULLS) OVER (PARTITION BY category ORDER BY range_days ROWS UNBOUNDED PRECEDING) WHEN eligible THEN score END AS score FROM g, l)"""
E18 = sql("v_eval v_categories", _GAPPY + " SELECT category, range_days, eligible, round(score, 9) AS score FROM f")


def e20_overall(spark, sf):
    recorded = views.ranges(spark).select("range_days", F.when(C("range_days") % 60 == 0, C("range_days") / 100).alias("recorded"))
    return _round(evals.overall(evals.filled_gaps(_gappy(spark, sf)), recorded), "overall")


E20 = sql("v_eval v_categories", _GAPPY + " SELECT range_days, round(CASE WHEN range_days % 60 = 0 THEN range_days / 100.0 ELSE avg(CASE WHEN eligible THEN score END) END, 9) AS overall FROM f GROUP BY range_days")


def e21_dropped_pairs(spark, sf):
    flagged = views.qa(spark, sf).where("qa_id % 9 = 0").select("qa_id")
    return _round(evals.range_summary(_final(spark, sf).join(flagged, "qa_id", "left_anti")).drop("mean_latency_ms"), "mean_score", "hallucination_rate")


E21 = sql("v_eval", f"SELECT persona, range_days, round(avg(composite), 9) AS mean_score, round(avg(CASE WHEN h = 0 THEN 1.0 ELSE 0.0 END) * 100, 9) AS hallucination_rate, count(*) AS n, CAST(sum(CAST(failed AS INT)) AS BIGINT) AS n_failed FROM {_FINAL} WHERE qa_id % 9 <> 0 GROUP BY ALL")


def e22_changed_pairs(spark, sf):
    old = views.qa(spark, sf)
    new = old.withColumn("irrelevant_after", F.when(C("qa_id") % 6 == 0, F.lit(99)).otherwise(C("irrelevant_after"))).withColumn("difficulty", F.when(C("qa_id") % 11 == 0, "hard").otherwise(C("difficulty")))
    return evals.changed(old, new, "qa_id", "irrelevant_after", "difficulty")


E22 = sql("v_qa", "SELECT qa_id FROM v_qa WHERE (qa_id % 6 = 0 AND irrelevant_after IS DISTINCT FROM 99) OR (qa_id % 11 = 0 AND difficulty <> 'hard')")


def _days(spark, sf):
    return views.daily(spark, sf).select((C("doc_id") + 1).cast("int").alias("day_number"), "text")


def e23_evidence(spark, sf):
    pairs = views.table(spark, sf, "documents").select(C("doc_id").alias("qa_id"), F.array((C("doc_id") + 1).cast("int"), ((C("doc_id") * 3) % 900 + 1).cast("int")).alias("relevant_days"))
    found = evals.evidence(pairs, _days(spark, sf), 1)
    return found.select("qa_id", F.sha2("evidence", 256).alias("evidence_sha256"), C("n_days").cast("long").alias("n_days"))


E23 = sql(
    "v_daily",
    """WITH p AS (SELECT doc_id AS qa_id, unnest([doc_id + 1, (doc_id * 3) % 900 + 1]) AS d FROM documents), e AS (SELECT DISTINCT qa_id, d + unnest([-1, 0, 1]) AS n FROM p)
    SELECT qa_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY n)) AS evidence_sha256, count(*) AS n_days FROM e JOIN v_daily ON n = doc_id + 1 GROUP BY qa_id""",
)


def e27_applied_fixes(spark, sf):
    q = views.qa(spark, sf).withColumnRenamed("question", "answer")
    fixes = q.where("qa_id % 4 = 1").select("qa_id", F.when(C("qa_id") % 8 == 1, "rewritten").alias("new_answer"), F.when(C("qa_id") % 8 == 5, 77).alias("obsolete_after"))
    return evals.applied_fixes(q.select("qa_id", "answer", "irrelevant_after"), fixes)


E27 = sql("v_qa", "SELECT qa_id, CASE WHEN qa_id % 8 = 1 THEN 'rewritten' ELSE question END AS answer, CASE WHEN qa_id % 8 = 5 THEN 77 ELSE irrelevant_after END AS irrelevant_after, qa_id % 4 = 1 AS changed FROM v_qa")


def e28_validated(spark, sf):
    i = C("qa_id")
    boundary = i % 10 == 9
    rows = views.qa(spark, sf).withColumns({
        "answer": F.when(i % 13 == 0, " ").when(i % 13 == 6, None).otherwise(F.concat(F.lit(" answer "), i.cast("string"))),
        "category": F.when(i % 11 == 0, "odd").otherwise(C("category")), "difficulty": F.when(i % 7 == 0, "odd").otherwise(C("difficulty")),
        "relevant_days": F.when(i % 5 == 0, F.array().cast("array<int>")).when(i % 5 == 1, F.array(F.lit(9), F.lit(0))).otherwise(F.reverse("relevant_days")),
        "query_session": F.when(i % 6 == 3, "s2").otherwise(""), "forbidden_sessions": F.when(i % 20 == 9, F.array(F.lit("s1"), F.lit(""))).when(boundary, F.array(F.lit(""))),
        "expected_disclosure": F.when(i % 4 == 1, "odd").otherwise(C("expected_disclosure")),
    })
    found = evals.validated(rows, 1000, views.CATEGORIES, 500)
    return found.select("qa_id", F.array_join("reasons", ", ").alias("reasons"), C("new_id").cast("long").alias("new_id"), "answer", F.array_join(F.transform("relevant_days", lambda d: d.cast("string")), ",").alias("days"), "query_session", F.array_join("forbidden_sessions", ",").alias("forbidden"), "expected_disclosure")


E28 = sql(
    "v_qa",
    """WITH q AS (SELECT qa_id, CASE WHEN qa_id % 13 IN (0, 6) THEN NULL ELSE 'answer ' || qa_id END AS good, CASE WHEN qa_id % 13 = 0 THEN '' WHEN qa_id % 13 = 6 THEN NULL ELSE 'answer ' || qa_id END AS answer, qa_id % 11 <> 0 AND qa_id % 10 = 9 AS boundary,
      CASE qa_id % 5 WHEN 0 THEN [] WHEN 1 THEN [0, 9] ELSE list_sort(relevant_days) END AS days, expected_disclosure FROM v_qa),
    r AS (SELECT *, array_to_string(list_filter([CASE WHEN good IS NULL THEN 'no answer' END, CASE WHEN qa_id % 11 = 0 THEN 'unknown category' END, CASE WHEN qa_id % 7 = 0 THEN 'unknown difficulty' END, CASE WHEN qa_id % 5 = 0 THEN 'no relevant day' END,
      CASE WHEN list_max(days) > 500 THEN 'day past checkpoint' END, CASE WHEN qa_id % 5 = 1 THEN 'day below 1' END, CASE WHEN boundary AND qa_id % 20 <> 9 THEN 'no forbidden session' END], lambda x: x IS NOT NULL), ', ') AS reasons FROM q)
    SELECT qa_id, reasons, CASE WHEN reasons = '' THEN 1000 + row_number() OVER (PARTITION BY reasons = '' ORDER BY qa_id) END AS new_id, answer, array_to_string(days, ',') AS days, CASE WHEN qa_id % 6 = 3 THEN 's2' WHEN boundary THEN 'principal' END AS query_session,
      CASE WHEN qa_id % 20 = 9 THEN 's1' WHEN qa_id % 10 = 9 THEN '' END AS forbidden, CASE WHEN qa_id % 4 <> 1 AND expected_disclosure IS NOT NULL THEN expected_disclosure WHEN boundary THEN 'refuse' END AS expected_disclosure FROM r""",
)


def e29_distribution(spark, sf):
    return views.qa(spark, sf).groupBy("category").agg(F.count("*").alias("n"))


E29 = sql("v_qa", "SELECT category, count(*) AS n FROM v_qa GROUP BY category")


def _calendar(spark, sf):
    return views.daily(spark, sf).select((C("doc_id") + 1).cast("int").alias("day_number"), C("mem_date").alias("day_date"))


def e32_active_arcs(spark, sf):
    return evals.active_arcs(_calendar(spark, sf), views.arcs(spark, sf)).select("day_number", "arc_id", "day_in_arc", "phase")


_ACTIVE = """(SELECT doc_id + 1 AS day_number, arc_id, type, pinned_day, doc_id + 1 - start_day + 1 AS day_in_arc, CASE WHEN share < 0.15 THEN 'early' WHEN share <= 0.75 THEN 'mid' WHEN share <= 0.90 THEN 'late' ELSE 'concluding' END AS phase
  FROM (SELECT *, CAST(doc_id + 1 - start_day + 1 AS DOUBLE) / (end_day - start_day + 1) AS share FROM documents JOIN v_arcs ON doc_id + 1 BETWEEN start_day AND end_day))"""
E32 = sql("v_arcs", f"SELECT day_number, arc_id, day_in_arc, phase FROM {_ACTIVE}")


def e35_density(spark, sf):
    days = _calendar(spark, sf)
    return evals.density(days, evals.active_arcs(days, views.arcs(spark, sf)))


E35 = sql(
    "v_arcs",
    f"""WITH a AS (SELECT * FROM {_ACTIVE}), n AS (SELECT day_number, count(*) AS n_arcs, max(CAST(type = 'incident' AS INT)) AS incident, sum(CAST(pinned_day = day_number AS INT)) AS n_pinned, max(CAST(day_in_arc = 1 OR phase = 'concluding' AS INT)) AS border FROM a GROUP BY 1),
    d AS (SELECT doc_id + 1 AS day_number, isodow(DATE '2024-01-01' + CAST(doc_id AS INT)) >= 6 AS weekend, coalesce(n_arcs, 0) AS n_arcs, coalesce(incident, 0) AS incident, coalesce(n_pinned, 0) AS n_pinned, coalesce(border, 0) AS border FROM documents LEFT JOIN n ON n.day_number = doc_id + 1)
    SELECT day_number, n_arcs, CASE WHEN weekend AND incident = 0 THEN 'quiet' WHEN n_pinned >= 2 AND n_arcs >= 3 THEN 'dense' WHEN incident = 1 OR n_pinned >= 1 OR border = 1 THEN 'busy' WHEN n_arcs >= 3 THEN 'busy' WHEN n_arcs = 0 THEN 'quiet' ELSE 'normal' END AS density FROM d""",
)


def e36_arc_days(spark, sf):
    return evals.arc_days(views.arcs(spark, sf), views.EPOCH)


_ARC_DAYS = """WITH x AS (SELECT arc_id, type, start_day, end_day, pinned_day, unnest(range(start_day, end_day + 1)) AS day_number FROM v_arcs),
  w AS (SELECT *, CASE WHEN end_day - start_day + 1 < 15 THEN 2 WHEN end_day - start_day + 1 < 100 THEN 3 ELSE 5 END AS k, day_number IN (start_day, end_day, pinned_day) AS pinned, isodow(DATE '2024-01-01' + CAST(day_number - 1 AS INT)) < 6 OR type = 'incident' AS counts FROM x),
  s AS (SELECT *, sum(CAST(pinned AND counts AS INT)) OVER (PARTITION BY arc_id ORDER BY day_number) AS stretch FROM w),
  n AS (SELECT *, sum(CAST(NOT pinned AND counts AS INT)) OVER (PARTITION BY arc_id, stretch ORDER BY day_number) AS n FROM s),
  chosen AS (SELECT arc_id, day_number FROM n WHERE pinned OR (counts AND CASE WHEN stretch = 0 THEN (n - 1) % k = 0 ELSE n % k = 0 END))"""
E36 = sql("v_arcs", _ARC_DAYS + " SELECT arc_id, day_number FROM chosen")


def e37_gap_days(spark, sf):
    return evals.gap_days(_calendar(spark, sf), evals.arc_days(views.arcs(spark, sf), views.EPOCH))


E37 = sql(
    "v_arcs",
    _ARC_DAYS
    + """, a AS (SELECT DISTINCT day_number FROM chosen), d AS (SELECT doc_id + 1 AS day_number, DATE '2024-01-01' + CAST(doc_id AS INT) AS day_date FROM documents),
  y AS (SELECT d.day_number, date_trunc('week', day_date) AS week, a.day_number IS NOT NULL AS active FROM d LEFT JOIN a ON a.day_number = d.day_number WHERE isodow(day_date) < 6),
  g AS (SELECT *, greatest(0, least(5, count(*) OVER (PARTITION BY week)) - count(*) FILTER (active) OVER (PARTITION BY week)) AS needed FROM y),
  e AS (SELECT *, greatest(1, count(*) OVER (PARTITION BY week) // needed) AS step, row_number() OVER (PARTITION BY week ORDER BY day_number) - 1 AS place FROM g WHERE NOT active AND needed > 0)
  SELECT day_number FROM e WHERE place % step = 0 AND place / step < needed""",
)


def e40_quartile_drift(spark, sf):
    return _round(evals.quartile_drift(_final(spark, sf)), "first", "last", "low", "middle", "high")


E40 = sql("v_eval", f"WITH r AS (SELECT persona, range_days, avg(composite) AS s FROM {_FINAL} GROUP BY ALL), q AS (SELECT *, ntile(4) OVER (PARTITION BY persona ORDER BY range_days) AS quarter FROM r) SELECT persona, round(avg(CASE WHEN quarter = 1 THEN s END), 9) AS first, round(avg(CASE WHEN quarter = 4 THEN s END), 9) AS last, round(min(s), 9) AS low, round(median(s), 9) AS middle, round(max(s), 9) AS high FROM q GROUP BY persona")


def e42_calibration(spark, sf):
    return _round(evals.calibration(views.verdicts(spark, sf)), "share")


E42 = sql("v_eval", "WITH f AS (SELECT range_days, coalesce(app_correctness + app_completeness + app_hallucination >= 4 AND app_hallucination > 0 AND app_correctness > 0, false) AS o FROM v_eval WHERE correctness + completeness + hallucination < 4 OR hallucination = 0 OR correctness = 0) SELECT range_days, count(*) AS n_failed, CAST(sum(CAST(o AS INT)) AS BIGINT) AS n_overturned, round(avg(CAST(o AS DOUBLE)), 9) AS share FROM f GROUP BY range_days")

QUERIES = {f.__name__: f for f in (e1_eligible, e2_new_or_earlier, e3_gated, e4_quotas, e4_stratified_sample, e5_seeded_order, e8_final_scores, e9_category_means, e10_difficulty_means, e12_range_summary, e13_heatmap, e14_grid, e15_disclosure, e17_totals, e17_run_delta, e18_filled_gaps, e20_overall, e21_dropped_pairs, e22_changed_pairs, e23_evidence, e27_applied_fixes, e28_validated, e29_distribution, e32_active_arcs, e35_density, e36_arc_days, e37_gap_days, e40_quartile_drift, e42_calibration)}
ORACLE_SQL = {"e1_eligible": E1, "e2_new_or_earlier": E2, "e3_gated": E3, "e4_quotas": E4, "e4_stratified_sample": E4S, "e5_seeded_order": E5, "e8_final_scores": E8, "e9_category_means": E9, "e10_difficulty_means": E10, "e12_range_summary": E12, "e13_heatmap": E13, "e14_grid": E14, "e15_disclosure": E15, "e17_totals": E17, "e17_run_delta": E17D, "e18_filled_gaps": E18, "e20_overall": E20, "e21_dropped_pairs": E21, "e22_changed_pairs": E22, "e23_evidence": E23, "e27_applied_fixes": E27, "e28_validated": E28, "e29_distribution": E29, "e32_active_arcs": E32, "e35_density": E35, "e36_arc_days": E36, "e37_gap_days": E37, "e40_quartile_drift": E40, "e42_calibration": E42}
