"""Queries of summaries, second-stage order, context assembly, timelines and roll-up results."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions import dates
from tidelog.operators import retrieval, rollup
from tidelog.plans.rollup_queries import _BEST
from tidelog.plans.text_queries import _WEEK
from tidelog.sources import views
from tidelog.sources.views import sql

C = F.col


def _best(spark, sf):
    return views.hits(spark, sf).groupBy(C("query").alias("query_id"), "uri").agg(F.max("score").alias("score"))


def r13_catalog_boost(spark, sf):
    catalog = views.hits(spark, sf).where("j = 1").groupBy(C("query").alias("query_id"), "uri").agg(F.min("score").alias("score"))
    found = retrieval.catalog_boosted(_best(spark, sf), catalog)
    return found.select("query_id", "uri", F.round("score", 9).alias("score"), (C("branch") == 1).alias("boosted"))


R13 = sql("v_hits", f"WITH c AS (SELECT query AS query_id, uri, min(score) * 1.2 AS s FROM v_hits WHERE j = 1 GROUP BY ALL) SELECT b.query_id, b.uri, round(greatest(score, coalesce(s, 0)), 9) AS score, coalesce(s > score, false) AS boosted FROM {_BEST} b LEFT JOIN c ON b.query_id = c.query_id AND b.uri = c.uri")


def r17_recent_summaries(spark, sf):
    recent = views.daily(spark, sf).select(F.concat(F.lit("weekly/"), dates.iso_week(C("mem_date"))).alias("uri")).distinct().orderBy(C("uri").desc()).limit(2)
    parents = _best(spark, sf).groupBy("query_id", F.concat(F.lit("weekly/"), dates.iso_week(dates.date_of_uri(C("uri")))).alias("parent")).agg(F.max("score").alias("score"))
    return retrieval.with_summaries(_best(spark, sf), parents, recent).select("query_id", "uri", F.round("score", 9).alias("score"))


R17 = sql(
    "v_hits v_daily",
    f"""WITH w AS (SELECT DISTINCT 'weekly/' || {_WEEK} AS uri FROM v_daily ORDER BY 1 DESC LIMIT 2), b AS (SELECT * FROM {_BEST}),
    p AS (SELECT query_id, 'weekly/' || strftime(CAST(regexp_extract(uri, '[0-9-]{{10}}') AS DATE), '%G-W%V') AS uri, max(score) AS score FROM b GROUP BY ALL),
    every AS (SELECT * FROM b UNION ALL SELECT * FROM p UNION ALL SELECT query_id, uri, 0.3 FROM (SELECT DISTINCT query_id FROM b), w)
    SELECT query_id, uri, round(max(score), 9) AS score FROM every GROUP BY query_id, uri""",
)


def r21_second_stage(spark, sf):
    hits = _best(spark, sf)
    day = F.dayofmonth(F.regexp_extract("uri", r"\d{4}-\d{2}-\d{2}", 0).cast("date"))
    rescored = hits.where("query_id NOT LIKE 'error%'").withColumn("new_score", (day * 7 % 31).cast("double"))
    pinned = hits.where("query_id LIKE '%7'").select("query_id").distinct()
    return retrieval.second_stage(hits, rescored, pinned=pinned).select("query_id", "uri", C("place").cast("long").alias("place"))


R21 = sql(
    "v_hits",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, uri) AS rank FROM {_BEST})
    SELECT query_id, uri, row_number() OVER (PARTITION BY query_id ORDER BY rank > 20, CASE WHEN rank <= 20 AND query_id NOT LIKE 'error%' AND query_id NOT LIKE '%7' THEN -(day(CAST(regexp_extract(uri, '[0-9-]{{10}}') AS DATE)) * 7 % 31) END NULLS FIRST, rank) AS place FROM r""",
)


def r27_timeline(spark, sf):
    pages = views.wiki(spark, sf)
    queries = views.qa(spark, sf).select(C("qa_id").alias("query_id"))
    # Every note and page belongs to questions: those of its number's rest.
    page_hits = queries.join(pages, F.pmod(C("doc_id"), F.lit(40)) == C("query_id") % 40).select("query_id", C("slug").alias("uri"), (C("doc_id") % 83).cast("double").alias("score"))
    sources = pages.select("slug", F.explode("sources").alias("source"))
    daily = queries.join(views.daily(spark, sf), F.pmod(C("doc_id"), F.lit(20)) == C("query_id") % 20).select("query_id", "uri", C("mem_date").alias("date"), F.lit(1.0).alias("score"))
    return retrieval.timeline(page_hits, sources, daily).select("query_id", "uri")


R27 = sql(
    "v_wiki v_daily",
    """WITH h AS (SELECT item_id AS query_id, slug, sources, doc_id % 83 AS score FROM benchmark JOIN v_wiki ON doc_id % 40 = item_id % 40 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY doc_id % 83 DESC, slug) <= 5),
    c AS (SELECT DISTINCT query_id, unnest(sources) AS uri FROM h), d AS (SELECT item_id AS query_id, uri, mem_date FROM benchmark JOIN v_daily ON doc_id % 20 = item_id % 20),
    m AS (SELECT d.*, c.uri IS NOT NULL AS cited, bool_or(c.uri IS NOT NULL) OVER (PARTITION BY d.query_id) AS any_cited FROM d LEFT JOIN c ON d.query_id = c.query_id AND d.uri = c.uri)
    SELECT query_id, uri FROM m WHERE cited OR NOT any_cited QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY mem_date, uri) <= 12""",
)


def r29_context(spark, sf):
    found = retrieval.assembled_context(_best(spark, sf), views.daily(spark, sf).select("uri", "text"))
    return found.select("query_id", F.sha2("context", 256).alias("context_sha256"), C("n_hits").cast("long").alias("n_hits"))


R29 = sql(
    "v_hits v_daily",
    f"""WITH r AS (SELECT query_id, uri, score, text, sum(length(text)) OVER (PARTITION BY query_id ORDER BY score DESC, uri ROWS UNBOUNDED PRECEDING) AS so_far FROM {_BEST} JOIN v_daily USING (uri))
    SELECT query_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY score DESC, uri)) AS context_sha256, count(*) AS n_hits FROM r WHERE so_far <= 24000 GROUP BY query_id""",
)


def a10_completions(spark, sf):
    notes = views.daily(spark, sf)
    # On the day after the last note's week every week is closed.
    last = notes.agg(F.max("mem_date").alias("day")).select(F.date_add(F.date_trunc("week", "day").cast("date"), 7).alias("as_of"))
    work = rollup.weekly_work(notes, spark.createDataFrame([], "period string"), last.scalar())
    done = work.select("period", F.concat(F.lit("Summary of "), "period").alias("text"), F.when(F.substring("period", -1, 1) == "3", "timeout").alias("error"))
    return rollup.applied_completions(work, done).select("period", "n_days", "text")


A10 = sql("v_daily", f"SELECT {_WEEK} AS period, count(*) AS n_days, 'Summary of ' || {_WEEK} AS text FROM v_daily GROUP BY 1 HAVING count(*) >= 3 AND right(period, 1) <> '3'")


def a13_promotions(spark, sf):
    """One model output for each page: every second one in a fence, every third with sources as objects, some
    broken, some without wisdom or with the other spelling of the list."""
    i = C("doc_id")
    uris = lambda f: F.array_join(F.transform("sources", f), ",")
    quoted = lambda s: F.concat(F.lit('"'), s, F.lit('"'))
    sources = F.when(i % 6 == 1, uris(lambda s: F.concat(F.lit('{"uri":"'), s, F.lit('","lines":3}')))).when(i % 6 == 4, '{"from":1},""').otherwise(uris(quoted))
    field = lambda name, value: F.concat(F.lit(f'"{name}":'), quoted(value), F.lit(","))
    slug = F.when(i % 7 == 0, F.upper("slug")).otherwise(F.concat(F.lit(" "), "slug", F.lit(" ")))
    one = F.concat(F.lit("{"), field("slug", slug), F.when(i % 9 > 0, field("category", F.when(i % 5 == 0, "odd").otherwise(C("category")))).otherwise(""), field("body", F.when(i % 11 == 0, " ").otherwise("see")), F.when(i % 2 == 0, field("name", C("name"))).otherwise(""), F.lit('"related":["ok-1","Not"],"sources":['), sources, F.lit("]}"))
    whole = F.concat(F.lit('{"wisdom":'), F.when(i % 17 == 0, '" "').otherwise('"w"'), F.when(i % 4 == 0, ',"wikiPromotions":[').otherwise(',"wiki_promotions":['), one, F.lit("]"), F.when(i % 19 == 0, "").otherwise("}"))
    outputs = views.wiki(spark, sf).select(i.alias("id"), F.when(i % 2 == 0, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).otherwise(whole).alias("text"))
    found = rollup.validated_promotions(rollup.parsed_promotions(outputs), views.WIKI_CATEGORIES)
    return found.select("id", "slug", "name", F.array_join("sources", ",").alias("sources"), F.array_join("related", ",").alias("related"), F.array_join("problems", ",").alias("problems"))


A13 = sql(
    "v_wiki",
    """SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN upper(slug) ELSE slug END AS slug, CASE WHEN doc_id % 2 = 0 THEN name WHEN doc_id % 7 = 0 THEN upper(slug) ELSE slug END AS name, CASE WHEN doc_id % 6 = 4 THEN '' ELSE array_to_string(sources, ',') END AS sources, 'ok-1' AS related,
      concat_ws(',', CASE WHEN doc_id % 7 = 0 THEN 'slug' END, CASE WHEN doc_id % 5 = 0 OR doc_id % 9 = 0 THEN 'category' END, CASE WHEN doc_id % 11 = 0 THEN 'body' END, CASE WHEN doc_id % 6 = 4 THEN 'sources' END) AS problems FROM v_wiki WHERE doc_id % 17 <> 0 AND doc_id % 19 <> 0""",
)

QUERIES = {f.__name__: f for f in (r13_catalog_boost, r17_recent_summaries, r21_second_stage, r27_timeline, r29_context, a10_completions, a13_promotions)}
ORACLE_SQL = {"r13_catalog_boost": R13, "r17_recent_summaries": R17, "r21_second_stage": R21, "r27_timeline": R27, "r29_context": R29, "a10_completions": A10, "a13_promotions": A13}
