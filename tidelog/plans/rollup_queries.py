"""Queries of roll-up, retrieval and page graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions import dates, text
from tidelog.operators import graph, retrieval, rollup
from tidelog.plans.text_queries import _DECISIONS, _ENTITIES, _WEEK, _keyword_sql
from tidelog.sources import views
from tidelog.sources.scratch import settled
from tidelog.sources.views import sql

C = F.col


def _round(df, *columns, to=9):
    return df.withColumns({c: F.round(c, to) for c in columns})


def _weeks(spark, sf):
    return views.daily(spark, sf).select(F.trunc("mem_date", "week").alias("week_start")).distinct()


def a1_weekly_work(spark, sf):
    notes = views.daily(spark, sf)
    done = notes.where("doc_id % 35 = 0").select(dates.iso_week(C("mem_date")).alias("period")).distinct()
    return rollup.weekly_work(notes, done, F.lit("2026-06-01").cast("date"))


A1 = sql(
    "v_daily",
    f"""WITH d AS (SELECT DISTINCT {_WEEK} AS period FROM v_daily WHERE doc_id % 35 = 0)
    SELECT {_WEEK} AS period, count(*) AS n_days FROM v_daily GROUP BY 1 HAVING count(*) >= 3 AND max(CAST(date_trunc('week', mem_date) AS DATE)) + 6 < DATE '2026-06-01' AND period NOT IN (SELECT period FROM d)""",
)


def a2_monthly_work(spark, sf):
    done = views.daily(spark, sf).where("doc_id % 93 = 0").select(dates.week_month(C("mem_date")).alias("period")).distinct()
    return rollup.monthly_work(_weeks(spark, sf), done)


_MONTH = "strftime(CAST(date_trunc('week', {d}) AS DATE) + 3, '%Y-%m')"
A2 = sql(
    "v_daily",
    f"""WITH d AS (SELECT DISTINCT {_MONTH.format(d='mem_date')} AS period FROM v_daily WHERE doc_id % 93 = 0), w AS (SELECT DISTINCT CAST(date_trunc('week', mem_date) AS DATE) AS s FROM v_daily)
    SELECT {_MONTH.format(d='s')} AS period, count(*) AS n_weeks FROM w GROUP BY 1 HAVING count(*) >= 2 AND period NOT IN (SELECT period FROM d)""",
)


def a3_combined_text(spark, sf):
    found = rollup.combined_text(views.daily(spark, sf), dates.iso_week(C("mem_date")))
    return found.select("parent", F.sha2("text", 256).alias("text_sha256"), C("n_days").cast("long").alias("n_days"))


A3 = sql("v_daily", f"SELECT {_WEEK} AS parent, sha256(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY mem_date)) AS text_sha256, count(*) AS n_days FROM v_daily GROUP BY 1")


def a4_salience(spark, sf):
    return _round(rollup.salience(views.daily(spark, sf), dates.iso_week(C("mem_date"))), "weight")


_SALIENCE = f"""WITH c AS (SELECT doc_id, {_WEEK} AS parent, uri, ceil(length(text) / 4.0) AS t, len({_ENTITIES}) AS e, {_DECISIONS} AS d FROM v_daily),
  r AS (SELECT *, 0.4 * t / greatest(max(t) OVER p, 1) + 0.3 * e / greatest(max(e) OVER p, 1) + 0.3 * d / greatest(max(d) OVER p, 1) AS raw, count(*) OVER p AS n FROM c WINDOW p AS (PARTITION BY parent)),
  s AS (SELECT *, CASE WHEN n = 1 THEN 1.0 ELSE raw / sum(raw) OVER (PARTITION BY parent) END AS weight FROM r)"""
A4 = sql("v_daily", _SALIENCE + " SELECT parent, uri, round(weight, 9) AS weight FROM s")


def a5_uniform(spark, sf):
    return rollup.uniform(views.daily(spark, sf).select(dates.iso_week(C("mem_date")).alias("parent"), "uri"), "parent")


A5 = sql("v_daily", f"SELECT {_WEEK} AS parent, uri, round(1.0 / count(*) OVER (PARTITION BY {_WEEK}), 2) AS weight FROM v_daily")


def _parents(spark, sf, parent, edges=views.edges):
    return rollup.weighted_vectors(edges(spark, sf).withColumn("weight", 1.0 + C("vec_id") % 3), parent)


def a6_parent_vectors(spark, sf):
    each = _parents(spark, sf, "week").select("parent", "n_children", F.posexplode("vector").alias("i", "x"))
    return each.select("parent", "n_children", "i", F.round("x", 6).alias("x"))


_PARENT = """(SELECT parent, i, s / sqrt(sum(s * s) OVER (PARTITION BY parent)) AS x, n FROM (SELECT {p} AS parent, i, sum((1.0 + vec_id % 3) * CAST(x AS DOUBLE)) AS s, count(*) AS n
  FROM (SELECT *, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i FROM v_edges) GROUP BY ALL))"""
A6 = sql("v_edges", f"SELECT parent, n AS n_children, i, round(x, 6) AS x FROM {_PARENT.format(p='week')}")


def a14_expected_pointers(spark, sf):
    return rollup.expected_pointers(_weeks(spark, sf), views.daily(spark, sf).where("doc_id % 11 <> 0"))


A14 = sql(
    "v_daily",
    """WITH w AS (SELECT DISTINCT CAST(date_trunc('week', mem_date) AS DATE) AS s FROM v_daily), e AS (SELECT strftime(s, '%G-W%V') AS parent, s + CAST(k AS INT) AS d FROM w, (SELECT unnest(range(0, 7)) AS k))
    SELECT parent, 'memory/' || CAST(d AS VARCHAR) || '.md' AS uri, d IN (SELECT mem_date FROM v_daily WHERE doc_id % 11 <> 0) AS present FROM e""",
)


def a15_counts(spark, sf):
    notes = views.daily(spark, sf)
    memory = notes.select(F.lit("daily").alias("content_type")).unionByName(_weeks(spark, sf).select(F.lit("weekly").alias("content_type"))).unionByName(views.wiki(spark, sf).select(F.lit("wiki").alias("content_type")))
    return rollup.counts_by_type(memory)


A15 = sql("v_daily v_wiki", "SELECT 'daily' AS content_type, count(*) AS n FROM v_daily UNION ALL SELECT 'weekly', count(DISTINCT date_trunc('week', mem_date)) FROM v_daily UNION ALL SELECT 'wiki', count(*) FROM v_wiki")


# --- retrieval: queries are the rows whose id is divisible by 20, against all rows


def _vectors(spark, sf):
    return views.edges(spark, sf).select(C("vec_id").alias("uri"), C("embedding").alias("vector"))


def _vector_queries(spark, sf):
    return _vectors(spark, sf).where("uri % 20 = 0").withColumnRenamed("uri", "query_id")


def r1_nearest(spark, sf):
    return _round(retrieval.nearest(_vector_queries(spark, sf), _vectors(spark, sf), 10), "score", to=6)


_DOT = "list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))"
_NEAREST = f"(SELECT q.vec_id AS query_id, c.vec_id AS uri, {_DOT} AS score FROM v_edges q, v_edges c WHERE q.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, c.vec_id) <= 10)"
R1 = sql("v_edges", f"SELECT query_id, uri, round(score, 6) AS score FROM {_NEAREST}")


def _texts(spark, sf):
    return views.table(spark, sf, "documents").select(C("doc_id").alias("uri"), "text")


def _text_queries(spark, sf):
    return views.qa(spark, sf).select(C("qa_id").alias("query_id"), C("question").alias("text"))


def r2_bm25(spark, sf):
    return retrieval.bm25(_text_queries(spark, sf), _texts(spark, sf), 10)


_TOKENS = r"regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BM25 = f"""WITH t AS (SELECT doc_id AS uri, unnest({_TOKENS}) AS term FROM documents), p AS (SELECT uri, term, count(*) AS tf FROM t GROUP BY ALL),
  z AS (SELECT doc_id AS uri, len({_TOKENS}) AS size FROM documents), a AS (SELECT count(*) AS n, avg(size) AS m FROM z), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
  q AS (SELECT DISTINCT item_id AS query_id, unnest({_TOKENS}) AS term FROM benchmark),
  b AS (SELECT query_id, uri, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * size / m))) AS score FROM q JOIN p USING (term) JOIN f USING (term) JOIN z USING (uri), a GROUP BY ALL)"""
R2 = _BM25 + " SELECT query_id, uri, round(score, 6) AS score FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, uri) <= 10"


def r3_hybrid(spark, sf):
    """Vector hits of every 20th item's vector with the keyword hits of the question of that number."""
    vector_hits = retrieval.nearest(_vector_queries(spark, sf).withColumn("query_id", F.expr("query_id DIV 20")), _vectors(spark, sf), 10)
    keyword_hits = retrieval.bm25(_text_queries(spark, sf), _texts(spark, sf), 10)
    return _round(retrieval.hybrid(vector_hits, keyword_hits, documents=_texts(spark, sf).count()), "score", to=6)


R3 = sql(
    "v_edges",
    _BM25
    + f""", k AS (SELECT query_id, uri, round(score, 6) AS score FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, uri) <= 10),
  v AS (SELECT query_id // 20 AS query_id, uri, score FROM {_NEAREST}),
  ks AS (SELECT query_id, uri, score / max(score) OVER (PARTITION BY query_id) AS k FROM k), vs AS (SELECT query_id, uri, score / max(score) OVER (PARTITION BY query_id) AS v FROM v)
  SELECT coalesce(vs.query_id, ks.query_id) AS query_id, coalesce(vs.uri, ks.uri) AS uri, round(0.625 * coalesce(v, 0) + 0.375 * coalesce(k, 0), 6) AS score FROM vs FULL JOIN ks ON vs.query_id = ks.query_id AND vs.uri = ks.uri""",
)


def r8_catalog(spark, sf):
    entries = views.table(spark, sf, "part").select(C("p_partkey").alias("uri"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    queries = entries.where("uri % 20 = 0").withColumnRenamed("uri", "query_id")
    return retrieval.catalog_hits(queries, entries, text.catalog_tokens, 5)


R8 = f"""WITH e AS (SELECT p_partkey AS uri, p_name || ' ' || p_type AS text FROM part), q AS (SELECT uri AS query_id, {_keyword_sql((), ' ', 1, 'text')} AS w FROM e WHERE uri % 20 = 0),
  a AS (SELECT query_id, len(w) AS n, unnest(w) AS term FROM q), h AS (SELECT DISTINCT uri, unnest({_keyword_sql((), ' ', 1, 'text')}) AS term FROM e),
  s AS (SELECT query_id, uri, round(count(*) / n, 9) AS score FROM a JOIN h USING (term) GROUP BY query_id, uri, n)
  SELECT query_id, uri, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, uri) <= 5"""


def _parent_hits(spark, sf, edges=views.edges):
    parents = _parents(spark, sf, "week", edges).select(C("parent").alias("uri"), "vector")
    return retrieval.nearest(_vector_queries(spark, sf), parents, 10).withColumnRenamed("uri", "parent")


def r11_expansion(spark, sf):
    """All children of the ten best of 50 weeks, for each query: a fifth of the rows, so the answer itself grows
    with queries times rows."""
    pointers = views.wide_edges(spark, sf).select(C("week").alias("parent"), C("vec_id").alias("child"))
    direct = retrieval.nearest(_vector_queries(spark, sf), _vectors(spark, sf), 20)
    return retrieval.expanded(_parent_hits(spark, sf, views.wide_edges), pointers, direct, places=6)


_EXPANDED = f"""WITH p AS (SELECT parent, list(x ORDER BY i) AS v FROM {_PARENT.format(p='week')} GROUP BY parent),
  ph AS (SELECT q.vec_id AS query_id, parent, list_dot_product(CAST(q.embedding AS DOUBLE[]), v) AS score FROM v_edges q, p WHERE q.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, parent) <= 10),
  d AS (SELECT q.vec_id AS query_id, c.vec_id AS uri, {_DOT} AS score FROM v_edges q, v_edges c WHERE q.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, c.vec_id) <= 20),
  x AS (SELECT query_id, vec_id AS uri, 0.8 * score AS score, score AS parent_score FROM ph JOIN v_edges ON week = parent),
  every AS (SELECT query_id, uri, score, 0.0 AS parent_score FROM d UNION ALL SELECT x.* FROM x ANTI JOIN d USING (query_id, uri))"""
R11 = sql("v_wide_edges", _EXPANDED.replace("v_edges", "v_wide_edges") + " SELECT query_id, uri, round(score, 6) AS score, round(parent_score, 6) AS parent_score FROM every")


def r14_rerank(spark, sf):
    pointers = views.edges(spark, sf).select(C("week").alias("parent"), C("vec_id").alias("child"))
    direct = retrieval.nearest(_vector_queries(spark, sf), _vectors(spark, sf), 20)
    parents = settled(_parent_hits(spark, sf))
    spans = settled(retrieval.candidate_spans(direct.select("query_id", views.day(C("uri")).alias("date")), parents, pointers.withColumn("date", views.day(C("child")))))
    cue = F.when(C("query_id") % 3 == 0, "latest").when(C("query_id") % 3 == 1, "earliest")
    boost = F.when(C("uri") % 5 == 0, retrieval.WIKI_BOOST).otherwise(1.0)

    def final(hits):
        hits = hits.join(spans, "query_id").withColumn("date", views.day(C("uri")))
        recency = dates.recency_boost(C("date"), cue, C("span_start"), C("span_end"))
        found = retrieval.reranked(hits, dates.temporal_affinity(C("date"), views.day(C("query_id"))), recency, boost)
        return found.select("query_id", "uri", "score", "parent_score", F.round("final", 6).alias("final"))

    return retrieval.best_with_children(parents, pointers, direct, final, 5, dates.HIGHEST_RECENCY).select("query_id", "uri", "final")


R14 = sql(
    "v_edges",
    _EXPANDED
    + """, s AS (SELECT *, min(uri) OVER (PARTITION BY query_id) AS lo, max(uri) OVER (PARTITION BY query_id) AS hi FROM every),
  t AS (SELECT *, greatest(0.0, least(1.0, CAST(uri - lo AS DOUBLE) / (hi - lo))) AS t FROM s),
  f AS (SELECT query_id, uri, round((0.8 * score + 0.2 * parent_score) * CASE WHEN uri % 5 = 0 THEN 0.9 ELSE 1.0 END * exp(-abs(uri - query_id) / 30.0) * CASE WHEN hi = lo THEN 1.0 WHEN query_id % 3 = 0 THEN 0.85 + 0.4 * t WHEN query_id % 3 = 1 THEN 1.25 - 0.4 * t ELSE 1.0 END, 6) AS final FROM t)
  SELECT query_id, uri, final FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY final DESC, uri) <= 5""",
)


def _log_hits(spark, sf):
    return views.hits(spark, sf).select(C("query").alias("query_id"), "uri", F.regexp_extract("uri", r"\d{4}-\d{2}-\d{2}", 0).alias("day"), "score", "j")


def r18_merged(spark, sf):
    hits = _log_hits(spark, sf)
    found = retrieval.merged(*(hits.where(C("j") == j) for j in range(3)))
    return _round(found.withColumn("branch", C("branch").cast("long")), "score")


R18 = sql("v_hits", "SELECT query AS query_id, uri, round(max(score), 9) AS score, CAST(arg_max(j, score * 1000 - j * 0.001) AS BIGINT) AS branch FROM v_hits GROUP BY ALL")


def r19_top_k(spark, sf):
    best = _log_hits(spark, sf).groupBy("query_id", "uri").agg(F.max("score").alias("score"))
    return _round(retrieval.top(best, 5, C("score").desc(), C("uri")), "score")


_BEST = "(SELECT query AS query_id, uri, max(score) AS score FROM v_hits GROUP BY ALL)"
R19 = sql("v_hits", f"SELECT query_id, uri, round(score, 9) AS score FROM {_BEST} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, uri) <= 5")


def r22_packed_pages(spark, sf):
    best = _log_hits(spark, sf).groupBy("query_id", "uri").agg(F.max("score").alias("score"))
    sizes = views.daily(spark, sf).select("uri", F.length("text").alias("size"))
    return _round(retrieval.packed_pages(best.join(sizes, "uri"), "size").select("query_id", "uri", "score", C("rank").cast("long").alias("rank"), C("so_far").cast("long").alias("so_far")), "score")


R22 = sql(
    "v_hits v_daily",
    f"""WITH r AS (SELECT query_id, uri, score, row_number() OVER o AS rank, sum(length(text)) OVER (PARTITION BY query_id ORDER BY score DESC, uri ROWS UNBOUNDED PRECEDING) AS so_far FROM {_BEST} JOIN v_daily USING (uri) WINDOW o AS (PARTITION BY query_id ORDER BY score DESC, uri))
    SELECT query_id, uri, round(score, 9) AS score, rank, CAST(so_far AS BIGINT) AS so_far FROM r WHERE rank = 1 OR (rank <= 3 AND so_far <= 12000)""",
)


def r26_edge_markers(spark, sf):
    best = _log_hits(spark, sf).groupBy("query_id", "uri", "day").agg(F.max("score").alias("score"))
    return retrieval.edge_markers(best, "day").select("query_id", "uri", "marker")


R26 = sql("v_hits", "SELECT query_id, uri, CASE WHEN lo = hi THEN NULL WHEN uri = hi THEN 'latest' WHEN uri = lo THEN 'earliest' END AS marker FROM (SELECT DISTINCT query AS query_id, uri, min(uri) OVER (PARTITION BY query) AS lo, max(uri) OVER (PARTITION BY query) AS hi FROM v_hits)")


def r28_best_days(spark, sf):
    hits = _log_hits(spark, sf)
    return retrieval.best_days(hits, 4).groupBy("query_id", "day").agg(F.count("*").alias("n_hits"))


R28 = sql("v_hits", "WITH h AS (SELECT query AS query_id, regexp_extract(uri, '[0-9-]{10}') AS day, score FROM v_hits), d AS (SELECT query_id, day, max(score) AS best, count(*) AS n_hits FROM h GROUP BY ALL) SELECT query_id, day, n_hits FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY best DESC, day) <= 4")


# --- page graph


def w1_stubs(spark, sf):
    return graph.stubs(views.wiki(spark, sf)).groupBy("category").agg(F.count("*").alias("n"))


W1 = sql("v_wiki", "SELECT category, count(*) AS n FROM v_wiki WHERE len(sources) <= 1 GROUP BY category")


def w6_redirects(spark, sf):
    pages = views.wiki(spark, sf)
    chained = pages.withColumn("redirect_to", F.when((C("doc_id") % 7 < 3) & (C("doc_id") > 0), F.concat(F.lit("doc-"), (C("doc_id") - 1).cast("string"))))
    return graph.resolved_redirects(chained).withColumn("hops", C("hops").cast("long"))


W6 = "SELECT 'doc-' || doc_id AS slug, 'doc-' || greatest(doc_id - doc_id % 7 - 1, 0) AS target, doc_id % 7 + CASE WHEN doc_id < 7 THEN 0 ELSE 1 END AS hops FROM documents WHERE doc_id % 7 < 3 AND doc_id > 0"


def w7_broken_links(spark, sf):
    return graph.broken_links(views.wiki(spark, sf))


_LINKS = r"(SELECT DISTINCT slug, regexp_replace(unnest(regexp_extract_all(body, '\[\[([^\]|]+)', 1)), '^[A-Za-z0-9_-]+:', '') AS target FROM v_wiki)"
W7 = sql("v_wiki", f"SELECT slug, target FROM {_LINKS} WHERE target NOT IN (SELECT slug FROM v_wiki)")


def w8_orphans(spark, sf):
    return graph.orphans(views.wiki(spark, sf))


W8 = sql("v_wiki", f"SELECT slug FROM v_wiki WHERE redirect_to IS NULL AND slug NOT IN (SELECT target FROM {_LINKS} WHERE slug <> target)")


def w9_stale_pages(spark, sf):
    return graph.stale_pages(views.wiki(spark, sf), F.lit("2026-01-01").cast("date")).withColumn("days_old", C("days_old").cast("long"))


W9 = sql("v_wiki", "WITH n AS (SELECT slug, datediff('day', updated + CAST(doc_id % 5 AS INT), DATE '2026-01-01') AS days_old FROM v_wiki) SELECT * FROM n WHERE days_old > 90")


def w11_contradictions(spark, sf):
    return graph.mutual_contradictions(views.wiki(spark, sf))


W11 = sql("v_wiki", "SELECT x.slug AS a, y.slug AS b FROM v_wiki x JOIN v_wiki y ON x.contradicts = y.slug AND y.contradicts = x.slug WHERE x.slug < y.slug")


def w15_rename_candidates(spark, sf):
    """Of seven pages, the second to the fourth have the sources of the first, and the fifth has all but its last."""
    own = C("doc_id") - F.when(C("doc_id") % 7 < 5, C("doc_id") % 7).otherwise(0)
    n = F.when(C("doc_id") % 7 == 4, own % 5).otherwise(own % 5 + 1)
    sources = F.transform(F.sequence(F.lit(0), n.cast("int")), lambda k: views.memory_uri(views.day(own + k)))
    return _round(graph.rename_candidates(views.wiki(spark, sf).withColumn("sources", sources)), "jaccard")


W15 = sql(
    "v_wiki",
    """WITH o AS (SELECT slug, doc_id % 7 AS m, CASE WHEN doc_id % 7 < 5 THEN doc_id - doc_id % 7 ELSE doc_id END AS own FROM v_wiki WHERE redirect_to IS NULL),
    p AS (SELECT slug, list_transform(range(0, own % 5 + CASE m WHEN 4 THEN 1 ELSE 2 END), lambda k: 'memory/' || CAST(DATE '2024-01-01' + CAST(own + k AS INT) AS VARCHAR) || '.md') AS sources FROM o),
    g AS (SELECT slug, sources, min(slug) OVER (PARTITION BY sources) AS a FROM p WHERE len(sources) >= 3),
    e AS (SELECT slug, len(sources) AS n, unnest(sources) AS s FROM g WHERE slug = a), c AS (SELECT x.slug AS a, y.slug AS b, x.n AS n, y.n AS m, count(*) AS c FROM e x JOIN e y ON x.s = y.s AND x.slug < y.slug GROUP BY ALL)
    SELECT a, b, round(c / (n + m - c), 9) AS jaccard FROM c WHERE c / (n + m - c) >= 0.5 UNION ALL SELECT a, slug, 1.0 FROM g WHERE slug <> a""",
)


def w19_category_index(spark, sf):
    return graph.category_index(views.wiki(spark, sf))


W19 = sql("v_wiki", "SELECT category, count(*) AS n_pages, CAST(sum(len(sources)) AS BIGINT) AS n_sources FROM v_wiki WHERE redirect_to IS NULL GROUP BY category")


QUERIES = {f.__name__: f for f in (a1_weekly_work, a2_monthly_work, a3_combined_text, a4_salience, a5_uniform, a6_parent_vectors, a14_expected_pointers, a15_counts, r1_nearest, r2_bm25, r3_hybrid, r8_catalog, r11_expansion, r14_rerank, r18_merged, r19_top_k, r22_packed_pages, r26_edge_markers, r28_best_days, w1_stubs, w6_redirects, w7_broken_links, w8_orphans, w9_stale_pages, w11_contradictions, w15_rename_candidates, w19_category_index)}
ORACLE_SQL = {"a1_weekly_work": A1, "a2_monthly_work": A2, "a3_combined_text": A3, "a4_salience": A4, "a5_uniform": A5, "a6_parent_vectors": A6, "a14_expected_pointers": A14, "a15_counts": A15, "r1_nearest": R1, "r2_bm25": R2, "r3_hybrid": R3, "r8_catalog": R8, "r11_expansion": R11, "r14_rerank": R14, "r18_merged": R18, "r19_top_k": R19, "r22_packed_pages": R22, "r26_edge_markers": R26, "r28_best_days": R28, "w1_stubs": W1, "w6_redirects": W6, "w7_broken_links": W7, "w8_orphans": W8, "w9_stale_pages": W9, "w11_contradictions": W11, "w15_rename_candidates": W15, "w19_category_index": W19}
