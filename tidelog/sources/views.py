"""Views of the given tables in the shapes that the operators work on, for Spark and for DuckDB.

The tables hold no dated notes, search logs or graded questions, so the views derive them by
arithmetic on keys; both engines say the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "2024-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def day(n: Column) -> Column:
    return F.date_add(F.lit(EPOCH).cast("date"), n.cast("int"))


def memory_uri(date: Column) -> Column:
    return F.concat(F.lit("memory/"), date.cast("string"), F.lit(".md"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document a day: doc_id, mem_date, uri, text."""
    docs = table(spark, sf_dir, "documents")
    marker = F.when(F.col("doc_id") % 7 == 0, " We decided to use RedisCache.").when(F.col("doc_id") % 7 == 3, " Switched from api-v1-old. Corrected.").otherwise("")
    text = F.concat(F.lit("# session: s"), (F.col("doc_id") % 3).cast("string"), F.lit("\n\n"), F.col("text"), marker, F.lit(" Budget $"), (F.col("doc_id") % 50).cast("string"), F.lit("M."))
    return docs.select("doc_id", day(F.col("doc_id")).alias("mem_date"), memory_uri(day(F.col("doc_id"))).alias("uri"), text.alias("text"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three search results for each event: event_id, ts, j, query, uri, score. Every 2,000 events bring
    some hundred new queries and 200 new notes."""
    events = table(spark, sf_dir, "events").withColumn("j", F.explode(F.array(*map(F.lit, range(3)))))
    kind = F.col("user_id") % 20
    score = ((F.col("event_id") * 7 + F.col("j") * 13) % 100).cast("double") / 100 * F.when(kind < 3, 0.2).otherwise(1.0)
    block = F.floor(F.col("event_id") / 2000)
    uri = memory_uri(day((F.col("event_id") * (F.col("j") + 1)) % 200 + 200 * block))
    return events.select("event_id", "ts", "j", F.concat("event_type", F.lit(" "), (kind + 20 * block).cast("string")).alias("query"), uri.alias("uri"), score.alias("score"))


def search_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log entry for each event: event_id, ts, query, results, scores."""
    one = F.struct("j", "uri", "score")
    entries = hits(spark, sf_dir).groupBy("event_id", "ts", "query").agg(F.array_sort(F.collect_list(one)).alias("x"))
    return entries.select("event_id", "ts", "query", F.col("x.uri").alias("results"), F.col("x.score").alias("scores"))


RANGES = (30, 60, 90, 120, 180)

#: Names of the ten categories and three difficulties of graded questions, in the order of the grid.
CATEGORIES = ("plain-facts", "temporal-reasoning", "decision-tracking", "contradiction-resolution", "cross-reference", "recency-bias-resistance", "synthesis", "absent-facts", "group-session-attribution", "information-boundary")
DIFFICULTIES = ("easy", "medium", "hard")


def ranges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"{d}d", d) for d in RANGES], "range_label string, range_days int")


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(CATEGORIES)), "cat_order int, category string")


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded questions from benchmark items."""
    i = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(
        i.cast("long").alias("qa_id"),
        F.col("text").alias("question"),
        F.element_at(F.array(*map(F.lit, CATEGORIES)), (i % 10 + 1).cast("int")).alias("category"),
        F.element_at(F.array(*map(F.lit, DIFFICULTIES)), (i % 3 + 1).cast("int")).alias("difficulty"),
        F.array((i * 3 + 1).cast("int"), (i * 4 + 2).cast("int")).alias("relevant_days"),
        F.when(i % 8 == 0, i * 4 + 60).cast("int").alias("irrelevant_after"),
        F.when(i % 10 >= 8, F.element_at(F.array(*map(F.lit, ("refuse", "partial", "answer"))), (i % 3 + 1).cast("int"))).alias("expected_disclosure"),
    )


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict of each question at each range, with a second verdict for every fifth item."""
    i, d = F.col("qa_id"), F.col("range_days")
    second = lambda x: F.when(i % 5 == 0, x).cast("int")
    return (
        qa(spark, sf_dir)
        .crossJoin(F.broadcast(ranges(spark)))
        .select(
            (i % 2).cast("int").alias("persona"), "range_label", "range_days", "qa_id", "category", "difficulty", "relevant_days", "irrelevant_after", "expected_disclosure",
            ((i * 7 + d) % 4).cast("int").alias("correctness"), ((i + d) % 3).cast("int").alias("completeness"), F.when((i * d) % 11 == 0, 0).otherwise(1).cast("int").alias("hallucination"),
            second((i + d) % 4).alias("app_correctness"), second((i * 3 + d) % 3).alias("app_completeness"), second((i + 1) % 2).alias("app_hallucination"),
            ((i * 37 + d * 11) % 5000).cast("long").alias("latency_ms"),
        )
    )


def arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Story arcs from parts: arc_id, type, start_day, end_day, pinned_day. Every hundredth is long."""
    k, size = F.col("p_partkey"), F.col("p_size")
    # Some three arcs run on two days, at any scale.
    start, n = k * 17 + 1, size * F.when(k % 100 == 0, 40).otherwise(1)
    return table(spark, sf_dir, "part").select(k.cast("long").alias("arc_id"), F.when(size % 9 == 0, "incident").otherwise("project").alias("type"), start.cast("int").alias("start_day"), (start + n).cast("int").alias("end_day"), (start + F.floor(n / 2)).cast("int").alias("pinned_day"))


def wiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic pages from documents: slug, name, category, sources, redirect_to, contradicts, updated, body."""
    i = F.col("doc_id")
    source = lambda k: memory_uri(day(k))
    sources = F.transform(F.sequence(F.lit(0), (i % 5).cast("int")), lambda k: source(i + k))
    slug = lambda k: F.concat(F.lit("doc-"), k.cast("string"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", slug(i).alias("slug"), F.concat(F.lit("Doc "), i.cast("string")).alias("name"),
        F.element_at(F.array(*map(F.lit, WIKI_CATEGORIES)), (i % 5 + 1).cast("int")).alias("category"),
        sources.alias("sources"), F.when((i % 29 == 0) & (i > 0), slug(i - 1)).alias("redirect_to"),
        F.when(i % 31 == 0, slug(i + 1)).when(i % 31 == 1, slug(i - 1)).alias("contradicts"),
        day(i).alias("updated"), F.concat(F.lit("See [[doc-"), ((i * 3) % 1500).cast("string"), F.lit("]] and [[wiki:doc-"), ((i * 7 + 1) % 900).cast("string"), F.lit("|more]].")).alias("body"),
    )


#: The five page categories.
WIKI_CATEGORIES = ("entity", "concept", "project", "reference", "theme")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children with their week and month parents: vec_id, week, month. Four a day, and months of four
    weeks, so parents grow in number and not in size."""
    v = F.col("vec_id").cast("long")
    return table(spark, sf_dir, "embeddings").select(v.alias("vec_id"), F.floor(v / 28).alias("week"), F.floor(v / 112).alias("month"), "embedding")


def wide_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children with their week and month parents, as edges, but in 50 weeks and ten months whatever the
    size, so parents grow in size and not in number."""
    v = F.col("vec_id").cast("long")
    return table(spark, sf_dir, "embeddings").select(v.alias("vec_id"), (v % 50).alias("week"), (v % 10).alias("month"), "embedding")


def _list(values: tuple) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


#: The same views as DuckDB SQL.
SQL = {
    "v_daily": """SELECT doc_id, DATE '2024-01-01' + CAST(doc_id AS INT) AS mem_date, 'memory/' || CAST(DATE '2024-01-01' + CAST(doc_id AS INT) AS VARCHAR) || '.md' AS uri,
      '# session: s' || (doc_id % 3) || chr(10) || chr(10) || text || CASE doc_id % 7 WHEN 0 THEN ' We decided to use RedisCache.' WHEN 3 THEN ' Switched from api-v1-old. Corrected.' ELSE '' END || ' Budget $' || (doc_id % 50) || 'M.' AS text FROM documents""",
    "v_hits": """SELECT event_id, ts, j, event_type || ' ' || (user_id % 20 + 20 * (event_id // 2000)) AS query, 'memory/' || CAST(DATE '2024-01-01' + CAST((event_id * (j + 1)) % 200 + 200 * (event_id // 2000) AS INT) AS VARCHAR) || '.md' AS uri,
      CAST((event_id * 7 + j * 13) % 100 AS DOUBLE) / 100 * CASE WHEN user_id % 20 < 3 THEN 0.2 ELSE 1.0 END AS score FROM events, (SELECT unnest([0, 1, 2]) AS j)""",
    "v_ranges": "SELECT d || 'd' AS range_label, d AS range_days FROM (SELECT unnest([30, 60, 90, 120, 180]) AS d)",
    "v_categories": f"SELECT i - 1 AS cat_order, {_list(CATEGORIES)}[i] AS category FROM (SELECT unnest(range(1, 11)) AS i)",
    "v_qa": f"""SELECT item_id AS qa_id, text AS question, {_list(CATEGORIES)}[item_id % 10 + 1] AS category, {_list(DIFFICULTIES)}[item_id % 3 + 1] AS difficulty,
      [item_id * 3 + 1, item_id * 4 + 2] AS relevant_days, CASE WHEN item_id % 8 = 0 THEN item_id * 4 + 60 END AS irrelevant_after,
      CASE WHEN item_id % 10 >= 8 THEN ['refuse', 'partial', 'answer'][item_id % 3 + 1] END AS expected_disclosure FROM benchmark""",
    "v_eval": """SELECT qa_id % 2 AS persona, range_label, range_days, qa_id, category, difficulty, relevant_days, irrelevant_after, expected_disclosure,
      (qa_id * 7 + range_days) % 4 AS correctness, (qa_id + range_days) % 3 AS completeness, CASE WHEN (qa_id * range_days) % 11 = 0 THEN 0 ELSE 1 END AS hallucination,
      CASE WHEN qa_id % 5 = 0 THEN (qa_id + range_days) % 4 END AS app_correctness, CASE WHEN qa_id % 5 = 0 THEN (qa_id * 3 + range_days) % 3 END AS app_completeness, CASE WHEN qa_id % 5 = 0 THEN (qa_id + 1) % 2 END AS app_hallucination,
      (qa_id * 37 + range_days * 11) % 5000 AS latency_ms FROM v_qa, v_ranges""",
    "v_arcs": "SELECT p_partkey AS arc_id, CASE WHEN p_size % 9 = 0 THEN 'incident' ELSE 'project' END AS type, p_partkey * 17 + 1 AS start_day, p_partkey * 17 + 1 + n AS end_day, p_partkey * 17 + 1 + n // 2 AS pinned_day FROM (SELECT *, p_size * CASE WHEN p_partkey % 100 = 0 THEN 40 ELSE 1 END AS n FROM part)",
    "v_wiki": f"""SELECT doc_id, 'doc-' || doc_id AS slug, 'Doc ' || doc_id AS name, {_list(WIKI_CATEGORIES)}[doc_id % 5 + 1] AS category,
      list_transform(range(0, doc_id % 5 + 1), lambda k: 'memory/' || CAST(DATE '2024-01-01' + CAST(doc_id + k AS INT) AS VARCHAR) || '.md') AS sources,
      CASE WHEN doc_id % 29 = 0 AND doc_id > 0 THEN 'doc-' || (doc_id - 1) END AS redirect_to, CASE doc_id % 31 WHEN 0 THEN 'doc-' || (doc_id + 1) WHEN 1 THEN 'doc-' || (doc_id - 1) END AS contradicts,
      DATE '2024-01-01' + CAST(doc_id AS INT) AS updated, 'See [[doc-' || ((doc_id * 3) % 1500) || ']] and [[wiki:doc-' || ((doc_id * 7 + 1) % 900) || '|more]].' AS body FROM documents""",
    "v_edges": "SELECT vec_id, vec_id // 28 AS week, vec_id // 112 AS month, embedding FROM embeddings",
    "v_wide_edges": "SELECT vec_id, vec_id % 50 AS week, vec_id % 10 AS month, embedding FROM embeddings",
}
_NEEDS = {"v_eval": ("v_qa", "v_ranges")}


def sql(views: str, body: str) -> str:
    """DuckDB SQL over the named views."""
    names: list[str] = []
    for view in views.split():
        names += [x for x in (*_NEEDS.get(view, ()), view) if x not in names]
    given = "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names)
    body = body.strip()
    return f"{given},\n{body[5:]}" if body.startswith("WITH ") else f"{given}\n{body}"
