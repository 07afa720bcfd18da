"""Rows between the steps grow with the input, not with its square; results that hold at any size."""

from pyspark.sql import functions as F

from tests.plan_rows import most_rows
from tidelog.functions import text
from tidelog.operators import evals, retrieval, signals


def test_values_of_many_days_and_pairs_do_not_multiply(spark):
    signatures = spark.range(1000).select((F.col("id") + 1).alias("day_number"), F.lit("v").alias("value"))
    pairs = spark.range(1000).select(F.col("id").alias("qa_id"), F.lit("v").alias("value"), (F.col("id") + 10).alias("last_day"))
    found = evals.freshest_mentions(signatures, pairs)
    assert most_rows(found) <= 2000
    rows = {r.qa_id: (r.day_number, r.value) for r in found.collect()}
    assert rows == {q: (1000, "v") for q in range(990)}


def drift(spark, entries, queries, shared=2):
    e = spark.createDataFrame(entries, "entry_id long, text string")
    q = spark.createDataFrame([(x,) for x in queries], "query string")
    return signals.drifting_entries(e, q, q, shared=shared, least_log=0)


def test_entries_and_queries_of_common_words_do_not_multiply(spark):
    entries = [(i, f"click topic{i % 2} own{i}") for i in range(400)]
    queries = [f"click topic0 asked{i}" for i in range(400)] + [f"topic1 other{i}" for i in range(400)]
    found = drift(spark, entries, queries)
    assert most_rows(found) <= 5000
    assert sorted(r.entry_id for r in found.collect()) == [i for i in range(400) if i % 2]


def test_drift_counts_shared_words_as_entries_repeat_them(spark):
    entries = [(1, "apple apple"), (2, "apple pear"), (3, "apple plum"), (4, "none here"), (5, ""), (6, "plum fig fig"), (7, "apple pear plum")]
    queries = ["apple pear", "apple pear", "plum", "fig grape", None]
    held = [{"apple", "pear"}, {"plum"}, {"fig", "grape"}]
    for shared in (1, 2, 3):
        wanted = [i for i, t in entries if all(sum(w in q for w in t.split()) < shared for q in held)]
        assert sorted(r.entry_id for r in drift(spark, entries, queries, shared).collect()) == wanted, shared


def test_catalog_copies_do_not_multiply(spark):
    entries = spark.range(600).select(F.col("id").alias("uri"), F.concat(F.lit("blue "), F.element_at(F.array(*map(F.lit, ("ring", "bolt", "bolt ring"))), (F.col("id") % 3 + 1).cast("int"))).alias("text"))
    queries = spark.range(300).select(F.col("id").alias("query_id"), F.lit("ring blue ring").alias("text"))
    found = retrieval.catalog_hits(queries, entries, text.catalog_tokens, 4)
    assert most_rows(found) <= 300 * 4
    assert {r.query_id: [x.uri for x in found.where(f"query_id = {r.query_id}").orderBy(F.col("score").desc(), "uri").collect()] for r in queries.limit(2).collect()} == {0: [0, 2, 3, 5], 1: [0, 2, 3, 5]}


def test_catalog_hits_are_the_best_of_all_scores(spark):
    words = ("red", "blue", "ring", "bolt", "plate")
    texts = [(i, " ".join(words[(i * k) % 5] for k in range(1, i % 4 + 1)), "x" if i % 7 == 0 else None) for i in range(60)] + [(60, None, None), (61, "", None)]
    entries = spark.createDataFrame(texts, "uri long, text string, redirect_to string")
    queries = entries.where("uri % 3 = 0").select(F.col("uri").alias("query_id"), "text")
    wanted = set()
    for q, t, _ in texts:
        if q % 3 or not t:
            continue
        asked = t.split()
        scored = [(-round(sum(w in e.split() for w in asked) / len(asked), 9), u) for u, e, gone in texts if e and not gone]
        wanted |= {(q, u, -s) for s, u in sorted(x for x in scored if x[0])[:4]}
    assert {(r.query_id, r.uri, r.score) for r in retrieval.catalog_hits(queries, entries, text.catalog_tokens, 4).collect()} == wanted


def test_days_of_arcs_need_no_window_and_no_broadcast(spark):
    rows = [(1, "project", 1, 40, 9), (2, "incident", 6, 30, 13), (3, "project", 6, 7, 6), (4, "project", 5, 130, None), (5, "project", 4, 3, 4), (6, None, 3, 25, 14)]
    arcs = spark.createDataFrame(rows, "arc_id int, type string, start_day int, end_day int, pinned_day int")
    found = evals.arc_days(arcs, "2024-01-01")
    wanted = set()
    for arc, kind, start, end, pin in rows:
        k, n, first = 2 if end - start + 1 < 15 else 3 if end - start + 1 < 100 else 5, 0, True
        for day in range(start, end + 1):
            counts = kind == "incident" or (day - 1) % 7 < 5
            if day in (start, end, pin):
                wanted.add((arc, day))
                n, first = (0, False) if counts else (n, first)
            elif counts:
                n += 1
                if (n - 1 if first else n) % k == 0:
                    wanted.add((arc, day))
    assert {(r.arc_id, r.day_number) for r in found.collect()} == wanted
    days = spark.range(1, 200).select(F.col("id").alias("day_number"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") - 1).cast("int")).alias("day_date"))
    assert "Window" not in found._jdf.queryExecution().toString()
    assert "Broadcast" not in evals.gap_days(days, found)._jdf.queryExecution().executedPlan().toString()


def test_only_chunks_that_are_shown_get_texts(spark):
    rows = [(q, f"u{u}", c, float(10 * u + c)) for q in range(3) for u in range(6) for c in range(3)]
    bare = spark.createDataFrame(rows, "query_id long, uri string, chunk_id int, score double").withColumns({"first_line": F.col("chunk_id") * 10, "last_line": F.col("chunk_id") * 10 + 9})
    asked = []

    def with_text(shown):
        asked.append(shown.count())
        return shown.withColumn("text", F.concat("uri", F.lit("."), F.col("chunk_id").cast("string")))

    found = retrieval.document_hits(bare, 2, 2, "|", with_text)
    assert asked == [3 * 3]
    wanted = {(q, u, t, n) for q in range(3) for u, t, n in (("u5", "u5.1|u5.2", 2), ("u4", "u4.2", 1))}
    assert {(r.query_id, r.uri, r.text, r.n_sections) for r in found.collect()} == wanted
    given = bare.withColumn("text", F.concat("uri", F.lit("."), F.col("chunk_id").cast("string")))
    assert {(r.query_id, r.uri, r.text, r.n_sections) for r in retrieval.document_hits(given, 2, 2, "|").collect()} == wanted
