"""Hand-made edge rows for the operators."""

import collections
import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from tidelog.functions import dates, text
from tidelog.operators import evals, graph, retrieval, rollup, signals
from tidelog.sources import memory
from tidelog.streaming import jobs

D = datetime.date


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column).first()[0]


@pytest.mark.parametrize("day, week, month", [("2024-12-30", "2025-W01", "2025-01"), ("2027-01-03", "2026-W53", "2026-12"), ("2024-02-29", "2024-W09", "2024-02")])
def test_iso_weeks_at_year_ends(spark, day, week, month):
    d = F.col("d").cast("date")
    assert one(spark, dates.iso_week(d), d=day) == week and one(spark, dates.week_month(d), d=day) == month


@pytest.mark.parametrize("uri, expected", [("memory/2026-04-08.md", D(2026, 4, 8)), ("weekly/2026-W15.md", D(2026, 4, 9)), ("monthly/2026-04.md", D(2026, 4, 15)), ("notes/x.md", None), ("memory/2026-02-31.md", None), ("weekly/2020-W53", D(2020, 12, 31))])
def test_dates_of_uris(spark, uri, expected):
    assert one(spark, dates.date_of_uri(F.col("u")), u=uri) == expected


@pytest.mark.parametrize(
    "query, expected",
    [("what on April 8, 2026?", [(D(2026, 4, 8), 4)]), ("on 2026-04-08", [(D(2026, 4, 8), 4)]), ("in 2019-03 and Q2 2020", [(D(2019, 3, 15), 3), (D(2020, 5, 15), 2), (D(2019, 7, 1), 1)]), ("the 2023 plan", [(D(2023, 7, 1), 1)]), ("in 1800", []), ("February 30, 2024", [(D(2024, 7, 1), 1)]), ("", []), ("3 months ago", [(D(2026, 2, 28), 2)]), ("last week, last WEEK", [(D(2026, 5, 24), 2)])],
)
def test_temporal_references(spark, query, expected):
    queries = spark.createDataFrame([(1, query)], "query_id int, text string")
    found = [(r.date, r.specificity) for r in dates.temporal_references(queries, F.lit("2026-05-31").cast("date")).orderBy("pattern_no", "pos").collect()]
    assert found == expected


def test_best_reference_takes_the_first_of_equals(spark):
    queries = spark.createDataFrame([(1, "March 2024 or April 2024 in 2020")], "query_id int, text string")
    assert dates.best_reference(dates.temporal_references(queries, F.current_date())).first().date == D(2024, 3, 15)


def test_recency(spark):
    assert one(spark, dates.recency_cue(F.col("q")), q="the latest original") == "latest" and one(spark, dates.recency_cue(F.col("q")), q="originally proposed") == "earliest" and one(spark, dates.recency_cue(F.col("q")), q="known") is None
    boost = lambda d, cue: one(spark, dates.recency_boost(F.col("d").cast("date"), F.lit(cue).cast("string"), F.lit("2024-01-01").cast("date"), F.lit("2024-01-11").cast("date")), d=d)
    assert boost("2024-01-11", "latest") == pytest.approx(1.25) and boost("2030-01-01", "earliest") == pytest.approx(0.85) and boost("2024-01-05", None) == 1.0


def test_entities_and_markers(spark):
    s = "MyService uses a-b-c and @bob, HTTP 503 in ERR_CODE, ticket #42, Redis. We decided to go; picked it. Ünder AB"
    assert sorted(one(spark, text.light_entities(F.col("t")), t=s)) == ["a-b-c", "bob", "myservice"]
    assert {"a-b-c", "myservice", "http 503", "err_code", "redis"} <= set(one(spark, text.entities(F.col("t")), t=s))
    assert one(spark, text.decision_markers(F.col("t")), t=s) == 2 and one(spark, text.supersession_markers(F.col("t")), t="Corrected, and CORRECTED; retired") == 2
    assert one(spark, text.entities(F.col("t")), t="") == []


def test_query_decomposition_and_expansion(spark):
    split = lambda q: one(spark, text.decomposed_query(F.col("q")), q=q)
    assert split("What X did Jordan record, and what was the leverage ceiling?") == ["What X did Jordan record", "what was the leverage ceiling?"]
    assert split("What was the working valuation range?") is None and split("a, the b") is None
    assert one(spark, text.expanded_queries(F.col("q")), q="What did Alice decide about pricing tiers?") == ["What did Alice decide about pricing tiers?", "alice decide pricing tiers", "alice decide pricing tiers"]


def test_links_slugs_tags_and_chunks(spark):
    assert one(spark, text.links(F.col("b")), b="[[a-b]] [[wiki:c|see]] [[a-b]] [x]") == ["a-b", "c"]
    assert [one(spark, text.valid_slug(F.col("s")), s=s) for s in ("a-b1", "A", "a--b", "index", "")] == [True, False, False, False, False]
    assert one(spark, text.temporal_tag(F.col("t"), F.lit("2024-05-06")), t="x") == "[as of 2024-05-06]\n\nx" and one(spark, text.temporal_tag(F.col("t"), F.lit("bad")), t="x") == "x"
    chunks = spark.range(1).select(text.fixed_chunks(F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda x: x.cast("string")))).first()[0]
    assert [len(c) for c in chunks] == [512, 512, 104] and chunks[1][0] == "449"


def test_signals_of_small_logs(spark):
    log = spark.createDataFrame([(datetime.datetime(2024, 1, d), q, s) for d, q, s in [(1, " A ", [0.1]), (2, "a", []), (3, "b", [0.9]), (4, "c", [0.1])]], "ts timestamp, query string, scores array<double>")
    found = signals.gaps(log).collect()
    assert [(r.query, r.n) for r in found] == [("a", 2)] and found[0].score == pytest.approx(0.4 * 0.95)
    notes = spark.createDataFrame([(D(2024, 1, d), "BigName") for d in (1, 2, 3)] + [(D(2024, 1, 1), "OtherName")] * 5, "mem_date date, text string")
    assert [(r.entity, r.n_days) for r in signals.recurring_entities(notes, spark.createDataFrame([], "entity string")).collect()] == [("bigname", 3)]
    assert signals.hit_frequency(spark.createDataFrame([], "uri string, query string")).collect() == []


def test_salience_sums_to_one(spark):
    notes = spark.createDataFrame([(D(2024, 1, d), f"memory/{d}", t) for d, t in [(1, "x" * 40), (2, "We decided to use MyTool."), (3, ""), (8, "alone")]], "mem_date date, uri string, text string")
    weights = rollup.salience(notes, dates.iso_week(F.col("mem_date"))).collect()
    sums = {}
    for r in weights:
        sums[r.parent] = sums.get(r.parent, 0) + r.weight
    assert len(weights) == 4 and all(s == pytest.approx(1) for s in sums.values())


def test_parent_vectors_are_unit_length(spark):
    rows = spark.createDataFrame([(1, [3.0, 0.0], 1.0), (1, [0.0, 4.0], 1.0), (2, [0.0, 0.0], 1.0)], "p int, embedding array<double>, weight double")
    found = {r.parent: r.vector for r in rollup.weighted_vectors(rows, "p").collect()}
    assert found[1] == pytest.approx([0.6, 0.8]) and found[2] == [0.0, 0.0]


def test_patches(spark):
    entries = spark.createDataFrame([("a", "1", 1), ("b", "2", 2), ("c", "3", 3)], "title string, body string, ord int")
    patches = spark.createDataFrame([("a", "remove", None), ("b", "update", "22"), ("d", "add", "4")], "title string, op string, body string")
    assert [(r.title, r.body) for r in rollup.patched(entries, patches).collect()] == [("b", "22"), ("c", "3"), ("d", "4")]
    assert rollup.patched(entries, patches, budget=3).count() == 1


def test_nearest_keeps_the_smallest_uris_of_equal_scores(spark):
    rng = random.Random(5)
    copy, query = [rng.gauss(0, 1) for _ in range(64)], [rng.gauss(0, 1) for _ in range(64)]
    corpus = spark.createDataFrame([(f"u{k:03}", copy) for k in range(499, -1, -1)], "uri string, vector array<double>")
    queries = spark.createDataFrame([(1, query), (2, [-x for x in query])], "query_id long, vector array<double>")
    for parts in (1, 3):
        found = retrieval.nearest(queries, corpus.coalesce(1) if parts == 1 else corpus.repartition(parts), 3).collect()
        assert sorted((r.query_id, r.uri) for r in found) == [(q, u) for q in (1, 2) for u in ("u000", "u001", "u002")]


def test_nearest_and_merge(spark):
    corpus = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(10)], "uri long, vector array<double>")
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vector array<double>")
    assert [r.uri for r in retrieval.nearest(queries, corpus, 3).orderBy(F.col("score").desc()).collect()] == [9, 8, 7]
    assert retrieval.nearest(queries.where("false"), corpus, 3).count() == 0
    a, b = (spark.createDataFrame(x, "query_id int, uri string, score double") for x in ([(1, "x", 0.5), (1, "y", 0.1)], [(1, "x", 0.5), (1, "y", 0.2)]))
    assert sorted((r.uri, r.score, r.branch) for r in retrieval.merged(a, b).collect()) == [("x", 0.5, 0), ("y", 0.2, 1)]


def test_expansion_prefers_direct_hits_and_better_parents(spark):
    parents = spark.createDataFrame([(1, "p", 0.9), (1, "q", 0.5)], "query_id int, parent string, score double")
    pointers = spark.createDataFrame([("p", "a"), ("q", "a"), ("q", "b"), ("p", "c")], "parent string, child string")
    direct = spark.createDataFrame([(1, "c", 0.1)], "query_id int, uri string, score double")
    found = {r.uri: r.score for r in retrieval.expanded(parents, pointers, direct).collect()}
    assert found == {"a": pytest.approx(0.72), "b": pytest.approx(0.4), "c": 0.1}


def test_packing_keeps_the_first_page_whatever_its_size(spark):
    hits = spark.createDataFrame([(1, "a", 0.9, 20_000), (1, "b", 0.8, 10), (2, "a", 0.9, 5000), (2, "b", 0.8, 5000), (2, "c", 0.7, 5000)], "query_id int, uri string, score double, size int")
    assert sorted((r.query_id, r.uri) for r in retrieval.packed_pages(hits, "size").collect()) == [(1, "a"), (2, "a"), (2, "b")]


def test_quotas_sum_to_the_sample(spark):
    rng = random.Random(3)
    rows = [(30, f"c{c}", c, k * 10 + c) for c in range(5) for k in range(rng.randint(1, 9))]
    pairs = spark.createDataFrame(rows, "range_days int, category string, cat_order int, qa_id int").withColumn("is_new", F.lit(False))
    for size in (0, 1, 4, 7, len(rows), len(rows) + 5):
        found = evals.quotas(pairs, size).collect()
        assert sum(r.quota for r in found) == min(size, len(rows)) and all(r.quota <= r.n for r in found)
    assert evals.stratified_sample(pairs, 6).count() == 6


def test_filled_gaps_keep_scores_and_stop_at_the_last_range(spark):
    cells = spark.createDataFrame([("a", 1, True, 2.0), ("a", 2, True, None), ("a", 3, False, None), ("a", 4, True, None), ("b", 1, True, None), ("b", 2, True, 1.0)], "category string, range_days int, eligible boolean, score double")
    found = {(r.category, r.range_days): r.score for r in evals.filled_gaps(cells).collect()}
    assert found == {("a", 1): 2.0, ("a", 2): 2.0, ("a", 3): None, ("a", 4): None, ("b", 1): None, ("b", 2): 1.0}


def test_arc_days_equal_a_plain_walk(spark):
    rng = random.Random(8)
    arcs = [(k, rng.choice(["incident", "project"]), s := rng.randint(1, 60), e := s + rng.randint(0, 130), rng.randint(s, e)) for k in range(25)]
    found = {}
    for r in evals.arc_days(spark.createDataFrame(arcs, "arc_id long, type string, start_day int, end_day int, pinned_day int"), "2024-01-01").collect():
        found.setdefault(r.arc_id, set()).add(r.day_number)
    for k, kind, start, end, pinned_day in arcs:
        pinned, length = {start, end, pinned_day}, end - start + 1
        every = 2 if length < 15 else 3 if length < 100 else 5
        expected, since = set(pinned), every
        for day in range(start, end + 1):
            if (D(2024, 1, 1) + datetime.timedelta(day - 1)).weekday() >= 5 and kind != "incident":
                continue
            since = 0 if day in pinned else since + 1
            if since >= every:
                expected.add(day)
                since = 0
        assert found[k] == expected


def test_redirects_end_cycles_and_long_chains(spark):
    pages = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None), ("x", "y"), ("y", "x"), ("m", "gone")], "slug string, redirect_to string")
    assert {r.slug: r.target for r in graph.resolved_redirects(pages).collect()} == {"a": "c", "b": "c", "x": None, "y": None, "m": "gone"}


def test_notes_tree_and_front_matter(spark, tmp_path):
    (tmp_path / "weekly").mkdir()
    (tmp_path / "2024-01-02.md").write_text("---\ntype: daily\ntitle: \"A: b\"\ntype: again\n---\nbody\n---\nmore")
    (tmp_path / "weekly" / "2024-W01.md").write_text("no head")
    (tmp_path / "x.md").write_text("---\nbroken\n---\n")
    (tmp_path / "x.txt").write_text("other")
    found = {r.content_type: r for r in memory.read_tree(spark, str(tmp_path)).collect()}
    assert set(found) == {"daily", "weekly", "typed"} and found["daily"].front == {"title": "A: b", "type": "again"} and found["daily"].body == "body\n---\nmore" and found["weekly"].period == "2024-W01" and found["typed"].front == {}
    assert one(spark, memory.repaired_head(F.col("h")), h='a: b: c\nd: "e: f"\ng: h') == 'a: "b: c"\nd: "e: f"\ng: h'


def test_progress_files_and_model_output(spark, tmp_path):
    (tmp_path / "run-1.jsonl").write_text('{"type":"header"}\n{"type":"checkpoint","range":{"label":"30d","days":30},"overallScore":1.0}\nnot json\n{"type":"checkpoint","range":{"label":"60d","days":60},"overallScore":2.0}\n')
    (tmp_path / "run-2.jsonl").write_text('{"type":"checkpoint","range":{"label":"30d","days":30},"overallScore":3.0}\n')
    found = memory.stitched(memory.run_progress(spark, str(tmp_path))).orderBy("number").collect()
    assert [(r.label, r.overallScore, r.number) for r in found] == [("30d", 3.0, 1), ("60d", 2.0, 2)]
    output = spark.createDataFrame([(1, '{"calls":[{"tool":"memorySave","session":"s","content":"x"},{"tool":"other","content":"y"},{"tool":"memorySave","content":" "}]}'), (2, "broken [")], "id int, text string")
    assert [(r.id, r.content) for r in memory.tool_calls(output).collect()] == [(1, "x")]
    turns = memory.conversation_turns(spark.createDataFrame([(1, '[{"role":"user","content":"a"},{"role":"system","content":"b"}]'), (2, "plain")], "id int, text string"))
    assert sorted((r.id, r.role, r.content) for r in turns.collect()) == [(1, "user", "a"), (2, "user", "plain")]


def test_watched_notes_and_days(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("one")
    seen = []
    watch = lambda: jobs.watched_notes(spark, str(tmp_path / "in"), lambda batch, n: seen.append(sorted(r.text for r in batch.collect())), str(tmp_path / "c"), once=True).awaitTermination()
    watch()
    (tmp_path / "in" / "b.md").write_text("two")
    watch()
    assert seen == [["one"], ["two"]]
    spark.createDataFrame([(3, "c"), (1, "a"), (9, "z"), (1, "a")], "day_number int, text string").write.parquet(str(tmp_path / "days"))
    days = []
    jobs.ingested_days(spark.readStream.schema("day_number int, text string").parquet(str(tmp_path / "days")), lambda b, n: days.extend(r.day_number for r in b.collect()), F.lit(5), str(tmp_path / "d"), once=True).awaitTermination()
    assert days == [1, 3]


def test_heading_chunks(spark):
    s = "intro\n# A\ntext\n\n## B\n" + "p " * 40 + "\n\n" + "q " * 40 + "\n\nend"
    found = [(c.text[:5], c.start_line, c.end_line) for c in one(spark, text.heading_chunks(F.col("t"), 30), t=s)]
    assert found == [("intro", 0, 0), ("# A\nt", 1, 3), ("## B\n", 4, 6), ("q q q", 7, 9)]
    assert one(spark, text.heading_chunks(F.col("t")), t="") == [] and one(spark, text.heading_chunks(F.col("t")), t="\n\n") == []


def test_judge_output(spark):
    read = lambda t: tuple(one(spark, text.judge_scores(F.col("t")), t=t))
    assert read('```json\n{"correctness": 2.6, "completeness": 2, "hallucination": 1}\n```') == (3, 2, 1, None)
    assert read('{"correctness": 9, "completeness": 2, "hallucination": 1}') == (None, None, None, "bad output") and read("no json") == (None, None, None, "bad output")


PAGE = "slug string, body string, sources array<string>, updated date, redirect_to string"


def pages(spark, *rows):
    return spark.createDataFrame([(s, b, list(src), D(2024, 1, 1), None) for s, b, src in rows], PAGE)


def test_merges_follow_chains_and_leave_cycles_out(spark):
    p = pages(spark, ("a", "A", "1"), ("b", "B", "2"), ("c", "C", "31"), ("d", "D", "4"), ("x", "X", ""), ("y", "Y", ""))
    merges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "c"), ("x", "y"), ("y", "x"), ("c", "c"), ("a", "nowhere"), ("lost", "c")], "src string, dst string")
    found = {r.slug: r for r in graph.merged_pages(p, merges).collect()}
    assert len(found) == 6
    assert found["c"].body == "C\n\n<!-- merged from b -->\n\nB\n\n<!-- merged from d -->\n\nD\n\n<!-- merged from a -->\n\nA" and found["c"].sources == ["3", "1", "2", "4"]
    assert (found["a"].redirect_to, found["b"].redirect_to, found["a"].body) == ("b", "c", "") and found["x"].body == "X" and found["x"].redirect_to is None
    assert graph.merged_pages(p, merges.where("false")).count() == 6


def test_ops_on_one_page_apply_in_order(spark):
    schema = "slug string, seq int, op string, body string, sources array<string>, on date"
    on = D(2025, 1, 1)
    ops = spark.createDataFrame([("new", 2, "append", "second", ["s"], on), ("new", 1, "create", "first", ["r", "s"], on), ("new", 0, "append", "too early", None, on), ("old", 1, "append", "x", None, on), ("old", 2, "append", None, ["t"], on), ("none", 1, "append", "y", [], on)], schema)
    found, refused = graph.applied_ops(pages(spark, ("old", "O", "t"), ("same", "S", "")), ops)
    rows = {r.slug: (r.body, r.sources, r.updated) for r in found.collect()}
    assert rows == {"new": ("first\n\nsecond", ["r", "s"], on), "old": ("O\n\nx", ["t"], on), "same": ("S", [], D(2024, 1, 1))}
    assert sorted((r.slug, r.seq) for r in refused.collect()) == [("new", 0), ("none", 1)]


def test_create_of_a_page_that_is_there_is_refused(spark):
    on = D(2025, 1, 1)
    ops = spark.createDataFrame([("old", 1, "create", "again", ["t"], on), ("new", 1, "create", "first", ["r"], on), ("new", 2, "create", "second", ["s"], on)], "slug string, seq int, op string, body string, sources array<string>, on date")
    found, refused = graph.applied_ops(pages(spark, ("old", "O", "u")), ops)
    assert {r.slug: (r.body, r.sources) for r in found.collect()} == {"old": ("O", ["u"]), "new": ("first", ["r"])}
    assert sorted((r.slug, r.seq) for r in refused.collect()) == [("new", 2), ("old", 1)]


def test_pages_of_one_source_set_are_a_class(spark):
    sets = {"a": "123", "b": "321", "c": "1234", "d": "1234", "e": "789", "f": "12", "g": "7891"}
    rows = [(slug, list(s), None) for slug, s in sets.items()] + [("z", list("123"), "a")]
    found = graph.rename_candidates(spark.createDataFrame(rows, "slug string, sources array<string>, redirect_to string")).collect()
    assert sorted((r.a, r.b, round(r.jaccard, 6)) for r in found) == [("a", "b", 1.0), ("a", "c", 0.75), ("c", "d", 1.0), ("e", "g", 0.75)]


def test_renames_are_refused_with_a_reason(spark):
    renames = spark.createDataFrame([("a", "z"), ("b", "z"), ("c", "a"), ("c", "q"), ("lost", "l")], "slug string, new_slug string")
    found, refused = graph.renamed(pages(spark, ("a", "A", ""), ("b", "B", ""), ("c", "C", "")), renames)
    assert sorted((r.slug, r.new_slug, r.reason) for r in refused.collect()) == [("b", "z", "taken"), ("c", "a", "taken"), ("c", "q", "taken"), ("lost", "l", "no such page")]
    assert sorted((r.slug, r.redirect_to) for r in found.select("slug", "redirect_to").collect()) == [("a", "z"), ("b", None), ("c", None), ("z", None)]


def test_nearest_over_batches_leaves_odd_vectors_out(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    rows = [(k, [float(k % 5), 1.0]) for k in range(40)] + [(50, None), (51, [9.0, 9.0, 9.0])]
    corpus = spark.createDataFrame(rows, "uri int, vector array<double>")
    found = retrieval.nearest(spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id int, vector array<double>"), corpus, 4).orderBy("query_id", F.col("score").desc(), "uri").collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r.query_id, r.uri, r.score) for r in found] == [(1, 4, 4.0), (1, 9, 4.0), (1, 14, 4.0), (1, 19, 4.0)]
    assert retrieval.nearest(corpus.selectExpr("uri AS query_id", "vector").where("false"), corpus, 4).count() == 0


def test_keyword_search_equals_scores_of_all_documents(spark):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(40)]
    docs = [(k, " ".join(rng.choice(words[: rng.choice([3, 10, 40])]) for _ in range(rng.randint(0, 30)))) for k in range(300)]
    asked = [(k, " ".join(rng.sample(words, rng.randint(1, 8)))) for k in range(25)] + [(90, ""), (91, "unknown words"), (92, "w0 w1 w2")]
    found = retrieval.bm25(spark.createDataFrame(asked, "query_id int, text string"), spark.createDataFrame(docs, "uri int, text string"), 6).collect()
    tf = {i: collections.Counter(t.split()) for i, t in docs}
    df = collections.Counter(w for c in tf.values() for w in c)
    mean = sum(sum(c.values()) for c in tf.values()) / len(docs)
    for q, t in asked:
        scores = {}
        for i, c in tf.items():
            s = sum(math.log(1 + (300 - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in set(t.split()) if c[w])
            if s:
                scores[i] = round(s, 6)
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:6]
        assert {r.uri: r.score for r in found if r.query_id == q} == pytest.approx(dict(best), abs=2e-6)


def test_hooks_take_models(spark):
    texts = spark.createDataFrame([(1, "one two"), (2, ""), (3, None)], "uri int, text string")
    found = {r.uri: r.vector for r in retrieval.embedded(texts).collect()}
    assert sum(x * x for x in found[1]) == pytest.approx(1) and set(found[2]) == set(found[3]) == {0.0} and len(found[1]) == 64
    own = {r.uri: r.vector for r in retrieval.embedded(texts.where("text is not null"), load=lambda: lambda t: t.map(lambda x: [float(len(x))])).collect()}
    assert own == {1: [7.0], 2: [0.0]}
    pairs = spark.createDataFrame([(1, 1, "a b", "b c"), (1, 2, "", "x")], "query_id int, uri int, query string, text string")
    assert sorted(r.new_score for r in retrieval.overlap_scores(pairs).collect()) == [0.0, 0.5]
    assert sorted(r.new_score for r in retrieval.model_scores(pairs, lambda: lambda q, t: (q.str.len() + t.str.len()) * 1.0).collect()) == [1.0, 6.0]


@pytest.mark.parametrize(
    "output, expected",
    [('[{"a": 1}, {"b": "}"}, {"c', ['{"a": 1}', '{"b": "}"}']), ("none", []), ("[]", []), ('[ {"a": "\\"{"} ] tail {"x": 1}', ['{"a": "\\"{"}']), ('[1, {"a": 2}]', []), ('x [{"a": {"b": [{"c": 1}]}},', ['{"a": {"b": [{"c": 1}]}}']), (None, None)],
)
def test_salvage_of_broken_arrays(spark, output, expected):
    row = spark.createDataFrame([(output,)], "t string").select(text.salvaged_objects(F.col("t"))).first()[0]
    assert row == expected


def test_wisdom_entries_and_stub_bodies(spark):
    found = one(spark, text.wisdom_entries(F.col("t")), t="x\n**A** b\nc\n\n**B**\n**C**\nd")
    assert [(r.title, r.body) for r in found] == [("A", "c\n\n"), ("B", ""), ("C", "d\n")]
    stub = lambda c, **k: one(spark, text.stub_body(F.lit(c), *(F.lit(k.get(x)) for x in ("lede", "why", "how", "where", "when", "extra"))), t="")
    assert stub("concept", lede="L", why="w", how="h").body == "L\n\n**Why:** w\n\n**How to apply:** h\n" and stub("concept", lede="L", why="w").error == "why and how are needed"
    assert stub("theme", lede="L").error and stub("reference", lede="L", when="now").body == "L\n\n## When to use it\nnow\n"


def test_numbers_run_through_ranges(spark):
    rows = spark.createDataFrame([(k * 3,) for k in random.Random(2).sample(range(500), 500)], "qa_id long").repartition(7)
    assert [r.n for r in evals.numbered(rows, "qa_id", "n").orderBy("qa_id").collect()] == list(range(1, 501))
    assert evals.numbered(rows.where("false"), "qa_id", "n").count() == 0


def test_search_modes(spark):
    index = spark.createDataFrame([("n1", "daily", "own", [1.0, 0.0], D(2024, 1, 1)), ("p1", "wiki", "own", [0.9, 0.1], None), ("w#agg", "weekly", "agg", [0.5, 0.5], None), ("n2", "daily", "own", [0.0, 1.0], D(2024, 2, 1))], "uri string, content_type string, embedding_type string, vector array<double>, date date")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    pointers = spark.createDataFrame([("w", "n3")], "parent string, child string")
    uris = lambda mode: [r.uri for r in retrieval.search(queries, index, pointers, mode).orderBy(F.col("score").desc(), "uri").collect()]
    assert uris("hierarchical") == ["n1", "p1", "w#summary", "n3", "n2"] and uris("pages") == ["p1"] and uris("flat") == ["n1", "n2"] and "p1" not in uris("no_pages")
    with pytest.raises(ValueError):
        retrieval.search(queries, index, pointers, "other")


def test_models_load_once_a_task(spark, tmp_path):
    texts = spark.range(0, 400, 1, 3).selectExpr("id AS uri", "repeat('x', int(id % 5)) AS text", "id AS query_id", "'q' AS query")
    folder = str(tmp_path)

    def load():
        import os
        import uuid

        open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        return lambda *columns: columns[-1].str.len() * 1.0

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    assert retrieval.model_scores(texts, load).count() == 400
    total = retrieval.model_scores(texts, load).agg(F.sum("new_score")).first()[0]
    vectors = retrieval.embedded(texts, load=lambda: lambda t, one=load(): one(t).map(lambda x: [x])).agg(F.sum(F.col("vector")[0])).first()[0]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert total == vectors == 800.0
    # Three tasks for each of the runs, whatever the number of batches; a count needs no model.
    assert len(list(tmp_path.iterdir())) in (6, 7)


def test_points_within_ranges_of_all_lengths(spark):
    rng = random.Random(8)
    ranges = [(k, s, s + rng.choice([0, 0, 1, 3, 30, 1000, -1])) for k, s in enumerate(rng.choices(range(-40, 400), k=60))] + [(99, None, 5)]
    points = [(p,) for p in rng.sample(range(-50, 1500), 80)]
    found = evals.within(spark.createDataFrame(points, "p int"), spark.createDataFrame(ranges, "k int, a int, b int"), "p", "a", "b").collect()
    assert sorted((r.p, r.k) for r in found) == sorted((p, k) for (p,) in points for k, a, b in ranges if a is not None and a <= p <= b)
    assert evals.within(spark.createDataFrame(points, "p int"), spark.createDataFrame([], "k int, a int, b int"), "p", "a", "b").count() == 0


def test_settled_tables_are_forgotten(spark):
    import os

    from tidelog.sources import scratch

    scratch.forget(spark)
    found = scratch.settled(spark.range(5))
    folder = scratch._SETTLED[-1].removeprefix("file://")
    assert found.count() == 5 and os.path.isdir(folder)
    assert scratch.forget(spark) == 1 and not os.path.exists(folder)
