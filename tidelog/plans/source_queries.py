"""Queries of sources and streams over files that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.sources import memory, views
from tidelog.sources.scratch import scratch
from tidelog.sources.versions import VersionedTable
from tidelog.sources.views import sql
from tidelog.streaming import jobs

C = F.col


def s3_front_matter(spark, sf):
    head = F.concat(F.lit("---\ntype: daily\ntitle: 'Day "), C("doc_id").cast("string"), F.lit("'\nsource: memory:x\n---\n"), C("text"))
    d = views.daily(spark, sf).select("doc_id", head.alias("text"))
    front = memory.front_matter(C("text"))
    return d.select("doc_id", F.map_keys(front)[0].alias("first_key"), front["title"].alias("title"), front["source"].alias("source"), F.sha2(memory.body(C("text")), 256).alias("body_sha256"))


S3 = sql("v_daily", "SELECT doc_id, 'type' AS first_key, 'Day ' || doc_id AS title, 'memory:x' AS source, sha256(text) AS body_sha256 FROM v_daily")


def s9_log_round_trip(spark, sf):
    """The search log written as JSON lines and read again."""
    path = scratch(spark)
    views.search_log(spark, sf).select(F.date_trunc("second", "ts").alias("ts"), "query", "results", "scores", F.size("results").alias("topK"), F.size("results").alias("returned")).write.json(path)
    return memory.read_log(spark, path).groupBy("query").agg(F.count("*").alias("n"), F.round(F.sum(F.array_max("scores")), 6).alias("best"))


S9 = sql("v_hits", "SELECT query, count(*) AS n, round(sum(best), 6) AS best FROM (SELECT event_id, query, max(score) AS best FROM v_hits GROUP BY ALL) GROUP BY query")


def s11_rotated_log(spark, sf):
    path = scratch(spark)
    log = views.table(spark, sf, "orders").select(C("o_orderdate").cast("timestamp").alias("ts"), C("o_custkey").alias("query"))
    return memory.rotate_log(log, "1996-06", path)


S11 = "SELECT strftime(CAST(o_orderdate AS DATE), '%Y-%m') < '1996-06' AS archived, count(*) AS n FROM orders GROUP BY 1"


def s16_conversation_turns(spark, sf):
    turns = views.table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", C("text").alias("content")))).alias("x"))
    output = turns.select(C("conv_id").alias("id"), F.to_json("x").alias("text"))
    return memory.conversation_turns(output).groupBy("id").agg(F.count("*").alias("n_turns"), F.sum(F.length("content")).alias("n_chars"))


S16 = "SELECT conv_id AS id, count(*) AS n_turns, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id"


def s17_session_parts(spark, sf):
    days = views.daily(spark, sf).select(C("doc_id").alias("day"), F.concat(F.lit("lost\n"), C("text"), F.lit("\n# session: s9\n one \n# session: s9\ntwo")).alias("text"))
    return memory.session_parts(days).select("day", "session", F.sha2("text", 256).alias("text_sha256"))


S17 = r"""SELECT doc_id AS day, 's' || (doc_id % 3) AS session, sha256(trim(regexp_replace(text, '^# session: [^\n]*\n', ''), ' ' || chr(10))) AS text_sha256 FROM v_daily UNION ALL SELECT doc_id, 's9', sha256('two') FROM v_daily"""


def _changes(spark, sf):
    corpus = views.daily(spark, sf).select("uri", "text")
    return corpus, corpus.where(F.md5("uri") < "4").withColumn("text", F.lit("changed"))


def s18_upsert(spark, sf):
    corpus, changes = _changes(spark, sf)
    return memory.upserted(corpus, changes).select("uri", (C("text") == "changed").alias("changed"))


S18 = sql("v_daily", "SELECT uri, md5(uri) < '4' AS changed FROM v_daily")


def s18_corpus(spark, sf):
    """A corpus of two chunks a note after a deletion: what it holds of the notes, and how much."""
    corpus, gone = _changes(spark, sf)
    chunks = corpus.withColumn("chunk", F.explode(F.array(F.lit(0), F.lit(1))))
    left = memory.without(chunks, gone)
    stats = memory.corpus_stats(left).select(F.lit("all").alias("uri"), F.lit(True).alias("held"), "n_documents", "n_chunks")
    return memory.holds(left, corpus.select("uri")).select("uri", "held", F.lit(0).cast("long").alias("n_documents"), F.lit(0).cast("long").alias("n_chunks")).unionByName(stats)


S18C = sql("v_daily", "SELECT uri, md5(uri) >= '4' AS held, 0 AS n_documents, 0 AS n_chunks FROM v_daily UNION ALL SELECT 'all', true, count(*), 2 * count(*) FROM v_daily WHERE md5(uri) >= '4'")


def _tree(spark, sf):
    """The notes as the files of a tree, daily, weekly, monthly and typed ones: doc_id, uri, value."""
    d = views.daily(spark, sf)
    week = F.concat(F.date_format("mem_date", "yyyy"), F.lit("-W"), F.lpad((C("doc_id") % 50 + 1).cast("string"), 2, "0"))
    name = F.when(C("doc_id") % 4 == 0, F.concat(F.lit("weekly/"), week)).when(C("doc_id") % 4 == 1, F.concat(F.lit("monthly/"), F.date_format("mem_date", "yyyy-MM"))).when(C("doc_id") % 4 == 2, F.concat(F.lit("note-"), C("doc_id").cast("string"))).otherwise(C("mem_date").cast("string"))
    head = F.concat(F.lit("---\nid: "), C("doc_id").cast("string"), F.lit("\n---\n"))
    return d.select("doc_id", F.concat(F.lit("file:/memory/"), name, F.lit(".md")).alias("uri"), F.concat(head, "text").alias("value"))


def s1_tree(spark, sf):
    """All whole notes by the class that their paths give them."""
    notes = memory.notes_of(_tree(spark, sf))
    return notes.select(notes.front["id"].cast("long").alias("doc_id"), "content_type", "period", F.sha2("body", 256).alias("body_sha256"))


_NAMED = "SELECT doc_id, text, ['weekly', 'monthly', 'typed', 'daily'][doc_id % 4 + 1] AS content_type, CASE doc_id % 4 WHEN 0 THEN strftime(mem_date, '%Y-W') || lpad(CAST(doc_id % 50 + 1 AS VARCHAR), 2, '0') WHEN 1 THEN strftime(mem_date, '%Y-%m') WHEN 3 THEN CAST(mem_date AS VARCHAR) END AS period FROM v_daily"
S1 = sql("v_daily", f"SELECT doc_id, content_type, period, sha256(text) AS body_sha256 FROM ({_NAMED})")


def s2_periods(spark, sf):
    notes = memory.notes_of(_tree(spark, sf)).where("content_type = 'daily'")
    return memory.in_periods(notes, "2024-02-01", "2024-12-31").select("period")


S2 = sql("v_daily", f"SELECT period FROM ({_NAMED}) WHERE content_type = 'daily' AND period BETWEEN '2024-02-01' AND '2024-12-31'")


def s4_repaired_heads(spark, sf):
    head = F.concat(F.lit("name: Note: "), C("p_name"), F.lit("\nplain: "), C("p_type"), F.lit('\nquoted: "a: b"\nhash: x #'), C("p_size").cast("string"))
    return views.table(spark, sf, "part").select("p_partkey", memory.repaired_head(head).alias("head"))


S4 = """SELECT p_partkey, 'name: "Note: ' || p_name || '"' || chr(10) || 'plain: ' || p_type || chr(10) || 'quoted: "a: b"' || chr(10) || 'hash: "x #' || p_size || '"' AS head FROM part"""


def s5_pointers(spark, sf):
    """The notes of each week as its pointers, with salience for some of them."""
    uris = F.array_sort(F.collect_list("uri"))
    weeks = views.daily(spark, sf).groupBy(F.trunc("mem_date", "week").cast("string").alias("uri_")).agg(uris.alias("pointers"))
    parents = weeks.select(C("uri_").alias("uri"), "pointers", F.map_from_arrays(F.slice("pointers", 1, 2), F.transform(F.slice("pointers", 1, 2), lambda u: F.length(u) / 100)).alias("salience"))
    return memory.pointer_edges(parents).select("parent", "child", F.round("weight", 6).alias("weight"), C("pos").cast("long").alias("pos"))


S5 = sql("v_daily", "WITH e AS (SELECT CAST(CAST(date_trunc('week', mem_date) AS DATE) AS VARCHAR) AS parent, uri AS child, row_number() OVER (PARTITION BY date_trunc('week', mem_date) ORDER BY uri) - 1 AS pos FROM v_daily) SELECT parent, child, CASE WHEN pos < 2 THEN round(length(child) / 100, 6) END AS weight, pos FROM e")


def s6_day_texts(spark, sf):
    entries = views.table(spark, sf, "conversations").select(C("conv_id").alias("day"), C("turn").alias("seq"), "text")
    return memory.day_text(entries).select("day", F.sha2("text", 256).alias("text_sha256"))


S6 = "SELECT conv_id AS day, sha256(string_agg(text, chr(10) ORDER BY turn, text)) AS text_sha256 FROM conversations GROUP BY conv_id"


def s7_persona_days(spark, sf):
    d = views.daily(spark, sf)
    files = d.select(F.concat(F.lit("p/day-"), F.lpad(((C("doc_id") * 7) % 10_000).cast("string"), 4, "0"), F.lit(".md")).alias("uri"), C("text").alias("value"))
    found = memory.days_of(files, "2024-01-01")
    return found.select("day_number", C("day_date").cast("string").alias("day_date"), F.sha2("content", 256).alias("content_sha256"))


S7 = sql("v_daily", "SELECT doc_id * 7 % 10000 AS day_number, CAST(DATE '2024-01-01' + CAST(doc_id * 7 % 10000 - 1 AS INT) AS VARCHAR) AS day_date, sha256(text) AS content_sha256 FROM v_daily")


def s8_qa_round_trip(spark, sf):
    """Questions written as JSON lines, most without optional fields, and read again."""
    path = scratch(spark)
    q = views.qa(spark, sf)
    q.select(C("qa_id").cast("string").alias("id"), "question", F.when(C("qa_id") % 3 > 0, C("difficulty")).alias("difficulty"), F.when(C("qa_id") % 4 > 0, C("relevant_days")).alias("relevant_days"), "irrelevant_after").write.json(path)
    found = memory.read_qa(spark, path)
    return found.select(C("id").cast("long").alias("qa_id"), "question", "difficulty", F.size("relevant_days").cast("long").alias("n_days"), F.size("forbidden_sessions").cast("long").alias("n_forbidden"), "irrelevant_after", "answer")


S8 = sql("v_qa", "SELECT qa_id, question, CASE WHEN qa_id % 3 > 0 THEN difficulty ELSE 'medium' END AS difficulty, CASE WHEN qa_id % 4 > 0 THEN 2 ELSE 0 END AS n_days, 0 AS n_forbidden, irrelevant_after, NULL AS answer FROM v_qa")


def s10_appended_log(spark, sf):
    """Two appends of hits to a log, and what it holds."""
    path = scratch(spark)
    hits = views.hits(spark, sf).select(F.date_trunc("second", "ts").alias("ts"), F.concat("query", F.lit(" "), C("event_id").cast("string")).alias("query"), "uri", "score", C("j").alias("rank"))
    for part in (0, 1):
        memory.append_log(hits.where(F.pmod(F.length("query"), F.lit(2)) == part), path)
    return memory.read_log(spark, path).select("query", C("returned").cast("long").alias("returned"), F.array_join("results", ",").alias("results"), F.round(F.array_max("scores"), 3).alias("best"))


S10 = sql("v_hits", "SELECT query || ' ' || event_id AS query, 3 AS returned, string_agg(uri, ',' ORDER BY j) AS results, round(max(round(score, 3)), 3) AS best FROM v_hits GROUP BY event_id, query")


def _progress(spark, sf):
    """Progress files of two runs: a header, a checkpoint for each range, a summary; some lines are broken."""
    path = scratch(spark)
    v = views.verdicts(spark, sf)
    points = v.groupBy("persona", "range_label", "range_days").agg(F.count("*").alias("n"), F.avg((C("correctness") + C("completeness") + C("hallucination")).cast("double")).alias("score")).where("persona = 0 OR range_days > 60")
    rows = points.select("persona", F.to_json(F.struct(F.lit("checkpoint").alias("type"), F.struct(C("range_label").alias("label"), C("range_days").alias("days")).alias("range"), C("n").alias("questionsEvaluated"), C("score").alias("overallScore"), F.lit(0.1).alias("hallucinationRate"))).alias("value"))
    other = points.select("persona", F.explode(F.array(F.lit('{"type": "header"}'), F.lit('{"type": "checkpoint", "ra'))).alias("value")).distinct()
    for persona in (0, 1):
        rows.unionByName(other).where(C("persona") == persona).select("value").coalesce(1).write.text(f"{path}/run{persona}")
    return memory.run_progress(spark, f"{path}/*")


def s12_run_progress(spark, sf):
    found = _progress(spark, sf)
    return found.select(F.regexp_extract("file", r"/(run\d)/", 1).alias("run"), "label", "days", "questionsEvaluated", F.round("overallScore", 6).alias("overallScore"), F.size("categoryScores").cast("long").alias("n_categories"))


_POINTS = "(SELECT persona, range_label, range_days, count(*) AS n, avg(correctness + completeness + hallucination) AS score FROM v_eval WHERE persona = 0 OR range_days > 60 GROUP BY ALL)"
S12 = sql("v_eval", f"SELECT 'run' || persona AS run, range_label AS label, range_days AS days, n AS questionsEvaluated, round(score, 6) AS overallScore, 0 AS n_categories FROM {_POINTS}")


def s13_stitched(spark, sf):
    """The runs as one: of each range the last file's checkpoint, and the totals."""
    points = memory.stitched(_progress(spark, sf))
    one = points.select("label", "number", C("questionsEvaluated").alias("n"), F.round("overallScore", 6).alias("score"))
    return one.unionByName(memory.stitched_totals(points).select(F.lit("total").alias("label"), F.lit(0).alias("number"), C("n_questions").alias("n"), F.round("overall", 6).alias("score")))


S13 = sql("v_eval", f"WITH l AS (SELECT * FROM {_POINTS} QUALIFY row_number() OVER (PARTITION BY range_label ORDER BY persona DESC) = 1) SELECT range_label AS label, row_number() OVER (ORDER BY range_days) AS number, n, round(score, 6) AS score FROM l UNION ALL SELECT 'total', 0, CAST(sum(n) AS BIGINT), round(sum(score * n) / sum(n), 6) FROM l")


def s14_report_rows(spark, sf):
    """A text report for each supplier: two sections with a row for each of its numbers."""
    s = views.table(spark, sf, "supplier")
    k = C("s_suppkey").cast("string")
    text = F.concat(F.lit("Report\n== First ==\n  Score: "), k, F.lit(".5 %\nno row\n=== Second part ===\nRows : -"), k, F.lit("\nname: none\n"))
    lines = s.select(C("s_suppkey").alias("file"), F.posexplode(F.split(text, "\n")).alias("line_no", "text"))
    return memory.report_rows(lines).select("file", "section", "label", "value")


S14 = "SELECT s_suppkey AS file, 'First' AS section, 'Score' AS label, CAST(s_suppkey || '.5' AS DOUBLE) AS value FROM supplier UNION ALL SELECT s_suppkey, 'Second part', 'Rows', -CAST(s_suppkey AS DOUBLE) FROM supplier"


def s15_tool_calls(spark, sf):
    """Conversations as tool calls in a model's output; other tools and empty contents are left out."""
    c = views.table(spark, sf, "conversations")
    call = F.struct(F.when(C("turn") % 3 == 2, "other").otherwise("memorySave").alias("tool"), C("role").alias("session"), F.when(C("turn") % 4 == 3, " ").otherwise(C("text")).alias("content"))
    output = c.groupBy(C("conv_id").alias("id")).agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("turn", call.alias("c")))), lambda r: r["c"]).alias("calls"))).alias("text"))
    return memory.tool_calls(output).select("id", "session", F.sha2("content", 256).alias("content_sha256"))


S15 = "SELECT conv_id AS id, role AS session, sha256(text) AS content_sha256 FROM conversations WHERE turn % 3 <> 2 AND turn % 4 <> 3 AND trim(text) <> ''"


def s19_tagged_classes(spark, sf):
    """Notes of three classes as they go into the index: two of them with their date."""
    d = views.daily(spark, sf)
    kind = F.element_at(F.array(F.lit("daily"), F.lit("weekly"), F.lit("wisdom")), (C("doc_id") % 3 + 1).cast("int"))
    notes = d.select("uri", kind.alias("content_type"), "text", "mem_date")
    return memory.tagged(notes, C("mem_date"), daily=True, weekly=True, wisdom=False).select("uri", F.sha2("text", 256).alias("text_sha256"))


S19T = sql("v_daily", "SELECT uri, sha256(CASE WHEN doc_id % 3 < 2 THEN '[as of ' || CAST(mem_date AS VARCHAR) || ']' || chr(10) || chr(10) ELSE '' END || text) AS text_sha256 FROM v_daily")


def s20_result_sinks(spark, sf):
    """The cells of a run written for others, and the summary read back."""
    folder = scratch(spark)
    v = views.verdicts(spark, sf)
    memory.write_results(v.groupBy("category", "range_label").agg(F.avg(C("correctness").cast("double")).alias("score"), F.count("*").alias("n")), folder)
    cells = spark.read.schema("category string, range_label string, score double, n long").json(f"{folder}/cells").groupBy("category").agg(F.count("*").alias("n_cells"))
    return spark.read.parquet(f"{folder}/summary").join(cells, "category").select("category", "n_ranges", "n_questions", F.round("mean_score", 6).alias("mean_score"), "n_cells")


S20 = sql("v_eval", "SELECT category, count(DISTINCT range_label) AS n_ranges, count(*) AS n_questions, round(avg(correctness), 6) AS mean_score, count(DISTINCT range_label) AS n_cells FROM v_eval GROUP BY category")


def s19_sync(spark, sf):
    files = views.daily(spark, sf).select("doc_id", "uri", "text")
    corpus = files.where("doc_id % 6 <> 0").select("uri", F.xxhash64(F.when(C("doc_id") % 6 == 1, "old").otherwise(C("text"))).alias("hash"))
    found = memory.synced(corpus, files.where("doc_id % 6 <> 5").select("uri", "text"))
    return found["changed"].select("uri", F.lit("changed").alias("what")).unionByName(found["removed"].select("uri", F.lit("removed").alias("what")))


S19 = sql("v_daily", "SELECT uri, CASE WHEN doc_id % 6 = 5 THEN 'removed' ELSE 'changed' END AS what FROM v_daily WHERE doc_id % 6 IN (0, 1, 5)")


def x2_captured_log(spark, sf):
    """The events as a stream of searches, captured to a table by day, and counted from it."""
    folder = scratch(spark)
    views.search_log(spark, sf).select("ts", "query", "results").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("ts timestamp, query string, results array<string>").parquet(f"{folder}/in")
    jobs.captured_log(stream, f"{folder}/out", f"{folder}/checkpoint", once=True).awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy(C("day").cast("string").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("query").alias("n_queries"))


X2 = "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, count(DISTINCT event_type || ' ' || (user_id % 20 + 20 * (event_id // 2000))) AS n_queries FROM events GROUP BY 1"


def x5_rolling_hits(spark, sf):
    """Rolling 30-day hits over the stream of hits; a late row is dropped by the watermark."""
    folder = scratch(spark)
    views.hits(spark, sf).select("ts", "uri", "query").write.parquet(f"{folder}/in")
    # A last row far ahead lets the watermark pass and closes every window.
    ahead = views.hits(spark, sf).agg(F.max("ts").alias("ts")).select((C("ts") + F.expr("INTERVAL 60 DAYS")).alias("ts"), F.lit("end").alias("uri"), F.lit("end").alias("query"))
    stream = spark.readStream.schema("ts timestamp, uri string, query string").parquet(f"{folder}/in")
    jobs.rolling_hits(stream, f"{folder}/out", f"{folder}/checkpoint", once=True).awaitTermination()
    ahead.write.mode("append").parquet(f"{folder}/in")
    jobs.rolling_hits(stream, f"{folder}/out", f"{folder}/checkpoint", once=True).awaitTermination()
    return spark.read.schema("start timestamp, end timestamp, uri string, n_hits long, n_queries long").parquet(f"{folder}/out").select(C("start").cast("date").cast("string").alias("start"), "uri", "n_hits", "n_queries")


X5 = sql("v_hits", "WITH w AS (SELECT CAST(ts AS DATE) - CAST(k AS INT) AS start, uri, query FROM v_hits, (SELECT unnest(range(0, 30)) AS k)) SELECT CAST(start AS VARCHAR) AS start, uri, count(*) AS n_hits, count(DISTINCT query) AS n_queries FROM w GROUP BY ALL")


def x1_watched_notes(spark, sf):
    """Notes that come in two turns, some as files of their own and the others in bundles; each batch is written
    twice as after a failure, and changed notes come again. The second turn finds the state from its folder."""
    folder = scratch(spark)
    d = views.daily(spark, sf).select("uri", "text")
    # One note in 64, by its uri.
    single = C("text").isNotNull() & (F.substring(F.md5("uri"), -2, 2) < "04")

    def notes():
        return VersionedTable(spark, f"{folder}/notes", "uri string, text string, modified timestamp", "uri", "modified")

    def upsert(batch, batch_id):
        file = C("uri").contains("/files/")
        uri = F.when(file, F.regexp_extract("text", r"\A([^\n]*)\n", 1)).otherwise(C("uri"))
        own = batch.select(uri.alias("uri"), F.when(file, F.regexp_replace("text", r"\A[^\n]*\n", "")).otherwise(C("text")).alias("text"), "modified")
        for _ in range(2):
            notes().write(own, batch_id)

    changed = d.where(F.md5("uri") < "4").withColumn("text", F.concat("text", F.lit(" again")))
    for turn in (d, changed):
        # In a file of its own, the first line is the note's name.
        turn.where(single).select(F.concat("uri", F.lit("\n"), "text").alias("value")).write.mode("append").option("maxRecordsPerFile", 1).text(f"{folder}/files")
        turn.where(~single).write.mode("append").json(f"{folder}/bundles")
        jobs.watched_notes(spark, f"{folder}/files", upsert, f"{folder}/checkpoint", once=True, bundles=f"{folder}/bundles").awaitTermination()
    notes().compact()
    return notes().read().select("uri", F.sha2(F.btrim("text", F.lit("\n")), 256).alias("text_sha256"))


X1 = sql("v_daily", "SELECT uri, sha256(trim(text || CASE WHEN md5(uri) < '4' THEN ' again' ELSE '' END, chr(10))) AS text_sha256 FROM v_daily")


def x3_signal_pass(spark, sf):
    """Two scheduled passes over a log that grows between them: each sees what is new."""
    folder = scratch(spark)
    log = views.search_log(spark, sf).select("ts", "query", "scores")

    def collect(batch, batch_id):
        batch.groupBy("query").agg(F.count("*").alias("n"), F.sum(F.array_max("scores")).alias("best")).withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(f"{folder}/out")

    for part in (0, 1):
        log.where(F.pmod(F.dayofyear("ts"), F.lit(2)) == part).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("ts timestamp, query string, scores array<double>").parquet(f"{folder}/in")
        jobs.signal_pass(stream, collect, f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("query").agg(F.sum("n").alias("n"), F.round(F.sum("best"), 6).alias("best"), F.countDistinct("batch").alias("n_passes"))


X3 = sql("v_hits", "WITH e AS (SELECT event_id, ts, query, max(score) AS best FROM v_hits GROUP BY ALL) SELECT query, CAST(count(*) AS BIGINT) AS n, round(sum(best), 6) AS best, count(DISTINCT dayofyear(ts) % 2) AS n_passes FROM e GROUP BY query")


def x4_ingested_days(spark, sf):
    """The days up to day 150 as a stream, each once, in order within a batch."""
    folder = scratch(spark)
    d = views.daily(spark, sf).select((C("doc_id") + 1).alias("day_number"), F.length("text").alias("size"))
    d.unionByName(d.where("day_number % 5 = 0")).write.parquet(f"{folder}/in")

    def ingest(batch, batch_id):
        batch.write.mode("append").parquet(f"{folder}/out")

    stream = spark.readStream.schema("day_number long, size int").parquet(f"{folder}/in")
    jobs.ingested_days(stream, ingest, F.lit(150), f"{folder}/checkpoint", once=True).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("day_number", C("size").cast("long").alias("size"))


X4 = sql("v_daily", "SELECT doc_id + 1 AS day_number, length(text) AS size FROM v_daily WHERE doc_id < 150")


def x5_rolling_gaps(spark, sf):
    """Rolling 30-day counts of queries and their mean best score."""
    folder = scratch(spark)
    log = views.search_log(spark, sf).select("ts", "query", "scores")
    log.write.parquet(f"{folder}/in")
    ahead = log.agg(F.max("ts").alias("ts")).select((C("ts") + F.expr("INTERVAL 60 DAYS")).alias("ts"), F.lit("end").alias("query"), F.array(F.lit(0.0)).alias("scores"))
    stream = spark.readStream.schema("ts timestamp, query string, scores array<double>").parquet(f"{folder}/in")
    jobs.rolling_gaps(stream, f"{folder}/out", f"{folder}/checkpoint", once=True).awaitTermination()
    ahead.write.mode("append").parquet(f"{folder}/in")
    jobs.rolling_gaps(stream, f"{folder}/out", f"{folder}/checkpoint", once=True).awaitTermination()
    return spark.read.schema("start timestamp, query string, n long, mean_best double").parquet(f"{folder}/out").select(C("start").cast("date").cast("string").alias("start"), "query", "n", F.round(C("mean_best") * C("n"), 4).alias("sum_best"))


X5G = sql("v_hits", "WITH e AS (SELECT event_id, ts, lower(trim(query)) AS query, max(score) AS best FROM v_hits GROUP BY ALL), w AS (SELECT CAST(ts AS DATE) - CAST(k AS INT) AS start, query, best FROM e, (SELECT unnest(range(0, 30)) AS k)) SELECT CAST(start AS VARCHAR) AS start, query, count(*) AS n, round(sum(best), 4) AS sum_best FROM w GROUP BY ALL")

QUERIES = {f.__name__: f for f in (s1_tree, s2_periods, s3_front_matter, s4_repaired_heads, s5_pointers, s6_day_texts, s7_persona_days, s8_qa_round_trip, s9_log_round_trip, s10_appended_log, s11_rotated_log, s12_run_progress, s13_stitched, s14_report_rows, s15_tool_calls, s16_conversation_turns, s17_session_parts, s18_upsert, s18_corpus, s19_sync, s19_tagged_classes, s20_result_sinks, x1_watched_notes, x2_captured_log, x3_signal_pass, x4_ingested_days, x5_rolling_hits, x5_rolling_gaps)}
ORACLE_SQL = {"s1_tree": S1, "s2_periods": S2, "s3_front_matter": S3, "s4_repaired_heads": S4, "s5_pointers": S5, "s6_day_texts": S6, "s7_persona_days": S7, "s8_qa_round_trip": S8, "s9_log_round_trip": S9, "s10_appended_log": S10, "s11_rotated_log": S11, "s12_run_progress": S12, "s13_stitched": S13, "s14_report_rows": S14, "s15_tool_calls": S15, "s16_conversation_turns": S16, "s17_session_parts": sql("v_daily", S17), "s18_upsert": S18, "s18_corpus": S18C, "s19_sync": S19, "s19_tagged_classes": S19T, "s20_result_sinks": S20, "x1_watched_notes": X1, "x2_captured_log": X2, "x3_signal_pass": X3, "x4_ingested_days": X4, "x5_rolling_hits": X5, "x5_rolling_gaps": X5G}
