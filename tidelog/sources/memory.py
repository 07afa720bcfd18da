"""Reading and writing memory trees, logs, reports and model output as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.functions.text import temporal_tag

C = F.col

_HEAD = r"(?s)\A---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)"

LOG_SCHEMA = "ts timestamp, query string, results array<string>, scores array<double>, topK int, returned int"
PROGRESS_SCHEMA = "type string, timestamp timestamp, personaId string, range struct<label: string, days: bigint>, questionsEvaluated int, overallScore double, hallucinationRate double, categoryScores array<struct<category: string, meanScore: double, questionCount: int, eligibleCount: int>>, durationMs bigint, appellateInvocations int"


def content_type(path: Column) -> Column:
    """Class of a note by its file name."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name == "WISDOM.md", "wisdom").when(name.rlike(r"^\d{4}-\d{2}-\d{2}\.md$"), "daily").when(name.rlike(r"^\d{4}-W\d{2}\.md$"), "weekly").when(name.rlike(r"^\d{4}-\d{2}\.md$"), "monthly").when(name.endswith(".md"), "typed")


def front_matter(text: Column) -> Column:
    """Flat keys of the head between two `---` lines; an empty map where there is none."""
    lines = F.split(F.regexp_extract(text, _HEAD, 1), r"\r?\n")
    pairs = F.filter(lines, lambda x: x.rlike(r"^[A-Za-z_][\w-]*\s*:"))
    entry = lambda x: F.struct(F.regexp_extract(x, r"^([\w-]+)", 1).alias("key"), F.trim(F.regexp_replace(F.regexp_replace(x, r"^[\w-]+\s*:", ""), r"^\s*[\"'](.*)[\"']\s*$", "$1")).alias("value"))
    keys = F.transform(pairs, lambda x: entry(x)["key"])
    # Of repeated keys the last one counts.
    last = F.filter(F.transform(pairs, lambda x, i: F.struct(i.alias("i"), entry(x).alias("e"))), lambda r: F.array_position(F.reverse(keys), r["e"]["key"]) == F.size(keys) - r["i"])
    return F.map_from_entries(F.transform(last, lambda r: r["e"]))


def body(text: Column) -> Column:
    return F.regexp_replace(text, _HEAD, "")


def repaired_head(head: Column) -> Column:
    """Quotes plain values that hold `: ` or ` #`, so that the head can be parsed."""
    risky = lambda x: x.rlike(r"^[\w-]+: +[^\"'\[{|>].*(?:: | #)")
    quoted = lambda x: F.concat(F.regexp_extract(x, r"^([\w-]+: +)", 1), F.lit('"'), F.replace(F.regexp_replace(x, r"^[\w-]+: +", ""), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.array_join(F.transform(F.split(head, "\n"), lambda x: F.when(risky(x), quoted(x)).otherwise(x)), "\n")


def read_tree(spark: SparkSession, folder: str) -> DataFrame:
    """All notes below a folder: uri, content_type, period, front, body."""
    return notes_of(spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select("value", C("_metadata.file_path").alias("uri")))


def notes_of(files: DataFrame) -> DataFrame:
    """files(uri, value) as notes, by the class that their names give them; other files are left out."""
    kind = content_type(C("uri"))
    period = F.when(kind.isin("daily", "weekly", "monthly"), F.regexp_extract("uri", r"([^/]+)\.md$", 1))
    return files.select("uri", kind.alias("content_type"), period.alias("period"), front_matter(C("value")).alias("front"), body(C("value")).alias("body")).where("content_type IS NOT NULL")


def in_periods(notes: DataFrame, after: str, before: str) -> DataFrame:
    """Notes of periods between both ends, which are included."""
    return notes.where(C("period").between(after, before))


def pointer_edges(parents: DataFrame) -> DataFrame:
    """parents(uri, pointers, salience map) as edges: parent, child, weight, pos."""
    return parents.select(C("uri").alias("parent"), "salience", F.posexplode("pointers").alias("pos", "child")).select("parent", "child", F.try_element_at("salience", C("child")).alias("weight"), "pos")


def day_text(entries: DataFrame) -> DataFrame:
    """Appended entries(day, seq, text) of each day joined in order."""
    return entries.groupBy("day").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda r: r["text"]), "\n").alias("text"))


def persona_days(spark: SparkSession, folder: str, epoch: str) -> DataFrame:
    """The days of a persona's folder: day_number, day_date, content."""
    return days_of(spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select("value", C("_metadata.file_path").alias("uri")), epoch)


def days_of(files: DataFrame, epoch: str) -> DataFrame:
    """files(uri, value) named day-NNNN; day 1 is the epoch."""
    number = F.regexp_extract("uri", r"day-(\d{4})", 1).try_cast("int")
    return files.select(number.alias("day_number"), C("value").alias("content")).where("day_number IS NOT NULL").withColumn("day_date", F.date_add(F.lit(epoch).cast("date"), C("day_number") - 1))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON-lines log; lines that can't be read are left out."""
    return spark.read.schema(LOG_SCHEMA).option("mode", "DROPMALFORMED").json(path).where("query IS NOT NULL")


def append_log(hits: DataFrame, path: str) -> None:
    """Appends one row a query of hits(ts, query, uri, score, rank), scores to three decimals."""
    one = F.struct("rank", "uri", F.round("score", 3).alias("score"))
    rows = hits.groupBy("ts", "query").agg(F.array_sort(F.collect_list(one)).alias("x")).select("ts", "query", C("x.uri").alias("results"), C("x.score").alias("scores"), F.size("x").alias("returned"))
    rows.write.mode("append").json(path)


def rotate_log(log: DataFrame, current: str, archive: str) -> DataFrame:
    """Writes the rows of past months to one folder a month; reports how many were moved and how many
    remain. `current` is the running month, `yyyy-MM`."""
    dated = log.withColumn("year_month", F.date_format("ts", "yyyy-MM"))
    dated.where(C("year_month") < current).write.mode("append").partitionBy("year_month").parquet(archive)
    return dated.groupBy((C("year_month") < current).alias("archived")).agg(F.count("*").alias("n"))


def run_progress(spark: SparkSession, path: str) -> DataFrame:
    """Checkpoint rows of progress files; the file's name says which run they come from."""
    rows = spark.read.schema(PROGRESS_SCHEMA).json(path).withColumn("file", C("_metadata.file_path"))
    return rows.where("type = 'checkpoint'").select("file", C("range.label").alias("label"), C("range.days").alias("days"), "questionsEvaluated", "overallScore", "hallucinationRate", F.coalesce("categoryScores", F.array().cast("array<struct<category: string, meanScore: double, questionCount: int, eligibleCount: int>>")).alias("categoryScores"))


def stitched(progress: DataFrame) -> DataFrame:
    """Checkpoints of several files: the last file wins for each label; numbered in order of days.
    There are a few dozen labels, so one window numbers them."""
    newest = progress.withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy(C("file").desc()))).where("rn = 1").drop("rn")
    return newest.withColumn("number", F.row_number().over(Window.orderBy("days")))


def stitched_totals(checkpoints: DataFrame) -> DataFrame:
    """The totals of a run from its stitched checkpoints: mean scores weighted by questions."""
    weighted = lambda c: F.sum(C(c) * C("questionsEvaluated")) / F.sum("questionsEvaluated")
    return checkpoints.agg(F.count("*").alias("n_checkpoints"), F.sum("questionsEvaluated").alias("n_questions"), weighted("overallScore").alias("overall"), weighted("hallucinationRate").alias("hallucination_rate"))


QA_SCHEMA = "id string, question string, answer string, category string, difficulty string, relevant_days array<int>, irrelevant_after int, forbidden_sessions array<string>, expected_disclosure string"


def read_qa(spark: SparkSession, path: str) -> DataFrame:
    """Graded questions, one JSON object a line; what a row lacks is null, lists are empty."""
    rows = spark.read.schema(QA_SCHEMA).json(path).where("id IS NOT NULL")
    return rows.withColumns({"relevant_days": F.coalesce("relevant_days", F.array().cast("array<int>")), "forbidden_sessions": F.coalesce("forbidden_sessions", F.array().cast("array<string>")), "difficulty": F.coalesce("difficulty", F.lit("medium"))})


def report_rows(lines: DataFrame) -> DataFrame:
    """Rows of text reports: lines(file, line_no, text). A line `== name ==` heads a section, a line
    `label: value` is a row of it; other lines say nothing. Headers are carried down within a file."""
    head = F.regexp_extract("text", r"^==+\s*(.*?)\s*==+\s*$", 1)
    own = lines.withColumn("head", F.when(head != "", head))
    section = F.last("head", ignorenulls=True).over(Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    label, value = F.regexp_extract("text", r"^\s*([^:=]+?)\s*:\s*(-?\d+(?:\.\d+)?)\s*%?\s*$", 1), F.regexp_extract("text", r"^\s*([^:=]+?)\s*:\s*(-?\d+(?:\.\d+)?)\s*%?\s*$", 2)
    return own.select("file", "line_no", section.alias("section"), label.alias("label"), value.try_cast("double").alias("value")).where("label <> ''")


def write_results(cells: DataFrame, folder: str) -> None:
    """A run's results for others: the cells(category, range_label, score, n) as JSON lines, and one summary
    row for each category as Parquet."""
    cells.write.mode("overwrite").json(f"{folder}/cells")
    summary = cells.groupBy("category").agg(F.count("*").alias("n_ranges"), F.sum("n").alias("n_questions"), (F.sum(C("score") * C("n")) / F.sum("n")).alias("mean_score"))
    summary.write.mode("overwrite").parquet(f"{folder}/summary")


def tool_calls(output: DataFrame) -> DataFrame:
    """Calls in model output(id, text): id, pos, session, content; others than memorySave are left out."""
    calls = F.from_json("text", "struct<calls: array<struct<tool: string, session: string, content: string>>>")["calls"]
    each = output.select("id", F.posexplode(calls).alias("pos", "c"))
    return each.where("c.tool = 'memorySave' AND trim(c.content) <> ''").select("id", "pos", C("c.session").alias("session"), C("c.content").alias("content"))


def conversation_turns(output: DataFrame) -> DataFrame:
    """User and assistant turns of model output(id, text); output that is no list is one user turn."""
    turns = F.from_json("text", "array<struct<role: string, content: string>>")
    fallback = F.array(F.struct(F.lit("user").alias("role"), C("text").alias("content")))
    return output.select("id", F.posexplode(F.coalesce(turns, fallback)).alias("pos", "t")).where("t.role IN ('user', 'assistant')").select("id", "pos", "t.role", "t.content")


def session_parts(days: DataFrame) -> DataFrame:
    """days(day, text) cut at `# session: id` lines: day, session, text. Text before the first one is
    left out; of a session that comes twice the last one counts."""
    parts = F.slice(F.split("text", r"(?m)^# session:[ \t]*"), 2, 1 << 20)
    each = days.select("day", F.posexplode(parts).alias("pos", "part"))
    named = each.select("day", "pos", F.trim(F.regexp_extract("part", r"\A([^\n]*)", 1)).alias("session"), F.btrim(F.regexp_replace("part", r"\A[^\n]*\n?", ""), F.lit(" \n\r\t")).alias("text"))
    return named.withColumn("rn", F.row_number().over(Window.partitionBy("day", "session").orderBy(C("pos").desc()))).where("rn = 1").select("day", "session", "text")


def upserted(corpus: DataFrame, changes: DataFrame) -> DataFrame:
    """corpus(uri, …) with the rows of changes in place of its own."""
    return corpus.join(changes.select("uri"), "uri", "left_anti").unionByName(changes)


def without(corpus: DataFrame, uris: DataFrame) -> DataFrame:
    """corpus(uri, …) without the given uris."""
    return corpus.join(uris.select("uri").distinct(), "uri", "left_anti")


def holds(corpus: DataFrame, uris: DataFrame) -> DataFrame:
    """uris(uri) and whether the corpus has each."""
    there = corpus.select("uri").distinct().withColumn("held", F.lit(True))
    return uris.join(there, "uri", "left").select("uri", F.coalesce("held", F.lit(False)).alias("held"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """How many documents and chunks a corpus of chunks(uri, …) has."""
    return chunks.agg(F.countDistinct("uri").alias("n_documents"), F.count("*").alias("n_chunks"))


def tagged(notes: DataFrame, date: Column, **kinds: bool) -> DataFrame:
    """notes(uri, content_type, text) as they go into the index: classes with kinds[class] true get their
    date in front of the text."""
    wanted = [k for k, on in kinds.items() if on]
    return notes.withColumn("text", F.when(C("content_type").isin(*wanted), temporal_tag(C("text"), date)).otherwise(C("text")))


def synced(corpus: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """What a sync of corpus(uri, hash) with files(uri, text) has to do: changed rows and removed uris."""
    hashed = files.withColumn("hash", F.xxhash64("text"))
    return {"changed": hashed.join(corpus, ["uri", "hash"], "left_anti"), "removed": corpus.join(files, "uri", "left_anti").select("uri")}
