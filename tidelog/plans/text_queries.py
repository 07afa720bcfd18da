"""Queries of the text and date functions over the daily notes and the questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions import dates, text
from tidelog.sources import views
from tidelog.sources.scratch import spread
from tidelog.sources.views import sql

C = F.col


def _alternatives(patterns: tuple) -> list[str]:
    return [p.replace("'", "''") for p in patterns]


def t1_temporal_tag(spark, sf) -> DataFrame:
    return views.daily(spark, sf).select("doc_id", F.sha2(text.temporal_tag(C("text"), C("mem_date")), 256).alias("tagged_sha256"))


T1 = sql("v_daily", "SELECT doc_id, sha256('[as of ' || CAST(mem_date AS VARCHAR) || ']' || chr(10) || chr(10) || text) AS tagged_sha256 FROM v_daily")


def t2_token_estimate(spark, sf) -> DataFrame:
    return views.daily(spark, sf).select("doc_id", text.token_estimate(C("text")).alias("tokens"))


T2 = sql("v_daily", "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM v_daily")


def t4_fixed_chunks(spark, sf) -> DataFrame:
    tokens = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    chunks = views.daily(spark, sf).select("doc_id", F.posexplode(text.fixed_chunks(tokens)).alias("chunk_id", "chunk"))
    return chunks.select("doc_id", C("chunk_id").cast("long").alias("chunk_id"), F.size("chunk").cast("long").alias("n_tokens"), C("chunk")[0].alias("first_token"))


T4 = sql(
    "v_daily",
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM v_daily),
    s AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 64, 1), 448)) AS i FROM w)
    SELECT doc_id, i // 448 AS chunk_id, CAST(len(list_slice(w, i + 1, i + 512)) AS BIGINT) AS n_tokens, w[i + 1] AS first_token FROM s""",
)


def t5_line_of_offset(spark, sf) -> DataFrame:
    at = F.position(F.lit("Budget"), C("text"))
    return views.daily(spark, sf).select("doc_id", text.line_of(C("text"), at).cast("long").alias("line"))


T5 = sql("v_daily", "SELECT doc_id, CAST(len(string_split(substr(text, 1, instr(text, 'Budget')), chr(10))) AS BIGINT) AS line FROM v_daily")


def t6_ranged_read(spark, sf) -> DataFrame:
    part, left = text.ranged_lines(C("text"), F.lit(2), F.lit(3))
    return views.daily(spark, sf).select("doc_id", F.sha2(part, 256).alias("part_sha256"), left.cast("long").alias("lines_left"))


T6 = sql(
    "v_daily",
    """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM v_daily)
    SELECT doc_id, sha256(array_to_string(list_slice(l, 2, 4), chr(10))) AS part_sha256, CAST(greatest(len(l) - 4, 0) AS BIGINT) AS lines_left FROM l""",
)


def t7_light_entities(spark, sf) -> DataFrame:
    return spread(views.daily(spark, sf).select("doc_id", "text")).select("doc_id", F.explode(text.light_entities(C("text"))).alias("entity"))


_LIGHT = r"list_concat(list_concat(regexp_extract_all(text, '\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b'), regexp_extract_all(text, '\b[a-z][a-z0-9]*(?:-[a-z0-9]+){2,}\b')), {more})"
T7 = sql("v_daily", "SELECT DISTINCT doc_id, lower(unnest(" + _LIGHT.replace("{more}", r"regexp_extract_all(text, '@(\w+)', 1)") + ")) AS entity FROM v_daily")


def t8_entity_count(spark, sf) -> DataFrame:
    return spread(views.daily(spark, sf).select("doc_id", "text")).select("doc_id", F.size(text.entities(C("text"))).cast("long").alias("n_entities"))


_MORE = r"list_concat(list_filter(regexp_extract_all(text, '\b[A-Z][A-Z_]{2,}\b'), lambda x: length(x) >= 4), list_concat(regexp_extract_all(text, '(?i)\bHTTP\s+[45]\d\d\b'), regexp_extract_all(text, '(?i)\b(?:#|ticket\s*[#:]?)\s*\d{2,}\b')))"
_ENTITIES = "list_distinct(list_concat(list_transform(" + _LIGHT.replace("{more}", _MORE) + ", lambda x: lower(x)), list_filter([" + ", ".join(f"'{t}'" for t in text.TOOLS) + "], lambda t: contains(lower(text), t))))"
T8 = sql("v_daily", f"SELECT doc_id, CAST(len({_ENTITIES}) AS BIGINT) AS n_entities FROM v_daily")


def t9_decision_markers(spark, sf) -> DataFrame:
    return spread(views.daily(spark, sf).select("doc_id", "text")).select("doc_id", text.decision_markers(C("text")).alias("n_decisions"))


_DECISIONS = " + ".join(f"len(regexp_extract_all(text, '(?i){p}'))" for p in _alternatives(text.DECISION_MARKERS))
T9 = sql("v_daily", f"SELECT doc_id, CAST({_DECISIONS} AS BIGINT) AS n_decisions FROM v_daily")


def t10_supersession_markers(spark, sf) -> DataFrame:
    return spread(views.daily(spark, sf).select("doc_id", "text")).select("doc_id", text.supersession_markers(C("text")).alias("n_markers"))


_SUPERSESSIONS = " + ".join(f"CAST(regexp_matches(text, '(?i){p}') AS INT)" for p in _alternatives(text.SUPERSESSION_MARKERS))
T10 = sql("v_daily", f"SELECT doc_id, CAST({_SUPERSESSIONS} AS BIGINT) AS n_markers FROM v_daily")


def _keyword_sql(stop: tuple, gap: str, least: int, column: str = "question") -> str:
    words = ", ".join(f"'{w}'" for w in stop)
    more = f" AND NOT list_contains([{words}], w)" if stop else ""
    return rf"list_filter(regexp_split_to_array(regexp_replace(lower({column}), '[^a-zA-Z0-9_\s-]', '{gap}', 'g'), '\s+'), lambda w: length(w) > {least}{more})"


def t11_keywords(spark, sf) -> DataFrame:
    return views.qa(spark, sf).select("qa_id", F.array_join(text.query_keywords(C("question")), " ").alias("query_keywords"), F.array_join(text.signal_keywords(C("question")), " ").alias("signal_keywords"))


T11 = sql("v_qa", f"SELECT qa_id, array_to_string({_keyword_sql(text.QUERY_STOP_WORDS, ' ', 1)}, ' ') AS query_keywords, array_to_string({_keyword_sql(text.SIGNAL_STOP_WORDS, '', 2)}, ' ') AS signal_keywords FROM v_qa")


def t12_catalog_tokens(spark, sf) -> DataFrame:
    return views.qa(spark, sf).select("qa_id", F.array_join(text.catalog_tokens(C("question")), " ").alias("tokens"))


T12 = sql("v_qa", f"SELECT qa_id, array_to_string({_keyword_sql((), ' ', 1)}, ' ') AS tokens FROM v_qa")


def t13_signatures(spark, sf) -> DataFrame:
    return views.daily(spark, sf).select("doc_id", F.explode(text.signatures(C("text"))).alias("s")).groupBy("doc_id", "s.kind", "s.value").agg(F.count("*").alias("n"))


T13 = sql("v_daily", "SELECT doc_id, kind, value, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, '{p}')) AS value FROM v_daily" for k, p in text.SIGNATURES.items()) + ") GROUP BY ALL")


def t15_date_of_uri(spark, sf) -> DataFrame:
    d = views.daily(spark, sf)
    kinds = F.array(C("uri"), F.concat(F.lit("weekly/"), dates.iso_week(C("mem_date"))), F.concat(F.lit("monthly/"), F.date_format("mem_date", "yyyy-MM")))
    return d.select("doc_id", F.explode(kinds).alias("any_uri")).select("doc_id", "any_uri", dates.date_of_uri(C("any_uri")).cast("string").alias("date"))


_WEEK = "strftime(mem_date, '%G-W%V')"
T15 = sql(
    "v_daily",
    f"""SELECT doc_id, uri AS any_uri, CAST(mem_date AS VARCHAR) AS date FROM v_daily
    UNION ALL SELECT doc_id, 'weekly/' || {_WEEK}, CAST(CAST(date_trunc('week', mem_date) AS DATE) + 3 AS VARCHAR) FROM v_daily
    UNION ALL SELECT doc_id, 'monthly/' || strftime(mem_date, '%Y-%m'), strftime(mem_date, '%Y-%m-15') FROM v_daily""",
)


def t16_week_labels(spark, sf) -> DataFrame:
    return views.daily(spark, sf).select("doc_id", dates.iso_week(C("mem_date")).alias("week"), dates.week_month(C("mem_date")).alias("month"))


T16 = sql("v_daily", f"SELECT doc_id, {_WEEK} AS week, strftime(CAST(date_trunc('week', mem_date) AS DATE) + 3, '%Y-%m') AS month FROM v_daily")


PHRASES = ("on April 8, 2026", "in March 2024", "2025-02", "Q3 2024", "Q1 last year", "back in 2023", "3 weeks ago and yesterday", "2 months ago, originally", "now in 2021-05-06")


def dated_texts(spark, sf) -> DataFrame:
    """The whole texts of the documents, each with a phrase about a time behind it, by its number."""
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (C("doc_id") % 9 + 1).cast("int"))
    return views.table(spark, sf, "documents").select(C("doc_id").alias("query_id"), F.concat(F.coalesce("text", F.lit("")), F.lit(" What was "), phrase, F.lit("?")).alias("text"))


_DATED = "(SELECT doc_id AS query_id, coalesce(text, '') || ' What was ' || [" + ", ".join(f"'{p}'" for p in PHRASES) + "][doc_id % 9 + 1] || '?' AS text FROM documents)"
NOW = "2026-11-28"


def t17_temporal_references(spark, sf) -> DataFrame:
    found = dates.temporal_references(dated_texts(spark, sf), F.lit(NOW).cast("date"))
    return found.select("query_id", C("date").cast("string").alias("date"), C("specificity").cast("long").alias("specificity"))


def _references_sql() -> str:
    """The patterns of the time references in DuckDB's dialect: (pattern, date of a match, specificity, once)."""
    months = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
    number = "(position(lower(substr(m, 1, 3)) IN 'janfebmaraprmayjunjulaugsepoctnovdec') + 2) // 3"
    part = lambda p, k: f"regexp_extract(m, '{p}', {k})"
    day = lambda y, mo, d: f"TRY_CAST(lpad(CAST({y} AS VARCHAR), 4, '0') || '-' || lpad(CAST({mo} AS VARCHAR), 2, '0') || '-' || lpad(CAST({d} AS VARCHAR), 2, '0') AS DATE)"
    now, year = f"DATE '{NOW}'", r"(\d{4})$"
    middle = f"(CAST(substr(m, 2, 1) AS INT) - 1) * 3 + 2"
    count = part(r"^(\d+)", 1)
    rules = [
        (rf"(?i)\b{months}\s+\d{{1,2}},?\s+\d{{4}}\b", day(part(year, 1), number, part(r"^[A-Za-z]+\s+(\d{1,2})", 1)), 4, False),
        (r"\b\d{4}-\d{2}-\d{2}\b", day("substr(m, 1, 4)", "substr(m, 6, 2)", "substr(m, 9, 2)"), 4, False),
        (rf"(?i)\b{months}\s+\d{{4}}\b", day(part(year, 1), number, "15"), 3, False),
        (r"\b\d{4}-\d{2}\b(?:-\d{2})?", f"CASE WHEN length(m) = 7 THEN {day('substr(m, 1, 4)', 'substr(m, 6, 2)', '15')} END", 3, False),
        (r"(?i)\bQ[1-4]\s+\d{4}\b", day(part(year, 1), middle, "15"), 2, False),
        (r"(?i)\bQ[1-4]\s+last\s+year\b", day(f"year({now}) - 1", middle, "15"), 2, False),
        (r"(?i)\b(?:in|back\s+in|from|during)\s+\d{4}\b", f"CASE WHEN CAST({part(year, 1)} AS INT) BETWEEN 1990 AND 2100 THEN {day(part(year, 1), 7, 1)} END", 1, False),
        (r"\b20[12]\d\b", day("m", 7, 1), 1, False),
        (r"(?i)\byesterday\b", f"{now} - 1", 4, True),
        (r"(?i)\blast\s+week\b", f"{now} - 7", 2, True),
        (r"(?i)\b\d+\s+weeks?\s+ago\b", f"{now} - 7 * TRY_CAST({count} AS INT)", 2, False),
        (r"(?i)\blast\s+month\b", f"CAST({now} - INTERVAL 1 MONTH AS DATE)", 2, True),
        (r"(?i)\b\d+\s+months?\s+ago\b", f"CAST({now} - to_months(TRY_CAST({count} AS INT)) AS DATE)", 2, False),
        (r"(?i)\blast\s+year\b", f"CAST({now} - INTERVAL 12 MONTH AS DATE)", 1, True),
        (r"(?i)\bthis\s+week\b", now, 2, True),
        (r"(?i)\bthis\s+month\b", now, 2, True),
    ]
    parts = []
    for k, (pattern, date, level, once) in enumerate(rules):
        every = f"regexp_extract_all(text, '{pattern}')"
        every = f"{every}[1:1]" if once else every
        parts.append(f"SELECT query_id, {k} AS no, pos, {date} AS date, {level} AS level FROM (SELECT query_id, unnest({every}) AS m, unnest(range(0, len({every}))) AS pos FROM {_DATED})")
    return "(SELECT query_id, date, level, no, pos FROM (SELECT *, max(CAST(no < 7 AS INT)) OVER (PARTITION BY query_id) AS earlier FROM (" + " UNION ALL ".join(parts) + ") WHERE date IS NOT NULL) WHERE no <> 7 OR earlier = 0)"


REFERENCES = _references_sql()
T17 = f"SELECT query_id, CAST(date AS VARCHAR) AS date, CAST(level AS BIGINT) AS specificity FROM {REFERENCES}"


def t18_best_reference(spark, sf) -> DataFrame:
    found = dates.best_reference(dates.temporal_references(dated_texts(spark, sf), F.lit(NOW).cast("date")))
    return found.select("query_id", C("date").cast("string").alias("date"), C("specificity").cast("long").alias("specificity"))


BEST_REFERENCE = f"(SELECT query_id, date, level FROM {REFERENCES} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY level DESC, no, pos) = 1)"
T18 = f"SELECT query_id, CAST(date AS VARCHAR) AS date, CAST(level AS BIGINT) AS specificity FROM {BEST_REFERENCE}"


def t19_temporal_affinity(spark, sf) -> DataFrame:
    return views.daily(spark, sf).select("doc_id", F.round(dates.temporal_affinity(C("mem_date"), F.lit("2024-06-01").cast("date")), 9).alias("affinity"))


T19 = sql("v_daily", "SELECT doc_id, round(exp(-abs(datediff('day', mem_date, DATE '2024-06-01')) / 30.0), 9) AS affinity FROM v_daily")


def t20_recency_cue(spark, sf) -> DataFrame:
    return dated_texts(spark, sf).select("query_id", dates.recency_cue(C("text")).alias("cue"))


CUES = f"(SELECT query_id, CASE WHEN regexp_matches(lower(text), '{dates.LATEST}') THEN 'latest' WHEN regexp_matches(lower(text), '{dates.EARLIEST}') THEN 'earliest' END AS cue FROM {_DATED})"
T20 = f"SELECT query_id, cue FROM {CUES}"


def t21_recency_boost(spark, sf) -> DataFrame:
    boost = dates.recency_boost(C("mem_date"), F.when(C("doc_id") % 3 == 0, "latest").when(C("doc_id") % 3 == 1, "earliest"), F.lit("2024-01-01").cast("date"), F.lit("2025-06-30").cast("date"))
    return views.daily(spark, sf).select("doc_id", F.round(boost, 9).alias("boost"))


T21 = sql(
    "v_daily",
    """WITH t AS (SELECT doc_id, greatest(0.0, least(1.0, datediff('day', DATE '2024-01-01', mem_date) / datediff('day', DATE '2024-01-01', DATE '2025-06-30'))) AS t FROM v_daily)
    SELECT doc_id, round(CAST(CASE doc_id % 3 WHEN 0 THEN 0.85 + 0.4 * t WHEN 1 THEN 1.25 - 0.4 * t ELSE 1.0 END AS DOUBLE), 9) AS boost FROM t""",
)


def t22_query_expansion(spark, sf) -> DataFrame:
    return views.qa(spark, sf).select("qa_id", F.posexplode(text.expanded_queries(C("question"))).alias("no", "variant")).select("qa_id", C("no").cast("long").alias("no"), "variant")


_KW = _keyword_sql(text.QUERY_STOP_WORDS, " ", 1)
T22 = sql(
    "v_qa",
    f"""WITH k AS (SELECT qa_id, question, {_KW} AS k FROM v_qa),
    v AS (SELECT qa_id, list_concat([question], list_concat(CASE WHEN len(k) >= 2 AND array_to_string(k, ' ') <> lower(question) THEN [array_to_string(k, ' ')] ELSE [] END,
      CASE WHEN len(k) > 3 THEN [array_to_string(list_slice(k, 1, 4), ' ')] ELSE [] END)) AS v FROM k)
    SELECT qa_id, unnest(range(0, len(v))) AS no, unnest(v) AS variant FROM v""",
)


def joined_questions(spark, sf) -> DataFrame:
    """Whole questions that ask for two or three things at once."""
    third = F.when(C("qa_id") % 3 == 0, "; how did it end for everyone?").otherwise(", and why?")
    joined = F.concat(F.lit("What was said about "), "question", F.lit(", and what was the "), C("category"), F.lit(" of it"), third)
    return views.qa(spark, sf).select("qa_id", joined.alias("text"))


_JOINED = "(SELECT qa_id, 'What was said about ' || question || ', and what was the ' || category || ' of it' || CASE WHEN qa_id % 3 = 0 THEN '; how did it end for everyone?' ELSE ', and why?' END AS text FROM v_qa)"


def t23_query_decomposition(spark, sf) -> DataFrame:
    return joined_questions(spark, sf).select("qa_id", F.posexplode(text.decomposed_query(C("text"))).alias("no", "part")).select("qa_id", C("no").cast("long").alias("no"), "part")


# RE2 looks at nothing behind a match: the question word is marked first, then the mark is the border.
PARTS = rf"""(SELECT qa_id, list_filter(list_transform(string_split(regexp_replace(text, '(?i)\s*(?:,\s*and|\s+and|;|,)\s+((?:what|which|who|when|how|why|where|was|were|did|do|does|is|are|the)\b)', chr(1) || '\1', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS p FROM {_JOINED})"""
DECOMPOSED = rf"(SELECT qa_id, unnest(range(0, least(3, len(l)))) AS no, unnest(list_slice(l, 1, 3)) AS part FROM (SELECT qa_id, p, list_filter(p, lambda x: len(regexp_split_to_array(x, '\s+')) >= 4) AS l FROM {PARTS}) WHERE len(p) >= 2 AND len(l) >= 2)"
T23 = sql("v_qa", f"SELECT qa_id, no, part FROM {DECOMPOSED}")


def t24_calendar(spark, sf) -> DataFrame:
    d = views.daily(spark, sf).select("doc_id", dates.calendar_date(F.lit("2024-01-01").cast("date"), (C("doc_id") + 1).cast("int")).alias("d"))
    return d.select("doc_id", C("d").cast("string").alias("date"), F.date_format("d", "EEEE").alias("weekday"))


T24 = sql("v_daily", "SELECT doc_id, CAST(mem_date AS VARCHAR) AS date, dayname(mem_date) AS weekday FROM v_daily")


def t25_day_numbers_to_dates(spark, sf) -> DataFrame:
    d = views.table(spark, sf, "documents").select("doc_id", F.concat("text", F.lit(" It was agreed on day "), (C("doc_id") % 90 + 1).cast("string"), F.lit(" and dropped by Day "), (C("doc_id") % 50 + 100).cast("string"), F.lit(".")).alias("text"))
    return d.select("doc_id", F.sha2(dates.with_dates(C("text"), F.lit("2024-01-01").cast("date")), 256).alias("text_sha256"))


T25 = r"""WITH d AS (SELECT doc_id, text || ' It was agreed on day ' || (doc_id % 90 + 1) || ' and dropped by Day ' || (doc_id % 50 + 100) || '.' AS text FROM documents)
  SELECT doc_id, sha256(list_reduce(list_prepend(text, list_distinct(regexp_extract_all(text, '(?i)\bday\s+(\d+)\b', 1))), lambda t, n: regexp_replace(t, '(?i)\bday\s+' || n || '\b', CAST(DATE '2024-01-01' + (CAST(n AS INT) - 1) AS VARCHAR), 'g'))) AS text_sha256 FROM d"""


def t27_slugs(spark, sf) -> DataFrame:
    path = F.regexp_extract("url", r"^https?://[^/]+/(.*)$", 1)
    slug = F.regexp_replace(F.lower(path), r"[/?=&.]+", "-")
    return views.table(spark, sf, "pages").select("page_id", slug.alias("slug"), text.valid_slug(slug).alias("valid"))


T27 = r"""SELECT page_id, slug, regexp_matches(slug, '^[a-z0-9]+(-[a-z0-9]+)*$') AND slug <> 'index' AS valid FROM
  (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://[^/]+/(.*)$', 1)), '[/?=&.]+', '-', 'g') AS slug FROM pages)"""


def t28_wiki_links(spark, sf) -> DataFrame:
    return views.wiki(spark, sf).select("slug", F.explode(text.links(C("body"))).alias("target"))


T28 = sql("v_wiki", r"SELECT DISTINCT slug, regexp_replace(unnest(regexp_extract_all(body, '\[\[([^\]|]+)', 1)), '^[A-Za-z0-9_-]+:', '') AS target FROM v_wiki")


def t31_range_labels(spark, sf) -> DataFrame:
    label = F.concat((C("p_size")).cast("string"), F.element_at(F.array(*map(F.lit, ("d", "mo", "y", "full"))), (C("p_partkey") % 4 + 1).cast("int")))
    return views.table(spark, sf, "part").select("p_partkey", label.alias("label"), dates.range_days(label).cast("long").alias("days"))


T31 = "SELECT p_partkey, p_size || ['d', 'mo', 'y', 'full'][p_partkey % 4 + 1] AS label, CAST(CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size * 30 WHEN 2 THEN p_size * 365 END AS BIGINT) AS days FROM part"


def t34_snippets(spark, sf) -> DataFrame:
    return views.daily(spark, sf).select("doc_id", F.sha2(text.snippet(C("text")), 256).alias("snippet_sha256"), F.regexp_extract("uri", r"\d{4}-\d{2}-\d{2}", 0).alias("date_label"))


T34 = sql("v_daily", "SELECT doc_id, sha256(substr(text, 1, 700)) AS snippet_sha256, CAST(mem_date AS VARCHAR) AS date_label FROM v_daily")

QUERIES = {f.__name__: f for f in (t1_temporal_tag, t2_token_estimate, t4_fixed_chunks, t5_line_of_offset, t6_ranged_read, t7_light_entities, t8_entity_count, t9_decision_markers, t10_supersession_markers, t11_keywords, t12_catalog_tokens, t13_signatures, t15_date_of_uri, t16_week_labels, t17_temporal_references, t18_best_reference, t19_temporal_affinity, t20_recency_cue, t21_recency_boost, t22_query_expansion, t23_query_decomposition, t24_calendar, t25_day_numbers_to_dates, t27_slugs, t28_wiki_links, t31_range_labels, t34_snippets)}
ORACLE_SQL = {"t1_temporal_tag": T1, "t2_token_estimate": T2, "t4_fixed_chunks": T4, "t5_line_of_offset": T5, "t6_ranged_read": T6, "t7_light_entities": T7, "t8_entity_count": T8, "t9_decision_markers": T9, "t10_supersession_markers": T10, "t11_keywords": T11, "t12_catalog_tokens": T12, "t13_signatures": T13, "t15_date_of_uri": T15, "t16_week_labels": T16, "t17_temporal_references": T17, "t18_best_reference": T18, "t19_temporal_affinity": T19, "t20_recency_cue": T20, "t21_recency_boost": T21, "t22_query_expansion": T22, "t23_query_decomposition": T23, "t24_calendar": T24, "t25_day_numbers_to_dates": T25, "t27_slugs": T27, "t28_wiki_links": T28, "t31_range_labels": T31, "t34_snippets": T34}
