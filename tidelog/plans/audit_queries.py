"""Queries of audits, vague times, salvage, schedules, diaries and index rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions import dates, text
from tidelog.operators import evals, rollup, signals
from tidelog.plans.eval_queries import _ACTIVE, _ELIGIBLE, _FINAL, _calendar, _days, _eligible, _final
from tidelog.plans.rollup_queries import _PARENT, _parents, _weeks
from tidelog.plans.text_queries import _WEEK
from tidelog.sources import memory, views
from tidelog.sources.views import sql

C = F.col


def _docs(spark, sf):
    return views.table(spark, sf, "documents")


def _pick(n, *values):
    """One of the values by a number."""
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


# --- text


def t11_passage_words(spark, sf):
    return _docs(spark, sf).select("doc_id", F.sha2(F.array_join(text.passage_words(C("text")), " "), 256).alias("words_sha256"))


_PASSAGE = "list_filter(regexp_extract_all(lower({t}), '[a-z][a-z''-]+'), lambda w: length(w) > 2 AND NOT list_contains([" + _quoted(text.QUERY_STOP_WORDS) + "], w))"
T11 = f"SELECT doc_id, sha256(array_to_string({_PASSAGE.format(t='text')}, ' ')) AS words_sha256 FROM documents"

_TITLE = text.TITLE_CASE


def t13_named_signatures(spark, sf):
    values = F.filter(text.named_signatures(C("text")), lambda s: s["kind"] == "name")
    return views.daily(spark, sf).select("doc_id", F.explode(values).alias("s")).groupBy("doc_id", C("s.value").alias("value")).agg(F.count("*").alias("n"))


T13 = sql("v_daily", f"SELECT doc_id, value, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_TITLE}')) AS value FROM v_daily) GROUP BY ALL")


def t14_proper_nouns(spark, sf):
    asked = F.concat(_pick(C("doc_id"), "Did ", "What ", "Acme ", ""), F.lit("Jordan Miles of "), "text", F.lit(" End Of Line"))
    return _docs(spark, sf).select("doc_id", F.explode(text.proper_nouns(asked)).alias("noun"))


T14 = f"""WITH q AS (SELECT doc_id, ['Did ', 'What ', 'Acme ', ''][doc_id % 4 + 1] || 'Jordan Miles of ' || text || ' End Of Line' AS t FROM documents), f AS (SELECT *, regexp_extract(t, '^([^ ]+) ', 1) AS w FROM q)
  SELECT DISTINCT doc_id, unnest(regexp_extract_all(CASE WHEN w IN ({_quoted(text.SENTENCE_STARTERS)}) THEN repeat(' ', length(w)) || substr(t, length(w) + 1) ELSE t END, '{_TITLE}')) AS noun FROM f"""


def t26_anchored_times(spark, sf):
    """Whole texts that end in vague times, with two relevant days; a third of them has none."""
    i = C("doc_id")
    vague = F.concat("text", F.lit(" It broke on Sunday and friday, that weekend was quiet, the weekday rush came this morning."))
    days = F.when(i % 3 == 0, F.array().cast("array<int>")).otherwise(F.array((i % 200 + 1).cast("int"), (i * 3 % 90 + 1).cast("int"), (i % 7 + 1).cast("int")))
    return _docs(spark, sf).select("doc_id", F.sha2(dates.anchored_times(vague, days, F.lit("2024-01-01").cast("date")), 256).alias("text_sha256"))


def _anchored_sql() -> str:
    out = "t"
    first = "CAST(d[1] AS VARCHAR)"
    for name in ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"):
        anchor = f"coalesce(CAST(list_filter(d, lambda x: dayname(x) = '{name}')[1] AS VARCHAR), {first})"
        out = rf"regexp_replace({out}, '(?i)\b({name})\b', '\1 (' || {anchor} || ')', 'g')"
    ends, work = "list_sort(list_filter(d, lambda x: isodow(x) >= 6))", "list_sort(list_filter(d, lambda x: isodow(x) < 6))"
    weekend = f"CASE WHEN len({ends}) >= 2 THEN CAST({ends}[1] AS VARCHAR) || ' to ' || CAST({ends}[-1] AS VARCHAR) WHEN len({ends}) = 1 THEN CAST({ends}[1] AS VARCHAR) ELSE {first} END"
    for name, anchor in (("weekend", weekend), ("weekday", f"coalesce(CAST({work}[1] AS VARCHAR), {first})"), ("part", first)):
        out = rf"regexp_replace({out}, '{dates.VAGUE_TIMES[name]}', '\0 (' || {anchor} || ')', 'g')"
    return out


T26 = rf"""WITH q AS (SELECT doc_id, text || ' It broke on Sunday and friday, that weekend was quiet, the weekday rush came this morning.' AS t, CASE WHEN doc_id % 3 = 0 THEN CAST([] AS DATE[]) ELSE list_transform([doc_id % 200, doc_id * 3 % 90, doc_id % 7], lambda n: DATE '2024-01-01' + CAST(n AS INT)) END AS d FROM documents)
  SELECT doc_id, sha256(CASE WHEN len(d) > 0 AND NOT regexp_matches(t, '\b20\d\d-\d\d-\d\d\b') THEN {_anchored_sql()} ELSE t END) AS text_sha256 FROM q"""


def t28_link_offsets(spark, sf):
    w = views.wiki(spark, sf).join(_docs(spark, sf).select("doc_id", "text"), "doc_id")
    return w.select("doc_id", F.explode(text.links_with_offsets(F.concat("text", F.lit(" "), "body"))).alias("l")).select("doc_id", "l.target", C("l.offset").cast("long").alias("offset"))


T28 = sql(
    "v_wiki",
    r"""WITH b AS (SELECT doc_id, d.text || ' ' || body AS t FROM v_wiki JOIN documents d USING (doc_id))
    SELECT doc_id, 'doc-' || (doc_id * 3 % 1500) AS target, CAST(instr(t, '[[doc-' || (doc_id * 3 % 1500) || ']]') - 1 AS BIGINT) AS offset FROM b UNION ALL SELECT doc_id, 'doc-' || ((doc_id * 7 + 1) % 900), CAST(instr(t, '[[wiki:doc-' || ((doc_id * 7 + 1) % 900) || '|more]]') - 1 AS BIGINT) FROM b""",
)


def t30_salvaged(spark, sf):
    """Model output that breaks off in its second, third or fourth object."""
    k = C("o_orderkey").cast("string")
    one = F.concat(F.lit('{"id": '), k, F.lit(', "q": "a } \\"{ b", "x": {"y": ['), C("o_custkey").cast("string"), F.lit("]}}"))
    many = F.array_join(F.array_repeat(one, (C("o_orderkey") % 3 + 1).cast("int")), ", ")
    output = F.concat(F.lit("Sure: [ "), many, F.lit(',\n {"id": 9, "q": "cut o'))
    found = text.salvaged_objects(output)
    return views.table(spark, sf, "orders").select("o_orderkey", F.size(found).cast("long").alias("n"), F.array_join(found, ";").alias("objects"))


T30 = r"""WITH o AS (SELECT o_orderkey, o_orderkey % 3 + 1 AS n, '{"id": ' || o_orderkey || ', "q": "a } \"{ b", "x": {"y": [' || o_custkey || ']}}' AS one FROM orders)
  SELECT o_orderkey, n, array_to_string(list_transform(range(0, n), lambda i: one), ';') AS objects FROM o"""


def t32_wisdom_entries(spark, sf):
    whole = F.concat(F.lit("lost\n**Doc "), C("doc_id").cast("string"), F.lit("** since\n"), "text", F.lit("\n**Next** one\nkept *plain*\n\n**Last**"))
    return _docs(spark, sf).select("doc_id", F.explode(text.wisdom_entries(whole)).alias("e")).select("doc_id", "e.title", F.sha2("e.body", 256).alias("body_sha256"))


T32 = """SELECT doc_id, 'Doc ' || doc_id AS title, sha256(text || chr(10)) AS body_sha256 FROM documents UNION ALL SELECT doc_id, 'Next', sha256('kept *plain*' || chr(10) || chr(10)) FROM documents UNION ALL SELECT doc_id, 'Last', sha256('') FROM documents"""


def t33_stub_bodies(spark, sf):
    i = C("doc_id")
    w = views.wiki(spark, sf)
    maybe = lambda n, c: F.when(i % n == 0, "").otherwise(c)
    stub = text.stub_body(C("category"), F.concat(F.lit(" "), "name"), maybe(7, F.lit("because")), maybe(11, F.lit(" do it ")), maybe(2, F.lit("there")), F.when(i % 3 == 0, "often"), maybe(3, C("body")))
    return w.select("slug", stub["body"].alias("body"), stub["error"].alias("error"))


T33 = sql(
    "v_wiki",
    r"""WITH p AS (SELECT *, chr(10) || chr(10) AS g, CASE WHEN doc_id % 3 = 0 THEN '' ELSE body END AS extra FROM v_wiki),
    b AS (SELECT *, CASE WHEN category = 'theme' THEN 'themes can''t be stubs' WHEN category IN ('concept', 'project') AND (doc_id % 7 = 0 OR doc_id % 11 = 0) THEN 'why and how are needed' END AS error,
      name || CASE WHEN category IN ('concept', 'project') THEN g || '**Why:** because' || g || '**How to apply:** do it' WHEN category = 'reference' THEN CASE WHEN doc_id % 2 = 0 THEN '' ELSE g || '## Where to find it' || chr(10) || 'there' END || CASE WHEN doc_id % 3 = 0 THEN g || '## When to use it' || chr(10) || 'often' ELSE '' END ELSE '' END || CASE WHEN extra = '' THEN '' ELSE g || extra END || chr(10) AS body_ FROM p)
    SELECT slug, CASE WHEN error IS NULL THEN body_ END AS body, error FROM b""",
)


def t31_range_series(spark, sf):
    return views.table(spark, sf, "part").select("p_partkey", F.explode(dates.range_series(F.lit(10), (C("p_size") + 20).cast("int"), F.lit(15))).alias("days"))


T31 = "SELECT DISTINCT p_partkey, days FROM (SELECT p_partkey, unnest(range(10, p_size + 21, 15)) AS days FROM part UNION ALL SELECT p_partkey, p_size + 20 FROM part)"


# --- evaluation


def e19_marked_cells(spark, sf):
    cells = evals.category_means(_final(spark, sf), views.categories(spark), views.ranges(spark))
    gappy = cells.select("category", "range_days", F.when((C("n") > 0) & ((F.length("category") + C("range_days")) % 4 != 0), C("mean_score")).alias("score"))
    return evals.marked_cells(gappy, _eligible(spark, sf), False).withColumn("score", F.round("score", 9))


E19 = sql(
    "v_eval v_categories",
    f"""WITH m AS (SELECT r.range_days, c.category, avg(composite) AS s FROM v_ranges r CROSS JOIN v_categories c LEFT JOIN {_FINAL} f ON f.range_days = r.range_days AND f.category = c.category GROUP BY ALL),
    e AS (SELECT DISTINCT category, range_days FROM {_ELIGIBLE}), g AS (SELECT m.category, m.range_days, CASE WHEN (length(m.category) + m.range_days) % 4 <> 0 THEN s END AS score, e.category IS NOT NULL AS able FROM m LEFT JOIN e ON e.category = m.category AND e.range_days = m.range_days WHERE m.category NOT IN ({_quoted(evals.GATED)}))
    SELECT category, range_days, round(score, 9) AS score, CASE WHEN score IS NOT NULL THEN 'scored' WHEN able THEN 'open' ELSE 'ineligible' END AS state FROM g""",
)


def e21_recomputed(spark, sf):
    """Two ranges have no rows of their own and pass through."""
    recorded = views.ranges(spark).select(F.lit(0).alias("persona"), "range_days", F.lit(1.5).alias("mean_score"), F.lit(2.5).alias("hallucination_rate"), F.lit(7).cast("long").alias("n"), F.lit(3).cast("long").alias("n_failed"))
    scored = _final(spark, sf).where("range_days > 60")
    found = evals.recomputed(scored, views.qa(spark, sf).where("qa_id % 9 = 0"), recorded)
    return found.withColumns({c: F.round(c, 9) for c in ("mean_score", "hallucination_rate")})


E21 = sql("v_eval", f"SELECT persona, range_days, round(avg(composite), 9) AS mean_score, round(avg(CASE WHEN h = 0 THEN 1.0 ELSE 0.0 END) * 100, 9) AS hallucination_rate, count(*) AS n, CAST(sum(CAST(failed AS INT)) AS BIGINT) AS n_failed FROM {_FINAL} WHERE qa_id % 9 <> 0 AND range_days > 60 GROUP BY ALL UNION ALL SELECT 0, range_days, 1.5, 2.5, 7, 3 FROM v_ranges WHERE range_days <= 60")


def _audited(spark, sf):
    i = C("doc_id")
    answer = F.when(i % 4 == 0, F.concat("text", F.lit(" It cost $"), (i % 50).cast("string"), F.lit("M, up 12.5%."))).when(i % 4 == 1, F.lit("zzqx wwqx")).otherwise(F.concat("text", F.lit(" On "), views.day(i).cast("string")))
    question = F.when(i % 5 == 0, "Did Jordan Miles decide?").when(i % 5 == 1, "Why We decided?").otherwise("what happened?")
    relevant = F.when(i % 9 == 0, F.array().cast("array<int>")).when(i % 7 == 0, F.array((i + 1).cast("int"), F.lit(10_000_000))).when(i % 11 == 0, F.array(F.lit(10_000_001))).otherwise(F.array((i + 1).cast("int")))
    return _docs(spark, sf).select(i.alias("qa_id"), question.alias("question"), answer.alias("answer"), relevant.alias("relevant_days"))


def e24_audit(spark, sf):
    return evals.audit(_audited(spark, sf), _days(spark, sf), views.EPOCH).select("qa_id", F.array_join("codes", ",").alias("codes"))


_SIGNATURES = "list_concat(" * (len(text.SIGNATURES) - 1) + f"regexp_extract_all(answer, '{list(text.SIGNATURES.values())[0]}')" + "".join(f", regexp_extract_all(answer, '{p}'))" for p in list(text.SIGNATURES.values())[1:])
_NOUNS = f"regexp_extract_all(CASE WHEN regexp_extract(question, '^([^ ]+) ', 1) IN ({_quoted(text.SENTENCE_STARTERS)}) THEN repeat(' ', length(regexp_extract(question, '^([^ ]+) ', 1))) || substr(question, length(regexp_extract(question, '^([^ ]+) ', 1)) + 1) ELSE question END, '{_TITLE}')"
E24 = sql(
    "v_daily",
    f"""WITH q AS (SELECT doc_id AS qa_id, CASE doc_id % 4 WHEN 0 THEN text || ' It cost $' || (doc_id % 50) || 'M, up 12.5%.' WHEN 1 THEN 'zzqx wwqx' ELSE text || ' On ' || CAST(DATE '2024-01-01' + CAST(doc_id AS INT) AS VARCHAR) END AS answer,
      CASE doc_id % 5 WHEN 0 THEN 'Did Jordan Miles decide?' WHEN 1 THEN 'Why We decided?' ELSE 'what happened?' END AS question, CASE WHEN doc_id % 9 = 0 THEN [] WHEN doc_id % 7 = 0 THEN [doc_id + 1, 10000000] WHEN doc_id % 11 = 0 THEN [10000001] ELSE [doc_id + 1] END AS r FROM documents),
    b AS (SELECT q.*, len(r) > 0 AND (doc_id IS NULL OR len(r) > 1) AS missing, CASE WHEN d.doc_id IS NULL THEN '' ELSE chr(10) || CAST(mem_date AS VARCHAR) || chr(10) || text END AS blob FROM q LEFT JOIN v_daily d ON list_contains(r, d.doc_id + 1))
    SELECT qa_id, concat_ws(',', CASE WHEN len(r) = 0 THEN 'empty days' END, CASE WHEN missing THEN 'missing day' END, CASE WHEN blob <> '' AND len(list_filter({_SIGNATURES}, lambda v: NOT contains(blob, v))) > 0 THEN 'missing value' END,
      CASE WHEN blob <> '' AND len(list_filter({_NOUNS}, lambda v: NOT contains(blob, v))) > 0 THEN 'missing entity' END, CASE WHEN blob <> '' AND len({_PASSAGE.format(t='answer')}) > 0 AND NOT list_has_any({_PASSAGE.format(t='answer')}, {_PASSAGE.format(t='blob')}) THEN 'no common word' END) AS codes FROM b""",
)


def _revised(spark, sf):
    q = views.qa(spark, sf)
    return q.select("qa_id", F.concat(F.lit("The budget was $"), (C("qa_id") % 50).cast("string"), F.lit("M for "), "question").alias("answer"), "relevant_days")


def e25_revisions(spark, sf):
    found = evals.revision_candidates(_revised(spark, sf), _days(spark, sf))
    return found.withColumn("day_number", C("day_number").cast("long"))




def _signature_rows(columns: str, column: str, rows: str) -> str:
    return " UNION ALL ".join(f"SELECT {columns}, '{k}' AS kind, unnest(regexp_extract_all({column}, '{p}')) AS value FROM {rows}" for k, p in text.SIGNATURES.items())



def _occurrences() -> str:
    return " UNION ALL ".join(f"SELECT doc_id + 1 AS day_number, text, '{k}' AS kind, regexp_extract_all(text, '{p}') AS m, regexp_split_to_array(text, '{p}') AS s FROM v_daily" for k, p in text.SIGNATURES.items())


E25 = sql(
    "v_qa v_daily",
    rf"""WITH q AS (SELECT qa_id, 'The budget was $' || (qa_id % 50) || 'M for ' || question AS answer, list_max(relevant_days) AS last_day FROM v_qa),
    a AS (SELECT qa_id, last_day, unnest(list_filter(regexp_extract_all(lower(answer), '\b[a-z]{{5,}}\b'), lambda w: NOT list_contains([{_quoted(text.VAGUE_ANCHORS)}], w))) AS anchor, generate_subscripts(list_filter(regexp_extract_all(lower(answer), '\b[a-z]{{5,}}\b'), lambda w: NOT list_contains([{_quoted(text.VAGUE_ANCHORS)}], w)), 1) AS k FROM q),
    n AS (SELECT qa_id, last_day, anchor FROM (SELECT qa_id, last_day, anchor, min(k) AS k FROM a GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY qa_id ORDER BY k) <= 8),
    o AS (SELECT DISTINCT qa_id, kind, value FROM ({_signature_rows('qa_id', 'answer', 'q')})),
    c AS ({_occurrences()}),
    x AS (SELECT day_number, kind, text, unnest(m) AS value, unnest(range(1, len(m) + 1)) AS k, m, s FROM c),
    y AS (SELECT *, CAST(list_sum(list_transform(s[1:k], lambda t: length(t))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda t: length(t))), 0) AS BIGINT) AS b FROM x),
    z AS (SELECT *, greatest(b + length(value) - 80, 0) AS e, greatest(b + length(value) - 140, 0) AS r FROM y),
    f AS (SELECT DISTINCT day_number, kind, value, unnest(regexp_extract_all(lower(regexp_extract(substr(text, r + 1, e - r), '[A-Za-z0-9_]*$') || substr(text, e + 1, b + 80 - e) || regexp_extract(substr(text, b + 81, 60), '^[A-Za-z0-9_]*')), '\b[a-z]{{5,}}\b')) AS anchor FROM z)
    SELECT n.qa_id, f.day_number, o.kind, o.value, min(f.value) AS other FROM n JOIN o USING (qa_id) JOIN f ON f.anchor = n.anchor AND f.kind = o.kind AND f.value <> o.value AND f.day_number > n.last_day GROUP BY ALL""",
)


def e30_closed_schedule(spark, sf):
    checkpoints = views.ranges(spark).select(C("range_days").alias("day"))
    return evals.generation_windows(checkpoints, views.arcs(spark, sf), 150).withColumn("n_days", C("n_days").cast("long"))


E30 = sql(
    "v_arcs v_ranges",
    """WITH c AS (SELECT range_days AS d FROM v_ranges WHERE range_days < 150 UNION ALL SELECT 150), w AS (SELECT coalesce(lag(d) OVER (ORDER BY d), 0) AS after_day, d AS day FROM c)
    SELECT after_day, day, CAST(sum(CAST(start_day <= day AND end_day > after_day AS INT)) AS BIGINT) AS n_overlapping, CAST(sum(CAST(end_day <= after_day AS INT)) AS BIGINT) AS n_ended, CAST(day - after_day AS BIGINT) AS n_days FROM v_arcs, w GROUP BY ALL""",
)


def e31_session_windows(spark, sf):
    """Sessions of the notes in windows of 30 days; one session is covered up to day 60, one ends early."""
    parts = memory.session_parts(views.daily(spark, sf).select((C("doc_id") + 1).cast("int").alias("day"), "text"))
    one = spark.range(3)
    sessions = one.select(F.concat(F.lit("s"), C("id").cast("string")).alias("session"), F.when(C("id") == 1, 20).alias("first_day"), F.when(C("id") == 2, 100).alias("last_day"))
    covered = one.where("id = 0").select(F.lit("s0").alias("session"), F.lit(60).alias("day"))
    checkpoints = views.ranges(spark).select(C("range_days").alias("day"))
    found = evals.session_windows(sessions, parts, checkpoints, covered, 30)
    return found.select("session", C("checkpoint").cast("long").alias("checkpoint"), C("from_day").cast("long").alias("from_day"), C("to_day").cast("long").alias("to_day"), "n_days")


E31 = sql(
    "v_ranges",
    """WITH m AS (SELECT max(doc_id) + 1 AS most FROM documents), s AS (SELECT 's' || i AS session, i, CASE WHEN i = 1 THEN 20 ELSE 1 END AS f, CASE WHEN i = 2 THEN 100 END AS l FROM (SELECT unnest([0, 1, 2]) AS i)),
    w AS (SELECT session, i, range_days AS checkpoint, greatest(f, range_days - 29) AS from_day, least(range_days, coalesce(l, most), most) AS to_day FROM s, v_ranges, m WHERE range_days >= f AND (i <> 0 OR range_days > 60))
    SELECT session, CAST(checkpoint AS BIGINT) AS checkpoint, CAST(from_day AS BIGINT) AS from_day, CAST(to_day AS BIGINT) AS to_day, count(*) AS n_days FROM w JOIN documents ON doc_id % 3 = i AND doc_id + 1 BETWEEN from_day AND to_day GROUP BY ALL""",
)


def _story(spark, sf):
    """Arcs with sessions, directives and corrections."""
    i = C("arc_id")
    name = lambda n: F.concat(F.lit("s"), n.cast("string"))
    return views.arcs(spark, sf).withColumns({
        "primary_session": F.when(i % 4 == 0, "principal").otherwise(name(i % 5)), "referenced": F.array(name(i % 7), F.lit("s9")),
        "directives": F.array(F.struct(C("pinned_day").alias("day"), F.concat(F.lit("event "), i.cast("string")).alias("event")), F.struct((C("start_day") + 2).alias("day"), F.lit("check").alias("event"))),
        "type": F.when(i % 3 == 0, "correction").otherwise(C("type")), "corrected_day": F.when(i % 5 > 0, C("pinned_day")), "wrong": F.concat(F.lit("w"), i.cast("string")), "right": F.concat(F.lit("r"), i.cast("string")),
    })


def e33_active_sessions(spark, sf):
    days, arcs = _calendar(spark, sf), _story(spark, sf)
    active = evals.active_arcs(days, arcs)
    order = spark.range(6).select(F.concat(F.lit("s"), (5 - C("id")).cast("string")).alias("session"), C("id").cast("int").alias("place"))
    found = evals.active_sessions(active, evals.echo_days(active), order)
    return found.select("day_number", F.array_join("sessions", ",").alias("sessions"))


E33 = sql(
    "v_arcs",
    f"""WITH a AS (SELECT x.arc_id, x.day_number, CASE WHEN x.arc_id % 4 = 0 THEN 'principal' ELSE 's' || (x.arc_id % 5) END AS p, x.day_number IN (v.start_day, v.end_day, v.pinned_day) OR (day_in_arc > 14 AND (day_in_arc - 1) % 14 = 0) AS echo FROM {_ACTIVE} x JOIN v_arcs v ON v.arc_id = x.arc_id),
    s AS (SELECT DISTINCT day_number, session FROM (SELECT day_number, p AS session FROM a UNION ALL SELECT day_number, 's' || (arc_id % 7) FROM a WHERE echo UNION ALL SELECT day_number, 's9' FROM a WHERE echo))
    SELECT day_number, string_agg(session, ',' ORDER BY CASE WHEN session = 'principal' THEN -1 WHEN session < 's6' THEN 5 - CAST(substr(session, 2) AS INT) ELSE 1000 END, session) AS sessions FROM s GROUP BY day_number""",
)


def e34_directives(spark, sf):
    return evals.directives(_story(spark, sf), _calendar(spark, sf))


E34 = sql("v_arcs", "SELECT arc_id, pinned_day AS day_number, 'event ' || arc_id AS event FROM v_arcs WHERE pinned_day - 1 IN (SELECT doc_id FROM documents) UNION ALL SELECT arc_id, start_day + 2, 'check' FROM v_arcs WHERE start_day + 1 IN (SELECT doc_id FROM documents)")


def e34_correction_states(spark, sf):
    return evals.correction_states(_story(spark, sf), _calendar(spark, sf))


E34C = sql("v_arcs", "SELECT arc_id, doc_id + 1 AS day_number, CASE WHEN doc_id + 1 < pinned_day THEN 'wrong_belief' WHEN doc_id + 1 = pinned_day THEN 'correction_day' ELSE 'post_correction' END AS phase, 'w' || arc_id AS belief, CASE WHEN doc_id + 1 >= pinned_day THEN 'r' || arc_id END AS corrected FROM v_arcs JOIN documents ON doc_id + 1 BETWEEN start_day AND end_day WHERE arc_id % 3 = 0 AND arc_id % 5 > 0")


def e38_merged_sessions(spark, sf):
    k = C("c_custkey")
    c = views.table(spark, sf, "customer").select(k.cast("string").alias("session"), (k % 30).alias("first_day"), (k % 90 + 30).alias("last_day"))
    story = views.table(spark, sf, "customer").where("c_custkey % 2 = 0").select(k.cast("string").alias("session"), F.when(k % 4 == 0, k % 10).alias("first_day"), F.when(k % 3 == 0, 99).cast("long").alias("last_day"))
    return evals.merged_sessions(c, story)


E38 = "SELECT CAST(c_custkey AS VARCHAR) AS session, CASE WHEN c_custkey % 2 = 1 THEN c_custkey % 30 WHEN c_custkey % 4 = 0 THEN c_custkey % 10 END AS first_day, CASE WHEN c_custkey % 2 = 1 THEN c_custkey % 90 + 30 WHEN c_custkey % 3 = 0 THEN 99 END AS last_day FROM customer"


def e39_resumed(spark, sf):
    """The finished ranges are the two smallest: what is left, and the pairs that count as seen."""
    planned = views.ranges(spark)
    left, seen = evals.resumed(planned, planned.where("range_days <= 60"), views.qa(spark, sf))
    return left.select(C("range_days").cast("long").alias("key"), F.lit("range").alias("what")).unionByName(seen.select(C("qa_id").alias("key"), F.lit("seen").alias("what")))


E39 = sql("v_qa v_ranges", "SELECT CAST(range_days AS BIGINT) AS key, 'range' AS what FROM v_ranges WHERE range_days > 60 UNION ALL SELECT qa_id, 'seen' FROM v_qa WHERE coalesce(list_max(relevant_days), 0) <= 60 AND (irrelevant_after IS NULL OR irrelevant_after >= 60)")


# --- signals


def g14_page_quality(spark, sf):
    e = views.table(spark, sf, "events")
    events = e.select(F.concat(F.lit("p"), (C("user_id") % 40).cast("string")).alias("slug"), _pick(C("event_id"), "hit", "hit", "followed", "hit", "discarded", "hit", "overridden").alias("event"))
    return signals.page_quality(events).withColumn("score", F.round("score", 9))


G14 = """WITH e AS (SELECT 'p' || (user_id % 40) AS slug, event_id % 7 AS k FROM events), c AS (SELECT slug, CAST(sum(CAST(k IN (0, 1, 3, 5) AS INT)) AS BIGINT) AS hit, CAST(sum(CAST(k = 2 AS INT)) AS BIGINT) AS followed, CAST(sum(CAST(k = 4 AS INT)) AS BIGINT) AS discarded, CAST(sum(CAST(k = 6 AS INT)) AS BIGINT) AS overridden FROM e GROUP BY slug)
  SELECT slug, hit, followed, discarded, overridden, round(greatest(-1.0, least(1.0, (followed - 0.5 * discarded - 2 * overridden) / hit)), 9) AS score FROM c WHERE hit > 0"""


def g14_followed_hits(spark, sf):
    e, i = views.table(spark, sf, "events"), C("event_id")
    log = e.select(C("user_id").alias("session"), i.alias("seq"), F.when(i % 3 == 0, "page").otherwise("read").alias("kind"), F.concat(F.lit("n"), (i % 6).cast("string")).alias("uri"), F.array(F.lit("n1"), F.lit("n4")).alias("cited"))
    return signals.followed_hits(log).select("seq", "followed")


G14F = "SELECT seq, followed FROM (SELECT event_id AS seq, event_id % 3 AS k, event_id % 3 = 0 AND coalesce(lead(event_id % 3 <> 0 AND event_id % 6 IN (1, 4)) OVER (PARTITION BY user_id ORDER BY event_id), false) AS followed FROM events) WHERE k = 0"


def g15_answer_flags(spark, sf):
    """Answers are the whole texts; a day is pinned in every second question."""
    i = C("doc_id")
    trace = F.when(i % 3 == 0, F.array(F.lit("memory/wiki/a.md"))).when(i % 3 == 1, F.array(F.concat(F.lit("memory/"), views.day(i).cast("string"), F.lit(".md")))).otherwise(F.array().cast("array<string>"))
    question = F.when(i % 2 == 0, F.concat(F.lit("What held as of "), views.day(i).cast("string"), F.lit("?"))).otherwise("What held?")
    answer = F.concat("text", _pick(i, " I couldn't find more.", " It was $5M.", ""))
    return signals.answer_flags(_docs(spark, sf).select(i.alias("id"), question.alias("question"), answer.alias("answer"), trace.alias("trace"))).select("id", F.array_join("flags", ",").alias("flags"))


_HEDGES = signals.HEDGES.replace("'", "''")
G15 = rf"""WITH a AS (SELECT doc_id AS id, text || [' I couldn''t find more.', ' It was $5M.', ''][doc_id % 3 + 1] AS answer FROM documents)
  SELECT id, concat_ws(',', CASE WHEN id % 3 = 0 AND regexp_matches(answer, '{signals.STATED}') THEN 'value without a note' END, CASE WHEN id % 2 = 0 AND id % 3 <> 1 THEN 'pinned date not read' END, CASE WHEN regexp_matches(answer, '{_HEDGES}') THEN 'hedging' END) AS flags FROM a"""


def g16_uncovered_promotions(spark, sf):
    p = views.table(spark, sf, "part").select(F.concat((C("p_partkey") % 90).cast("string"), F.lit(".md")).alias("file"), C("p_name").alias("name"))
    typed = views.table(spark, sf, "supplier").select(F.concat(C("s_suppkey").cast("string"), F.lit(".md")).alias("file"), F.lit("none").alias("name"))
    return signals.uncovered_promotions(p, typed.unionByName(p.where("file LIKE '7%'").select(F.lit("x").alias("file"), "name")))


G16 = "SELECT (p_partkey % 90) || '.md' AS file, p_name AS name FROM part WHERE p_partkey % 90 NOT IN (SELECT s_suppkey FROM supplier) AND p_name NOT IN (SELECT p_name FROM part WHERE (p_partkey % 90) || '.md' LIKE '7%')"


def g17_session_totals(spark, sf):
    e = views.table(spark, sf, "events")
    items = e.select((C("user_id") % 50).alias("session"), _pick(C("event_id"), "insight", "promotion", "contradiction", "gap", "op").alias("kind"))
    examined = views.table(spark, sf, "orders").select((C("o_custkey") % 60).alias("session"), (C("o_orderkey") % 3 == 0).alias("examined"))
    return signals.session_totals(items, examined)


G17 = """WITH i AS (SELECT user_id % 50 AS session, event_id % 5 AS k FROM events), c AS (SELECT session, sum(CAST(k = 0 AS INT)) AS a, sum(CAST(k = 1 AS INT)) AS b, sum(CAST(k = 2 AS INT)) AS c, sum(CAST(k = 3 AS INT)) AS d, sum(CAST(k = 4 AS INT)) AS e FROM i GROUP BY session),
  x AS (SELECT o_custkey % 60 AS session, sum(CAST(o_orderkey % 3 = 0 AS INT)) AS n, count(*) AS m FROM orders GROUP BY 1)
  SELECT coalesce(c.session, x.session) AS session, CAST(coalesce(a, 0) AS BIGINT) AS n_insight, CAST(coalesce(b, 0) AS BIGINT) AS n_promotion, CAST(coalesce(c, 0) AS BIGINT) AS n_contradiction, CAST(coalesce(d, 0) AS BIGINT) AS n_gap, CAST(coalesce(e, 0) AS BIGINT) AS n_op, CAST(coalesce(n, 0) AS BIGINT) AS n_examined, coalesce(m, 0) AS n_candidates FROM c FULL JOIN x ON c.session = x.session"""


def g19_candidate_context(spark, sf):
    w = views.wiki(spark, sf).where("redirect_to IS NULL").select(C("slug").alias("candidate_id"), F.slice("sources", 1, 2).alias("uris"))
    notes = views.daily(spark, sf).select("uri", "mem_date", "text")
    week = F.concat(F.lit("weekly/"), dates.iso_week(C("mem_date")))
    edges = notes.select(week.alias("parent"), C("uri").alias("child"))
    parents = notes.groupBy(week.alias("uri")).agg(F.concat(F.lit("days: "), F.count("*").cast("string")).alias("text"))
    found = signals.candidate_context(w, notes, edges, parents)
    return found.select("candidate_id", C("n_parts").cast("long").alias("n_parts"), F.sha2("context", 256).alias("context_sha256"))


G19 = sql(
    "v_wiki v_daily",
    f"""WITH c AS (SELECT slug AS id, unnest(sources[1:2]) AS uri FROM v_wiki WHERE redirect_to IS NULL), o AS (SELECT DISTINCT id, c.uri, mem_date FROM c JOIN v_daily USING (uri)),
    d AS (SELECT DISTINCT id, mem_date + unnest([-1, 0, 1]) AS day FROM o), p AS (SELECT 'weekly/' || {_WEEK} AS uri, 'days: ' || count(*) AS text FROM v_daily GROUP BY 1),
    r AS (SELECT id, 0 AS part, uri, text FROM d JOIN v_daily ON mem_date = day UNION ALL SELECT DISTINCT id, 1, p.uri, p.text FROM o JOIN p ON p.uri = 'weekly/' || {_WEEK.replace('mem_date', 'o.mem_date')})
    SELECT id AS candidate_id, count(*) AS n_parts, sha256(string_agg('[' || uri || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY part, uri)) AS context_sha256 FROM r GROUP BY id""",
)


# --- roll-up


def a7_own_or_aggregate(spark, sf):
    e = views.edges(spark, sf).select(C("vec_id").alias("uri"), C("embedding")[0].alias("vector"))
    children = e.where("uri % 7 <> 0").select("uri").unionByName(e.select((C("uri") + 1_000_000).alias("uri")).where("uri % 11 = 0"))
    return rollup.own_or_aggregate(children, e.where("uri % 3 = 0").withColumn("vector", C("vector") + 1), e.where("uri % 5 <> 0")).select("uri", (F.round(C("vector").cast("double"), 3) + 0.0).alias("vector"))


A7 = sql("v_edges", "SELECT vec_id AS uri, round(CAST(CASE WHEN vec_id % 3 = 0 THEN embedding[1] + CAST(1 AS FLOAT) ELSE embedding[1] END AS DOUBLE), 3) + 0.0 AS vector FROM v_edges WHERE vec_id % 7 <> 0 AND (vec_id % 3 = 0 OR vec_id % 5 <> 0)")


def a8_parent_rows(spark, sf):
    parents = views.edges(spark, sf).select(C("vec_id").alias("parent"), F.lit("summary").alias("text"), C("embedding").cast("array<double>").alias("vector"))
    found = rollup.parent_rows(parents, _parents(spark, sf, "week"), "weekly")
    return found.select("uri", "content_type", "embedding_type", "text", C("period").cast("long").alias("period"), F.round(C("vector")[0], 6).alias("first"))


A8 = sql("v_edges", f"SELECT vec_id || '#summary' AS uri, 'weekly' AS content_type, 'summary' AS embedding_type, 'summary' AS text, vec_id AS period, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM v_edges UNION ALL SELECT parent || '#agg', 'weekly', 'agg', '', parent, round(x, 6) FROM {_PARENT.format(p='week')} WHERE i = 0")


def a11_typed_memories(spark, sf):
    """Model output with one note each: some heads hold risky values, some name no known kind."""
    i = C("doc_id")
    head = F.concat(F.lit("---\nname: Note: "), i.cast("string"), F.lit("\ntype: "), _pick(i, "user", "project", "odd"), F.lit("\n---\n"), "text")
    output = _docs(spark, sf).select(i.alias("id"), F.to_json(F.array(F.struct(F.when(i % 5 == 0, "a/b.md").otherwise(F.concat(F.lit("n"), i.cast("string"), F.lit(".md"))).alias("file"), head.alias("content")))).alias("text"))
    good, bad = rollup.typed_memories(output)
    return good.select("id", "file", "name", "kind", F.sha2("body", 256).alias("body_sha256"), F.lit(True).alias("good")).unionByName(bad.select("id", "file", "name", "kind", F.sha2("body", 256).alias("body_sha256"), F.lit(False).alias("good")))


A11 = """SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'a/b.md' ELSE 'n' || doc_id || '.md' END AS file, 'Note: ' || doc_id AS name, ['user', 'project', 'odd'][doc_id % 3 + 1] AS kind, sha256(trim(text, ' ')) AS body_sha256, doc_id % 3 <> 2 AND doc_id % 5 <> 0 AS good FROM documents"""


def a12_wisdom_input(spark, sf):
    w = views.wiki(spark, sf)
    typed = _docs(spark, sf).where("doc_id % 4 = 1").select(F.concat(F.lit("t-"), C("doc_id").cast("string")).alias("slug"), "text")
    months = views.daily(spark, sf).groupBy(F.date_format("mem_date", "yyyy-MM").alias("period")).agg(F.count("*").cast("string").alias("text"))
    return rollup.wisdom_input(typed, w, months).select("part", "name", F.sha2("text", 256).alias("text_sha256"))


A12 = sql("v_wiki v_daily", "SELECT 'typed' AS part, 't-' || doc_id AS name, sha256(text) AS text_sha256 FROM documents WHERE doc_id % 4 = 1 UNION ALL SELECT 'wiki', slug, sha256(body) FROM v_wiki WHERE redirect_to IS NULL UNION ALL SELECT * FROM (SELECT 'month', strftime(mem_date, '%Y-%m'), sha256(CAST(count(*) AS VARCHAR)) FROM v_daily GROUP BY ALL ORDER BY 2 DESC LIMIT 1)")


def a14_expected_weeks(spark, sf):
    months = views.daily(spark, sf).select(F.trunc("mem_date", "month").alias("month")).distinct()
    return rollup.expected_weeks(months, _weeks(spark, sf).where(F.weekofyear("week_start") % 5 != 0))


A14 = sql(
    "v_daily",
    """WITH m AS (SELECT DISTINCT strftime(mem_date, '%Y-%m') AS parent FROM v_daily), w AS (SELECT unnest(generate_series(DATE '2023-12-18', (SELECT CAST(max(mem_date) AS DATE) + 40 FROM v_daily), INTERVAL 7 DAY)) AS s),
    e AS (SELECT parent, CAST(s AS DATE) AS s FROM w JOIN m ON strftime(CAST(s AS DATE) + 3, '%Y-%m') = parent), h AS (SELECT DISTINCT CAST(date_trunc('week', mem_date) AS DATE) AS s FROM v_daily)
    SELECT parent, strftime(s, '%G-W%V') AS week, s IN (SELECT s FROM h) AND week(s) % 5 <> 0 AS present FROM e""",
)


def a16_patched_wisdom(spark, sf):
    """Lists of thirty parts, patched by every op; every fifth list is kept as it is."""
    part = views.table(spark, sf, "part")
    k, of = C("p_partkey"), F.floor(C("p_partkey") / 30).alias("list_id")
    entries = part.select(of, C("p_name").alias("title"), F.repeat(F.lit("word "), (k % 30 * 3).cast("int")).alias("body"), k.cast("int").alias("ord")).groupBy("list_id", "title").agg(F.min_by("body", "ord").alias("body"), F.min("ord").alias("ord"))
    patches = part.where("p_partkey % 4 < 3").select(of, F.when(k % 4 == 2, F.concat(F.lit("New "), k.cast("string"))).otherwise(C("p_name")).alias("title"), _pick(k % 4, "update", "remove", "add").alias("op"), F.when(k % 4 != 1, "changed").alias("body"))
    first = patches.groupBy("list_id", "title").agg(F.min(F.struct("op", "body")).alias("x")).select("list_id", "title", "x.op", "x.body")
    kept = part.where("p_partkey % 150 = 0").select(of, F.lit(None).cast("string").alias("title"), F.lit("keep_all").alias("op"), F.lit(None).cast("string").alias("body"))
    return rollup.patched(entries, first.unionByName(kept), by="list_id").select("list_id", "title", F.length("body").cast("long").alias("n_chars"))


A16 = """WITH e AS (SELECT p_partkey // 30 AS l, p_name AS title, min(p_partkey) AS k FROM part GROUP BY ALL),
  r AS (SELECT p_partkey // 30 AS l, CASE WHEN p_partkey % 4 = 2 THEN 'New ' || p_partkey ELSE p_name END AS title, min(['update', 'remove', 'add'][p_partkey % 4 + 1]) AS op FROM part WHERE p_partkey % 4 < 3 GROUP BY ALL),
  q AS (SELECT * FROM r WHERE l NOT IN (SELECT p_partkey // 30 FROM part WHERE p_partkey % 150 = 0)),
  a AS (SELECT coalesce(e.l, q.l) AS l, coalesce(e.title, q.title) AS title, coalesce(e.k, 1073741824) AS ord, CASE WHEN q.op IS NOT NULL THEN 7 ELSE 5 * (e.k % 30) * 3 END AS n FROM e FULL JOIN q ON e.l = q.l AND e.title = q.title WHERE q.op IS NULL OR q.op <> 'remove'),
  f AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY l ORDER BY ord, title) <= 20), s AS (SELECT *, sum(length(title) + n) OVER (PARTITION BY l ORDER BY ord, title ROWS UNBOUNDED PRECEDING) AS so_far FROM f)
  SELECT l AS list_id, title, CAST(n AS BIGINT) AS n_chars FROM s WHERE so_far <= 4000"""

QUERIES = {f.__name__: f for f in (t11_passage_words, t13_named_signatures, t14_proper_nouns, t26_anchored_times, t28_link_offsets, t30_salvaged, t31_range_series, t32_wisdom_entries, t33_stub_bodies, e19_marked_cells, e21_recomputed, e24_audit, e25_revisions, e30_closed_schedule, e31_session_windows, e33_active_sessions, e34_directives, e34_correction_states, e38_merged_sessions, e39_resumed, g14_page_quality, g14_followed_hits, g15_answer_flags, g16_uncovered_promotions, g17_session_totals, g19_candidate_context, a7_own_or_aggregate, a8_parent_rows, a11_typed_memories, a12_wisdom_input, a14_expected_weeks, a16_patched_wisdom)}
ORACLE_SQL = {"t11_passage_words": T11, "t13_named_signatures": T13, "t14_proper_nouns": T14, "t26_anchored_times": T26, "t28_link_offsets": T28, "t30_salvaged": T30, "t31_range_series": T31, "t32_wisdom_entries": T32, "t33_stub_bodies": T33, "e19_marked_cells": E19, "e21_recomputed": E21, "e24_audit": E24, "e25_revisions": E25, "e30_closed_schedule": E30, "e31_session_windows": E31, "e33_active_sessions": E33, "e34_directives": E34, "e34_correction_states": E34C, "e38_merged_sessions": E38, "e39_resumed": E39, "g14_page_quality": G14, "g14_followed_hits": G14F, "g15_answer_flags": G15, "g16_uncovered_promotions": G16, "g17_session_totals": G17, "g19_candidate_context": G19, "a7_own_or_aggregate": A7, "a8_parent_rows": A8, "a11_typed_memories": A11, "a12_wisdom_input": A12, "a14_expected_weeks": A14, "a16_patched_wisdom": A16}
