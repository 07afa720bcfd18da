"""Queries of page operations: batches, merges, renames, migrations, federation, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.operators import graph, retrieval
from tidelog.sources import views
from tidelog.sources.views import sql

C = F.col


def _doc(n):
    return F.concat(F.lit("doc-"), n.cast("string"))


def w2_federation(spark, sf):
    """Pages of a private and a shared wiki, and which of the ops on them may be carried out."""
    w = views.wiki(spark, sf)
    pages = graph.federated(private=w.where("doc_id % 3 > 0").select("slug"), shared=w.where("doc_id % 3 < 2").select("slug"))
    members = views.table(spark, sf, "nation").select(F.when(C("n_nationkey") % 2 == 0, "private").otherwise("shared").alias("wiki"), F.when(C("n_nationkey") % 2 == 0, "writer").otherwise("reader").alias("role"))
    done, refused = graph.writable(pages, members)
    return done.groupBy("wiki").agg(F.count("*").alias("n")).withColumn("done", F.lit(True)).unionByName(refused.groupBy("wiki").agg(F.count("*").alias("n")).withColumn("done", F.lit(False)))


W2 = "SELECT 'private' AS wiki, count(*) AS n, true AS done FROM documents WHERE doc_id % 3 > 0 UNION ALL SELECT 'shared', count(*), false FROM documents WHERE doc_id % 3 < 2"


def w1_listed(spark, sf):
    w = views.wiki(spark, sf)
    pages = graph.federated(private=w.where("doc_id % 3 > 0"), shared=w.where("doc_id % 3 < 2"))
    stubs = graph.listed(pages, category="entity", wiki="shared", stubs_only=True).select("slug", "wiki", F.lit(True).alias("stub"))
    return stubs.unionByName(graph.listed(pages, category="theme", wiki="private").select("slug", "wiki", F.lit(False).alias("stub")))


W1L = sql("v_wiki", "SELECT slug, 'shared' AS wiki, true AS stub FROM v_wiki WHERE doc_id % 3 < 2 AND category = 'entity' AND len(sources) <= 1 UNION ALL SELECT slug, 'private', false FROM v_wiki WHERE doc_id % 3 > 0 AND category = 'theme'")


def _ops(spark, sf):
    """Two ops for every second page and three for every sixth; a quarter of the pages isn't there."""
    w = views.wiki(spark, sf)
    kinds = F.array(*map(F.lit, ("append", "create", "append")))
    each = w.withColumn("seq", F.explode(F.sequence(F.lit(1), F.when(C("doc_id") % 6 == 0, 3).when(C("doc_id") % 2 == 0, 2).otherwise(1))))
    op = F.element_at(kinds, ((C("doc_id") + C("seq")) % 3 + 1).cast("int"))
    return each.select("doc_id", "slug", "seq", op.alias("op"), F.concat(F.lit("more "), C("seq").cast("string")).alias("body"), F.array(F.lit("memory/x.md"), F.concat(F.lit("memory/"), C("seq").cast("string"))).alias("sources"), F.lit("2030-01-01").cast("date").alias("on"))


_OPS = """o AS (SELECT doc_id, slug, seq, ['append', 'create', 'append'][(doc_id + seq) % 3 + 1] AS op, 'more ' || seq AS body, ['memory/x.md', 'memory/' || seq] AS sources FROM v_wiki, (SELECT unnest([1, 2, 3]) AS seq)
    WHERE seq <= CASE WHEN doc_id % 6 = 0 THEN 3 WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END),
  c AS (SELECT slug, min(seq) AS born FROM o WHERE op = 'create' GROUP BY slug),
  j AS (SELECT o.*, (op = 'create') = (o.doc_id % 4 <> 0 OR coalesce(born < seq, false)) AS refused FROM o LEFT JOIN c ON o.slug = c.slug)"""


def w3_applied_ops(spark, sf):
    pages = views.wiki(spark, sf).where("doc_id % 4 <> 0").select("slug", "body", "sources", "updated")
    found, refused = graph.applied_ops(pages, _ops(spark, sf))
    one = found.select("slug", F.sha2("body", 256).alias("body_sha256"), F.array_join("sources", ",").alias("sources"), C("updated").cast("string").alias("updated"), F.lit(0).alias("refused_seq"))
    return one.unionByName(refused.select("slug", F.lit("").alias("body_sha256"), F.lit("").alias("sources"), F.lit(None).cast("string").alias("updated"), C("seq").alias("refused_seq")))


W3 = sql(
    "v_wiki",
    f"""WITH {_OPS},
    f AS (SELECT slug, string_agg(body, chr(10) || chr(10) ORDER BY seq) AS more, list_sort(list({{'seq': seq, 's': sources}})) AS x FROM j WHERE NOT refused GROUP BY slug),
    n AS (SELECT slug, list_distinct(flatten(list_transform(x, lambda r: r.s))) AS extra, more FROM f),
    p AS (SELECT * FROM v_wiki WHERE doc_id % 4 <> 0),
    e AS (SELECT coalesce(p.slug, n.slug) AS slug, sha256(concat_ws(chr(10) || chr(10), p.body, n.more)) AS body_sha256, p.sources AS own, (SELECT list_sort(list(DISTINCT u)) FROM (SELECT unnest(list_concat(coalesce(p.sources, []), coalesce(n.extra, []))) AS u)) AS every, CASE WHEN n.slug IS NULL THEN CAST(p.updated AS VARCHAR) ELSE CAST(greatest(p.updated, DATE '2030-01-01') AS VARCHAR) END AS updated, x
      FROM p FULL JOIN n ON p.slug = n.slug LEFT JOIN f ON f.slug = n.slug)
    SELECT slug, body_sha256, array_to_string(list_concat(coalesce(own, []), list_filter((SELECT list(u ORDER BY k) FROM (SELECT u, min(k) AS k FROM (SELECT unnest(flatten(list_transform(coalesce(x, []), lambda r: r.s))) AS u, unnest(range(0, len(flatten(list_transform(coalesce(x, []), lambda r: r.s))))) AS k) GROUP BY u)), lambda v: NOT list_contains(coalesce(own, []), v))), ',') AS sources, updated, 0 AS refused_seq FROM e
    UNION ALL SELECT slug, '', '', NULL, seq FROM j WHERE refused""",
)


def w4_merged_pages(spark, sf):
    """Two pages into one target, and a chain of two merges."""
    pages = views.wiki(spark, sf).withColumn("redirect_to", F.lit(None).cast("string"))
    i = C("doc_id")
    target = F.when(i % 10 == 3, i - 1).when(i % 10 == 4, i - 2).when(i % 10 == 5, i + 2).when(i % 10 == 6, i - 1)
    merges = pages.where(target.isNotNull()).select(C("slug").alias("src"), _doc(target).alias("dst"))
    return graph.merged_pages(pages, merges).select("slug", F.sha2("body", 256).alias("body_sha256"), F.array_join("sources", ",").alias("sources"), "redirect_to")


W4 = sql(
    "v_wiki",
    """WITH m AS (SELECT *, CASE doc_id % 10 WHEN 3 THEN doc_id - 1 WHEN 4 THEN doc_id - 2 WHEN 5 THEN doc_id + 2 ELSE doc_id - 1 END AS d, CASE doc_id % 10 WHEN 3 THEN doc_id - 1 WHEN 4 THEN doc_id - 2 WHEN 5 THEN doc_id + 2 ELSE doc_id + 1 END AS t, CASE doc_id % 10 WHEN 6 THEN 2 ELSE 1 END AS hops FROM v_wiki WHERE doc_id % 10 BETWEEN 3 AND 6),
    x AS (SELECT t, string_agg(chr(10) || chr(10) || '<!-- merged from ' || slug || ' -->' || chr(10) || chr(10) || body, '' ORDER BY hops, slug) AS more FROM m GROUP BY t),
    u AS (SELECT t, list(s ORDER BY hops, slug, k) AS s FROM (SELECT t, hops, slug, unnest(sources) AS s, unnest(range(0, len(sources))) AS k FROM m) GROUP BY t),
    a AS (SELECT p.doc_id, list_concat(p.sources, u.s) AS s FROM v_wiki p JOIN u ON u.t = p.doc_id),
    b AS (SELECT doc_id, string_agg(v, ',' ORDER BY k) AS s FROM (SELECT doc_id, v, min(k) AS k FROM (SELECT doc_id, unnest(s) AS v, unnest(range(0, len(s))) AS k FROM a) GROUP BY ALL) GROUP BY doc_id)
    SELECT p.slug, sha256(CASE WHEN m.slug IS NOT NULL THEN '' ELSE p.body || coalesce(x.more, '') END) AS body_sha256, CASE WHEN m.slug IS NOT NULL THEN '' ELSE coalesce(b.s, array_to_string(p.sources, ',')) END AS sources, 'doc-' || m.d AS redirect_to
    FROM v_wiki p LEFT JOIN m ON m.doc_id = p.doc_id LEFT JOIN x ON x.t = p.doc_id LEFT JOIN b ON b.doc_id = p.doc_id""",
)


def w5_renamed(spark, sf):
    """Renames of every third page: to a free slug, a taken one, its own, a bad one, and of missing pages."""
    pages = views.wiki(spark, sf).withColumn("redirect_to", F.lit(None).cast("string"))
    i = C("doc_id")
    new = F.element_at(F.array(F.concat(F.lit("topic-"), i.cast("string")), _doc(i + 1), _doc(i), F.lit("Bad Slug")), (i % 4 + 1).cast("int"))
    slug = F.when(i % 7 == 0, F.concat(F.lit("lost-"), i.cast("string"))).otherwise(C("slug"))
    found, refused = graph.renamed(pages, pages.where("doc_id % 3 = 0").select(slug.alias("slug"), new.alias("new_slug")))
    return found.select("slug", F.length("body").cast("long").alias("n_chars"), "redirect_to", F.lit(None).cast("string").alias("reason")).unionByName(refused.select("slug", F.lit(0).cast("long").alias("n_chars"), C("new_slug").alias("redirect_to"), "reason"))


W5 = sql(
    "v_wiki",
    """WITH r AS (SELECT doc_id, body, slug AS own, CASE WHEN doc_id % 7 = 0 THEN 'lost-' || doc_id ELSE slug END AS slug, CASE doc_id % 4 WHEN 0 THEN 'topic-' || doc_id WHEN 1 THEN 'doc-' || (doc_id + 1) WHEN 2 THEN slug ELSE 'Bad Slug' END AS new_slug FROM v_wiki WHERE doc_id % 3 = 0),
    j AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN 'no such page' WHEN doc_id % 4 = 2 THEN 'same slug' WHEN doc_id % 4 = 3 THEN 'bad slug' WHEN doc_id % 4 = 1 AND 'doc-' || (doc_id + 1) IN (SELECT slug FROM v_wiki) THEN 'taken' END AS reason FROM r)
    SELECT coalesce(j.new_slug, p.slug) AS slug, length(p.body) AS n_chars, NULL AS redirect_to, NULL AS reason FROM v_wiki p LEFT JOIN j ON j.own = p.slug AND j.reason IS NULL
    UNION ALL SELECT slug, 0, new_slug, NULL FROM j WHERE reason IS NULL UNION ALL SELECT slug, 0, new_slug, reason FROM j WHERE reason IS NOT NULL""",
)


def w8_orphans_with_related(spark, sf):
    pages = views.wiki(spark, sf).withColumn("related", F.when(C("doc_id") % 4 == 0, F.array(_doc(C("doc_id") + 5), C("slug"))).otherwise(F.array().cast("array<string>")))
    return graph.orphans(pages)


_LINKS = r"(SELECT DISTINCT slug, regexp_replace(unnest(regexp_extract_all(body, '\[\[([^\]|]+)', 1)), '^[A-Za-z0-9_-]+:', '') AS target FROM v_wiki)"
W8R = sql("v_wiki", f"SELECT slug FROM v_wiki WHERE redirect_to IS NULL AND slug NOT IN (SELECT target FROM {_LINKS} WHERE slug <> target UNION ALL SELECT 'doc-' || (doc_id + 5) FROM documents WHERE doc_id % 4 = 0)")


def w10_unknown_wikis(spark, sf):
    pages = views.wiki(spark, sf).withColumn("body", F.concat("body", F.lit(" [[team"), (C("doc_id") % 3).cast("string"), F.lit(":x]]")))
    return graph.unknown_wikis(pages, ("wiki", "team1"))


W10U = "SELECT 'doc-' || doc_id AS slug, 'team' || (doc_id % 3) AS wiki FROM documents WHERE doc_id % 3 <> 1"


def w14_create_or_update(spark, sf):
    """Candidate pages are the vectors whose id is divisible by 20; the pages are all vectors but the
    candidate's own. The second best is taken where the best is the candidate itself."""
    v = views.edges(spark, sf).select(C("vec_id"), _unit(C("embedding")).alias("vector"))
    candidates = v.where("vec_id % 20 = 0").select(C("vec_id").alias("query_id"), "vector")
    near = retrieval.nearest(candidates, v.select(C("vec_id").alias("uri"), "vector"), 2).where("uri <> query_id")
    near = retrieval.top(near, 1, C("score").desc(), C("uri"))
    return graph.create_or_update(candidates.select("query_id"), near.withColumn("score", F.round("score", 6)))


def _unit(v):
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0))


W14 = sql(
    "v_edges",
    """WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM v_edges), s AS (SELECT q.vec_id AS query_id, c.vec_id AS page, round(list_dot_product(q.v, c.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(c.v, c.v)), 6) AS score FROM u q, u c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, c.v) / sqrt(list_dot_product(c.v, c.v)) DESC, c.vec_id) = 1)
    SELECT query_id, CASE WHEN score >= 0.8 THEN page END AS page, CASE WHEN score >= 0.8 THEN 'update' ELSE 'create' END AS op FROM s""",
)


def _batch(spark, sf):
    kinds = F.array(*map(F.lit, ("update", "create", "contradict", "erase")))
    ops = _ops(spark, sf)
    return ops.withColumns({"op": F.element_at(kinds, ((C("doc_id") + C("seq") * 3) % 4 + 1).cast("int")), "other": _doc(C("doc_id") + C("seq"))})


def w16_applied_batch(spark, sf):
    pages = views.wiki(spark, sf).where("doc_id % 4 <> 0").select("slug", "body", "sources", "updated", F.array().cast("array<string>").alias("contradicts"))
    found, report = graph.applied_batch(pages, _batch(spark, sf))
    one = found.select("slug", F.lit(0).alias("seq"), F.array_join("contradicts", ",").alias("what"), F.length("body").cast("long").alias("n_chars"), F.size("sources").cast("long").alias("n_sources"), F.lit(True).alias("ok"))
    return one.unionByName(report.select("slug", "seq", F.concat_ws(": ", "op", "detail").alias("what"), F.lit(0).cast("long").alias("n_chars"), F.lit(0).cast("long").alias("n_sources"), "ok"))


W16 = sql(
    "v_wiki",
    f"""WITH {_OPS.split('c AS')[0].replace("['append', 'create', 'append'][(doc_id + seq) % 3 + 1]", "['update', 'create', 'contradict', 'erase'][(doc_id + seq * 3) % 4 + 1]")}
    c AS (SELECT slug, min(seq) AS born FROM o WHERE op = 'create' GROUP BY slug),
    j AS (SELECT o.*, o.doc_id % 4 <> 0 OR coalesce(born < seq, false) AS there FROM o LEFT JOIN c ON o.slug = c.slug),
    k AS (SELECT *, op <> 'erase' AND (op = 'create' OR there) AS ok, CASE WHEN op = 'erase' THEN 'unknown op' WHEN op <> 'create' AND NOT there THEN 'no such page' WHEN op = 'create' AND NOT there THEN 'created' WHEN op = 'contradict' THEN 'marked' ELSE 'appended' END AS detail FROM j),
    f AS (SELECT slug, string_agg(body, chr(10) || chr(10) ORDER BY seq) FILTER (op <> 'contradict') AS more, count(*) FILTER (op <> 'contradict') AS n_text, string_agg('doc-' || (doc_id + seq), ',' ORDER BY 'doc-' || (doc_id + seq)) FILTER (op = 'contradict') AS what FROM k WHERE ok GROUP BY slug),
    p AS (SELECT * FROM v_wiki WHERE doc_id % 4 <> 0)
    SELECT coalesce(p.slug, f.slug) AS slug, 0 AS seq, coalesce(what, '') AS what, CAST(length(concat_ws(chr(10) || chr(10), p.body, f.more)) AS BIGINT) AS n_chars, CAST(coalesce(len(p.sources), 0) + CASE WHEN coalesce(n_text, 0) > 0 THEN n_text + 1 ELSE 0 END AS BIGINT) AS n_sources, true AS ok FROM p FULL JOIN f ON p.slug = f.slug
    UNION ALL SELECT slug, seq, op || ': ' || detail, 0, 0, ok FROM k""",
)


def w17_migrated(spark, sf):
    """Typed notes, some of whose slugs are pages already and some of which were migrated before."""
    kinds = F.array(*map(F.lit, ("user", "feedback", "project", "reference")))
    w = views.wiki(spark, sf)
    typed = w.select("slug", F.element_at(kinds, (C("doc_id") % 4 + 1).cast("int")).alias("kind"), F.when(C("doc_id") % 3 == 0, "none").otherwise(F.concat_ws(" ", "sources")).alias("text"))
    found = graph.migrated(typed, w.where("doc_id % 5 = 0"), w.where("doc_id % 7 = 0"))
    return found.select("slug", "category", F.array_join("sources", ",").alias("sources"))


W17 = sql("v_wiki", "SELECT CASE WHEN doc_id % 5 = 0 THEN slug || '-' || k ELSE slug END AS slug, k AS category, CASE WHEN doc_id % 3 = 0 THEN 'migration:' || slug ELSE array_to_string(sources, ',') END AS sources FROM (SELECT *, ['entity', 'concept', 'project', 'reference'][doc_id % 4 + 1] AS k FROM v_wiki) WHERE doc_id % 7 <> 0")


def w18_themes_of_insights(spark, sf):
    insights = views.table(spark, sf, "part").select(F.concat("p_type", F.lit(" & "), "p_brand").alias("name"), C("p_name").alias("body"), F.array(C("p_size").cast("string")).alias("sources"))
    pages = views.table(spark, sf, "part").where("p_partkey % 5 = 0").select(F.btrim(F.regexp_replace(F.lower(F.concat("p_type", F.lit(" & "), "p_brand")), "[^a-z0-9]+", "-"), F.lit("-")).alias("slug")).distinct()
    return graph.themes_of_insights(insights.groupBy("name").agg(F.min("body").alias("body"), F.array_sort(F.flatten(F.collect_set("sources"))).alias("sources")), pages).select("slug", "category", "name", "body", F.array_join("sources", ",").alias("sources"))


W18 = """WITH i AS (SELECT p_type || ' & ' || p_brand AS name, min(p_name) AS body, list_sort(list(DISTINCT CAST(p_size AS VARCHAR))) AS s FROM part GROUP BY 1), g AS (SELECT *, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM i)
  SELECT slug, 'theme' AS category, name, body, array_to_string(s, ',') AS sources FROM g WHERE slug NOT IN (SELECT trim(regexp_replace(lower(p_type || ' & ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') FROM part WHERE p_partkey % 5 = 0) QUALIFY row_number() OVER (PARTITION BY slug ORDER BY name) = 1"""


def w20_due_for_rebuild(spark, sf):
    found = graph.due_for_rebuild(views.wiki(spark, sf), views.daily(spark, sf))
    return found.select("slug", C("n_found").cast("long").alias("n_found"), F.sha2("texts", 256).alias("texts_sha256"))


W20 = sql("v_wiki v_daily", "WITH e AS (SELECT slug, unnest(sources) AS uri FROM v_wiki WHERE redirect_to IS NULL AND len(sources) >= 3) SELECT slug, count(*) AS n_found, sha256(string_agg(text, chr(10) || chr(10) ORDER BY uri)) AS texts_sha256 FROM e JOIN v_daily USING (uri) GROUP BY slug")


def w21_grounding(spark, sf):
    status = F.element_at(F.array(*map(F.lit, ("grounded", "unverified", "stale", "grounded"))), (C("l_linenumber") % 4 + 1).cast("int"))
    claims = views.table(spark, sf, "lineitem").select(_doc(C("l_partkey") % 500).alias("slug"), status.alias("status"))
    return graph.grounding(claims)


W21 = """SELECT 'doc-' || (l_partkey % 500) AS slug, CAST(sum(CAST(l_linenumber % 4 IN (0, 3) AS INT)) AS BIGINT) AS grounded, CAST(sum(CAST(l_linenumber % 4 = 1 AS INT)) AS BIGINT) AS unverified, CAST(sum(CAST(l_linenumber % 4 = 2 AS INT)) AS BIGINT) AS stale FROM lineitem GROUP BY 1"""


def w22_federated_hits(spark, sf):
    hits = views.hits(spark, sf).groupBy(C("query").alias("query_id"), "uri").agg(F.max("score").alias("score"))
    n = F.dayofmonth(F.regexp_extract("uri", r"\d{4}-\d{2}-\d{2}", 0).cast("date"))
    placed = hits.withColumns({"silo": F.concat(F.lit("s"), (n % 3).cast("string")), "tier": F.element_at(F.array(*map(F.lit, graph.TIER_BOOSTS)), (n % 4 % 3 + 1).cast("int"))})
    found = graph.federated_hits(placed, F.lit("s1"))
    return retrieval.top(found.select("query_id", "uri", "tier", F.round("score", 9).alias("score")), 5, C("score").desc(), C("uri"))


W22 = sql(
    "v_hits",
    """WITH b AS (SELECT query AS query_id, uri, max(score) AS score, day(CAST(regexp_extract(uri, '[0-9-]{10}') AS DATE)) AS n FROM v_hits GROUP BY ALL),
    t AS (SELECT *, ['log', 'page', 'shared'][n % 4 % 3 + 1] AS tier FROM b), f AS (SELECT query_id, uri, tier, round(score * CASE tier WHEN 'log' THEN 1.0 WHEN 'page' THEN 1.3 ELSE 1.4 END, 9) AS score FROM t WHERE tier = 'shared' OR n % 3 = 1)
    SELECT query_id, uri, tier, CAST(score AS DOUBLE) AS score FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, uri) <= 5""",
)


def w23_promotion_gates(spark, sf):
    i = C("doc_id")
    people = lambda n: F.transform(F.sequence(F.lit(0), n), lambda k: F.concat(F.lit("p"), k.cast("string")))
    candidates = views.wiki(spark, sf).select(
        "slug", (i % 3 == 0).alias("isolated"), (i % 2 == 0).alias("sensitive"), F.regexp_count("body", F.lit("-1")).alias("secrets"), F.element_at(F.array(*map(F.lit, ("low", "medium", "high"))), (i % 3 + 1).cast("int")).alias("confidence"),
        (i % 5).alias("n_silos"), people((i % 6).cast("int")).alias("participants"), people((i % 4).cast("int")).alias("readers"),
    )
    return graph.promotion_gates(candidates).select("slug", "gate", "decision")


_GATE = """CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'isolation' WHEN contains(body, '-1') THEN 'secrets' WHEN doc_id % 3 = 0 THEN 'confidence' WHEN doc_id % 5 < 2 THEN 'frequency' WHEN (least(doc_id % 6, doc_id % 4) + 1) / (doc_id % 6 + 1) < 0.5 THEN 'participants' END"""
W23 = sql("v_wiki", f"SELECT slug, gate, CASE WHEN gate IS NULL THEN 'allow' WHEN gate = 'secrets' THEN 'redact' ELSE 'block' END AS decision FROM (SELECT slug, {_GATE} AS gate FROM v_wiki)")


def w24_retracted(spark, sf):
    failing = w23_promotion_gates(spark, sf).where("decision = 'block'")
    return graph.retracted(views.wiki(spark, sf), failing, "v2").select("slug", F.length("body").cast("long").alias("n_chars"), "status", "policy")


W24 = sql("v_wiki", f"SELECT slug, CASE WHEN bad THEN 0 ELSE length(body) END AS n_chars, CASE WHEN bad THEN 'retracted' ELSE 'live' END AS status, CASE WHEN bad THEN 'v2' END AS policy FROM (SELECT slug, body, coalesce({_GATE} <> 'secrets', false) AS bad FROM v_wiki)")


def w25_drill_down(spark, sf):
    n = C("n_nationkey")
    silos = views.table(spark, sf, "nation").select(F.concat(F.lit("s"), n.cast("string")).alias("silo"), (n % 7 == 0).alias("isolated"), (n % 5 == 0).alias("sensitive"), F.transform(F.sequence(n % 4, n % 4 + n % 3), lambda k: k.cast("string")).alias("participants"))
    pointers = views.table(spark, sf, "orders").select(C("o_orderkey").cast("string").alias("uri"), F.concat(F.lit("s"), (C("o_custkey") % 25).cast("string")).alias("silo"), F.concat(F.lit("s"), (C("o_orderkey") % 25).cast("string")).alias("reader"))
    return graph.drill_down(pointers, silos)


W25 = """WITH s AS (SELECT n_nationkey AS n, list_transform(range(n_nationkey % 4, n_nationkey % 4 + n_nationkey % 3 + 1), lambda k: k) AS p FROM nation)
  SELECT CAST(o_orderkey AS VARCHAR) AS uri, 's' || a.n AS silo, 's' || b.n AS reader, a.n = b.n OR (a.n % 7 <> 0 AND a.n % 5 <> 0 AND len(list_intersect(a.p, b.p)) / len(a.p) >= 0.5) AS allowed
  FROM orders JOIN s a ON a.n = o_custkey % 25 JOIN s b ON b.n = o_orderkey % 25"""

QUERIES = {f.__name__: f for f in (w1_listed, w2_federation, w3_applied_ops, w4_merged_pages, w5_renamed, w8_orphans_with_related, w10_unknown_wikis, w14_create_or_update, w16_applied_batch, w17_migrated, w18_themes_of_insights, w20_due_for_rebuild, w21_grounding, w22_federated_hits, w23_promotion_gates, w24_retracted, w25_drill_down)}
ORACLE_SQL = {"w1_listed": W1L, "w2_federation": W2, "w3_applied_ops": W3, "w4_merged_pages": W4, "w5_renamed": W5, "w8_orphans_with_related": W8R, "w10_unknown_wikis": W10U, "w14_create_or_update": W14, "w16_applied_batch": W16, "w17_migrated": W17, "w18_themes_of_insights": W18, "w20_due_for_rebuild": W20, "w21_grounding": W21, "w22_federated_hits": W22, "w23_promotion_gates": W23, "w24_retracted": W24, "w25_drill_down": W25}
