"""Upkeep of a page graph: links, redirects, lint, near-duplicates, indexes.

Pages are rows (slug, name, category, sources, redirect_to, contradicts, updated, body)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import text
from tidelog.sources.scratch import settled

C = F.col

#: Redirects are followed so far; a longer chain is a cycle or an error.
MOST_REDIRECTS = 5


def stubs(pages: DataFrame) -> DataFrame:
    return pages.where(F.size("sources") <= 1)


def listed(pages: DataFrame, category: str | None = None, wiki: str | None = None, stubs_only: bool = False) -> DataFrame:
    """Pages of one category and one wiki, or of all; all of them or the stubs among them."""
    for column, wanted in (("category", category), ("wiki", wiki)):
        if wanted is not None:
            pages = pages.where(C(column) == wanted)
    return stubs(pages) if stubs_only else pages


def body_links(pages: DataFrame) -> DataFrame:
    """slug, target of the links in page bodies."""
    return pages.select("slug", F.explode(text.links(C("body"))).alias("target"))


def _ends(step: DataFrame) -> DataFrame:
    """Where chains of step(at, next) lead: at, target, hops; target is null for a cycle or a chain that
    is too long. The depth is fixed, so this is a fixed number of joins."""
    chain = step.select("at", C("next").alias("target"), F.lit(1).alias("hops"))
    onward = step.select(C("at").alias("target"), C("next").alias("onward"))
    for _ in range(MOST_REDIRECTS - 1):
        chain = chain.join(onward, "target", "left").select("at", F.coalesce("onward", "target").alias("target"), (C("hops") + C("onward").isNotNull().cast("int")).alias("hops"))
    return chain.join(onward, "target", "left").select("at", F.when(C("onward").isNull(), C("target")).alias("target"), "hops")


def resolved_redirects(pages: DataFrame) -> DataFrame:
    """Where each redirect leads in the end: slug, target, hops."""
    step = pages.where("redirect_to IS NOT NULL").select(C("slug").alias("at"), C("redirect_to").alias("next"))
    return _ends(step).withColumnRenamed("at", "slug")


def broken_links(pages: DataFrame) -> DataFrame:
    return body_links(pages).join(pages.select(C("slug").alias("target")), "target", "left_anti").select("slug", "target")


def orphans(pages: DataFrame) -> DataFrame:
    """Pages that nothing links to in its body or names in its `related` list, where pages have one;
    redirects are exempt, links to oneself don't count."""
    edges = body_links(pages)
    if "related" in pages.columns:
        edges = edges.unionByName(pages.select("slug", F.explode("related").alias("target")))
    inbound = edges.where("slug <> target").select(C("target").alias("slug")).distinct()
    return pages.where("redirect_to IS NULL").join(inbound, "slug", "left_anti").select("slug")


def newest_source(sources: Column) -> Column:
    return F.array_max(F.transform(sources, lambda s: F.try_to_date(F.regexp_extract(s, r"\d{4}-\d{2}-\d{2}", 0), "yyyy-MM-dd")))


def stale_pages(pages: DataFrame, as_of: Column, after: int = 90) -> DataFrame:
    return pages.withColumn("newest", newest_source(C("sources"))).where(F.datediff(as_of, "newest") > after).select("slug", F.datediff(as_of, "newest").alias("days_old"))


def mutual_contradictions(pages: DataFrame) -> DataFrame:
    """Pairs of pages that contradict each other, each once."""
    edges = pages.where("contradicts IS NOT NULL").select(C("slug").alias("a"), C("contradicts").alias("b"))
    back = edges.select(C("a").alias("b"), C("b").alias("a"))
    return edges.join(back, ["a", "b"], "left_semi").where("a < b").select("a", "b")


def rename_candidates(pages: DataFrame, least_sources: int = 3, least_share: float = 0.5) -> DataFrame:
    """Pages with so many sources each whose source sets overlap: a, b, jaccard.

    Pages of one whole source set are a class, and the smallest slug stands for it: each other member
    comes as a pair with it, of share 1, and classes that overlap come as one pair of those that stand for
    them. So two pages overlap when their classes are one, or a pair; nothing is lost, and a set that
    very many pages have does not multiply. With the sources of each set in order of how many sets hold them, sets that overlap enough
    share one of their first n - ceil(share n) + 1: only these meet in a join, so a source that very
    many sets hold meets hardly any. The pairs are verified on the whole sets."""
    sets = pages.where(C("redirect_to").isNull() & (F.size(F.array_distinct("sources")) >= least_sources)).select("slug", F.array_sort(F.array_distinct("sources")).alias("sources"))
    sets = sets.withColumn("class", F.sha2(F.to_json("sources"), 256))
    groups = settled(sets.groupBy("class").agg(F.min("slug").alias("slug"), F.any_value("sources").alias("sources")))
    few = groups.select("class", C("slug").alias("a"))
    members = sets.select("class", C("slug").alias("b")).join(few, "class").where("b <> a").select("a", "b", F.lit(1.0).alias("jaccard"))
    each = groups.select("slug", F.explode("sources").alias("source"))
    held = each.groupBy("source").agg(F.count("*").alias("n_sets"))
    ordered = each.join(held, "source").groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("n_sets", "source"))).alias("x"))
    prefix = F.slice(F.transform("x", lambda r: r["source"]), 1, F.size("x") - F.ceil(F.lit(least_share) * F.size("x")).cast("int") + 1)
    first = ordered.select("slug", F.transform("x", lambda r: r["source"]).alias("all"), F.explode(prefix).alias("source"))
    left, right = first.select(C("slug").alias("a"), C("all").alias("all_a"), "source"), first.select(C("slug").alias("b"), C("all").alias("all_b"), "source")
    fitting = (F.size("all_a") >= least_share * F.size("all_b")) & (F.size("all_b") >= least_share * F.size("all_a"))
    pairs = left.join(right, "source").where((C("a") < C("b")) & fitting).dropDuplicates(["a", "b"])
    common = F.size(F.array_intersect("all_a", "all_b"))
    share = common / (F.size("all_a") + F.size("all_b") - common)
    return pairs.select("a", "b", share.alias("jaccard")).where(C("jaccard") >= least_share).unionByName(members)


def category_index(pages: DataFrame) -> DataFrame:
    return pages.where("redirect_to IS NULL").groupBy("category").agg(F.count("*").alias("n_pages"), F.sum(F.size("sources")).alias("n_sources"))


def due_for_rebuild(pages: DataFrame, memory: DataFrame, least: int = 3) -> DataFrame:
    """Pages with enough sources, with the texts of those sources that exist, in order of their uris."""
    each = pages.where(C("redirect_to").isNull() & (F.size("sources") >= least)).select("slug", F.explode(F.array_distinct("sources")).alias("uri"))
    found = each.join(memory.select("uri", "text"), "uri").groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("uri", "text"))).alias("x"))
    return found.select("slug", F.size("x").alias("n_found"), F.array_join(F.transform("x", lambda r: r["text"]), "\n\n").alias("texts"))


def merged_pages(pages: DataFrame, merges: DataFrame) -> DataFrame:
    """pages after merges(src, dst): the last page of each chain takes the bodies, behind a marker, and
    the sources of those before it, nearest first; these become redirects to their own targets. A merge
    into a page that isn't there, into itself or in a cycle is left out; of several targets of one page
    the first one counts."""
    step = merges.where("src <> dst").groupBy(C("src").alias("at")).agg(F.min("dst").alias("next"))
    there = pages.select("slug")
    step = step.join(there.withColumnRenamed("slug", "at"), "at", "left_semi").join(there.withColumnRenamed("slug", "next"), "next", "left_semi")
    ends = _ends(step).where("target IS NOT NULL")
    moved = ends.join(pages.select(C("slug").alias("at"), C("body").alias("b"), C("sources").alias("s")), "at")
    taken = moved.groupBy(C("target").alias("slug")).agg(F.array_sort(F.collect_list(F.struct("hops", "at", "b", "s"))).alias("x"))
    gone = ends.join(step, "at").select(C("at").alias("slug"), C("next").alias("goes_to"))
    marked = lambda r: F.concat(F.lit("\n\n<!-- merged from "), r["at"], F.lit(" -->\n\n"), r["b"])
    body = F.when(C("goes_to").isNotNull(), "").when(C("x").isNull(), C("body")).otherwise(F.concat("body", F.array_join(F.transform("x", marked), "")))
    sources = F.when(C("goes_to").isNotNull(), F.array().cast("array<string>")).when(C("x").isNull(), C("sources")).otherwise(F.array_distinct(F.concat("sources", F.flatten(F.transform("x", lambda r: r["s"])))))
    return pages.join(taken, "slug", "left").join(gone, "slug", "left").select("slug", body.alias("body"), sources.alias("sources"), F.coalesce("goes_to", "redirect_to").alias("redirect_to"))


def _folded(pages: DataFrame, usable: DataFrame) -> DataFrame:
    """pages(slug, body, sources, updated) with the bodies and sources of ops in order of seq, and the latest date
    of the page and its ops."""
    none = F.array().cast("array<string>")
    new = usable.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("seq", C("body").alias("b"), C("sources").alias("s")))).alias("x"), F.max("on").alias("on"))
    more = F.array_join(F.filter(F.transform("x", lambda r: r["b"]), lambda b: b.isNotNull()), "\n\n")
    united = F.array_distinct(F.concat(F.coalesce("sources", none), F.coalesce(F.flatten(F.transform("x", lambda r: F.coalesce(r["s"], none))), none)))
    return pages.join(new, "slug", "full_outer").select("slug", F.concat_ws("\n\n", "body", F.when(more != "", more)).alias("body"), united.alias("sources"), F.greatest("updated", "on").alias("updated"))


def applied_ops(pages: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pages(slug, body, sources, updated) after ops(slug, seq, op, body, sources, on), in order of seq for
    each slug: create of a page that exists or was created before is refused, as is append on one that neither
    exists nor was created before. Gives the pages and the refused ops."""
    born = ops.where("op = 'create'").groupBy("slug").agg(F.min("seq").alias("born"))
    known = pages.select("slug", F.lit(True).alias("known"))
    judged = ops.join(born, "slug", "left").join(known, "slug", "left")
    there = F.coalesce(C("known") | (C("born") < C("seq")), F.lit(False))
    refused = F.coalesce((C("op") == "create") == there, F.lit(False))
    judged = judged.withColumn("refused", refused)
    return _folded(pages, judged.where("NOT refused")), judged.where("refused").select("slug", "seq", "op")


def applied_batch(pages: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pages(slug, body, sources, updated, contradicts) after ops(slug, seq, op, body, sources, other, on)
    of the kinds create, update and contradict. Nothing fails: the report(slug, seq, op, ok, detail) says
    of each op whether it was done."""
    born = ops.where("op = 'create'").groupBy("slug").agg(F.min("seq").alias("born"))
    judged = ops.join(born, "slug", "left").join(pages.select("slug", F.lit(True).alias("known")), "slug", "left")
    there = F.coalesce(C("known") | (C("born") < C("seq")), F.lit(False))
    known_op = F.coalesce(C("op").isin("create", "update", "contradict"), F.lit(False))
    ok = known_op & ((C("op") == "create") | there)
    detail = F.when(~known_op, "unknown op").when(~ok, "no such page").when((C("op") == "create") & ~there, "created").when(C("op") == "contradict", "marked").otherwise("appended")
    judged = judged.withColumns({"ok": ok, "detail": detail})
    named = judged.where("ok AND op = 'contradict'").groupBy("slug").agg(F.array_sort(F.collect_set("other")).alias("more"))
    text_ops = judged.where("ok").withColumns({"body": F.when(C("op") != "contradict", C("body")), "sources": F.when(C("op") != "contradict", C("sources"))})
    done = _folded(pages, text_ops).join(pages.select("slug", "contradicts"), "slug", "left").join(named, "slug", "left")
    none = F.array().cast("array<string>")
    return done.select("slug", "body", "sources", "updated", F.array_distinct(F.concat(F.coalesce("contradicts", none), F.coalesce("more", none))).alias("contradicts")), judged.select("slug", "seq", "op", "ok", "detail")


def renamed(pages: DataFrame, renames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pages(slug, body, sources, redirect_to) after renames(slug, new_slug): the page moves and a redirect
    stays. Refused, with a reason: a page that isn't there, its own slug, a bad slug, a slug that a page
    has or that another rename takes first."""
    here = pages.select("slug", F.lit(True).alias("here"))
    taken = pages.select(C("slug").alias("new_slug"), F.lit(True).alias("taken"))
    first = renames.groupBy("new_slug").agg(F.min("slug").alias("first"))
    once = renames.groupBy("slug").agg(F.min("new_slug").alias("only"))
    judged = renames.join(here, "slug", "left").join(taken, "new_slug", "left").join(first, "new_slug").join(once, "slug")
    reason = F.when(C("here").isNull(), "no such page").when(C("slug") == C("new_slug"), "same slug").when(~text.valid_slug(C("new_slug")), "bad slug").when(C("taken") | (C("first") != C("slug")) | (C("only") != C("new_slug")), "taken")
    judged = judged.withColumn("reason", reason).select("slug", "new_slug", "reason")
    moves = judged.where("reason IS NULL").select("slug", "new_slug")
    both = pages.join(moves, "slug", "left")
    after = both.select(F.coalesce("new_slug", "slug").alias("slug"), "body", "sources", "redirect_to")
    left = moves.select("slug", F.lit("").alias("body"), F.array().cast("array<string>").alias("sources"), C("new_slug").alias("redirect_to"))
    return after.unionByName(left), judged.where("reason IS NOT NULL")


def federated(**wikis: DataFrame) -> DataFrame:
    """Pages of several wikis, each with the name of its wiki."""
    parts = [df.withColumn("wiki", F.lit(name)) for name, df in wikis.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def writable(ops: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ops(wiki, …) that members(wiki, role) may carry out, and the others: readers can't write."""
    allowed = members.where("role <> 'reader'").select("wiki").distinct()
    return ops.join(F.broadcast(allowed), "wiki", "left_semi"), ops.join(F.broadcast(allowed), "wiki", "left_anti")


def unknown_wikis(pages: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """slug, wiki of links [[wiki:slug]] to a wiki that isn't known."""
    prefix = F.filter(text.found(C("body"), r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]", 1), lambda x: x.rlike("^[A-Za-z0-9_-]+:"))
    each = pages.select("slug", F.explode(F.array_distinct(F.transform(prefix, lambda x: F.regexp_extract(x, "^([A-Za-z0-9_-]+):", 1)))).alias("wiki"))
    return each.where(~C("wiki").isin(*known))


def create_or_update(candidates: DataFrame, nearest_pages: DataFrame, least: float = 0.8) -> DataFrame:
    """candidates(query_id, …) with their best page of nearest_pages(query_id, uri, score): from a cosine
    of `least` on, create becomes an update of that page."""
    near = nearest_pages.where(C("score") >= least).select("query_id", C("uri").alias("page"))
    return candidates.join(near, "query_id", "left").withColumn("op", F.when(C("page").isNull(), "create").otherwise("update"))


def themes_of_insights(insights: DataFrame, pages: DataFrame) -> DataFrame:
    """Theme pages of insights(name, body, sources) that don't have one: running it again adds nothing."""
    slug = F.btrim(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-"), F.lit("-"))
    new = insights.select(slug.alias("slug"), F.lit("theme").alias("category"), "name", "body", "sources")
    first = new.groupBy("slug").agg(F.min_by(F.struct("category", "name", "body", "sources"), "name").alias("x"))
    return first.join(pages.select("slug"), "slug", "left_anti").select("slug", "x.*")


def grounding(claims: DataFrame) -> DataFrame:
    """claims(slug, status): how many of each page are grounded, unverified or stale."""
    count = lambda status: F.sum((C("status") == status).cast("int"))
    return claims.groupBy("slug").agg(*(count(x).alias(x) for x in ("grounded", "unverified", "stale")))


#: Boosts of a conversation's logs and pages and of the pages that all conversations share.
TIER_BOOSTS = {"log": 1.0, "page": 1.3, "shared": 1.4}


def federated_hits(hits: DataFrame, reader: Column) -> DataFrame:
    """hits(query_id, uri, score, silo, tier) that a reader's silo may see, its own and the shared tier,
    with the boost of their tier."""
    boost = F.lit(None).cast("double")
    for tier, value in TIER_BOOSTS.items():
        boost = F.when(C("tier") == tier, value).otherwise(boost)
    return hits.where((C("tier") == "shared") | (C("silo") == reader)).withColumn("score", C("score") * boost)


def promotion_gates(candidates: DataFrame, least_silos: int = 2, least_overlap: float = 0.5) -> DataFrame:
    """allow, redact or block for candidates(slug, isolated, sensitive, secrets, confidence, n_silos,
    participants, readers), by the first gate that decides; the gate is named."""
    overlap = F.size(F.array_intersect("participants", "readers")) / F.greatest(F.size("participants"), F.lit(1))
    rules = [
        (C("isolated") & C("sensitive"), "isolation", "block"),
        (C("secrets") > 0, "secrets", "redact"),
        (F.coalesce(C("confidence") == "low", F.lit(True)), "confidence", "block"),
        (C("n_silos") < least_silos, "frequency", "block"),
        (overlap < least_overlap, "participants", "block"),
    ]
    gate, decision = F.lit(None).cast("string"), F.lit("allow")
    for test, name, result in reversed(rules):
        gate, decision = F.when(test, name).otherwise(gate), F.when(test, result).otherwise(decision)
    return candidates.withColumns({"gate": gate, "decision": decision})


def retracted(pages: DataFrame, failing: DataFrame, policy: str) -> DataFrame:
    """pages(slug, body, …) with a tombstone in place of those that fail the policy."""
    gone = failing.select("slug", F.lit(True).alias("fails")).distinct()
    marked = pages.join(gone, "slug", "left")
    return marked.select("slug", F.when(C("fails"), "").otherwise(C("body")).alias("body"), F.when(C("fails"), "retracted").otherwise("live").alias("status"), F.when(C("fails"), policy).alias("policy"))


def drill_down(pointers: DataFrame, silos: DataFrame, least_overlap: float = 0.5) -> DataFrame:
    """pointers(uri, silo, reader) with `allowed`: always inside a silo; into another one when it is
    neither isolated nor sensitive and enough of its silos(silo, isolated, sensitive, participants)
    participants are the reader's."""
    source = silos.select("silo", "isolated", "sensitive", C("participants").alias("there"))
    own = silos.select(C("silo").alias("reader"), C("participants").alias("here"))
    overlap = F.size(F.array_intersect("there", "here")) / F.greatest(F.size("there"), F.lit(1))
    open_ = ~C("isolated") & ~C("sensitive") & (overlap >= least_overlap)
    joined = pointers.join(source, "silo", "left").join(own, "reader", "left")
    return joined.select("uri", "silo", "reader", ((C("silo") == C("reader")) | F.coalesce(open_, F.lit(False))).alias("allowed"))


def first_supersessions(claims: DataFrame) -> DataFrame:
    """One superseded claim for each page and source: the earliest one."""
    return claims.groupBy("slug", "source").agg(F.min(F.struct("superseded_on", "fact")).alias("x")).select("slug", "source", "x.fact", "x.superseded_on")


def trajectories(claims: DataFrame, least: int = 2) -> DataFrame:
    """Pages with at least so many superseded claims: their chronology and their sources."""
    rows = claims.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("superseded_on", "fact"))).alias("x"), F.array_sort(F.collect_set("source")).alias("sources")).where(F.size("x") >= least)
    return rows.select("slug", F.array_join(F.transform("x", lambda r: F.concat(r["superseded_on"].cast("string"), F.lit(": "), r["fact"])), "; ").alias("chronology"), "sources")


def lint_counts(pages: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """How many pages have a slug that drifted from the name, no known category, or were looked at."""
    drift = F.regexp_replace(F.lower(F.trim("name")), r"[^a-z0-9]+", "-") != C("slug")
    return pages.agg(F.count("*").alias("n_scanned"), F.sum(drift.cast("int")).alias("n_drifted"), F.sum((C("category").isNull() | ~C("category").isin(*known)).cast("int")).alias("n_uncategorised"))


def migrated(typed: DataFrame, pages: DataFrame | None = None, archived: DataFrame | None = None) -> DataFrame:
    """Typed notes(slug, kind, text) as pages: user -> entity, feedback -> concept, others keep their kind;
    sources are the dates in the text, in order, else the note itself. A slug that one of the pages has
    gets the category behind it; notes that are archived(slug) already are left out, so that running it
    again adds nothing."""
    if archived is not None:
        typed = typed.join(archived.select("slug").distinct(), "slug", "left_anti")
    category = F.when(C("kind") == "user", "entity").when(C("kind") == "feedback", "concept").otherwise(C("kind"))
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\d{4}-\d{2}-\d{2}"), F.lit(0)))
    sources = F.when(F.size(found) > 0, F.transform(found, lambda d: F.concat(F.lit("memory/"), d, F.lit(".md")))).otherwise(F.array(F.concat(F.lit("migration:"), "slug")))
    rows = typed.select("slug", category.alias("category"), sources.alias("sources"))
    if pages is None:
        return rows
    taken = pages.select("slug", F.lit(True).alias("taken")).distinct()
    slug = F.when(C("taken"), F.concat_ws("-", "slug", "category")).otherwise(C("slug"))
    return rows.join(taken, "slug", "left").select(slug.alias("slug"), "category", "sources")
