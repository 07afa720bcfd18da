"""Column functions over text: entities, markers, keywords, signatures, chunks. All stay in the JVM, but for those
of many patterns over whole texts, which take one Arrow pass (see scan)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.functions.scan import counted, held, pattern, terms

# Marker patterns, entity patterns, tool vocabulary, stop words.
DECISION_MARKERS = (
    r"\bdecided\s+to\b", r"\bswitched\s+to\b", r"\bchose\s+(\w+\s+)?over\b", r"\bgoing\s+with\b", r"\bconcluded\s+that\b", r"\bwent\s+with\b",
    r"\bpicked\b", r"\bselected\b", r"\bsettled\s+on\b", r"\bopted\s+(for|to)\b", r"\bmade\s+the\s+(decision|call|choice)\b",
)
SUPERSESSION_MARKERS = (
    r"\bdecided\s+(?:to|on|against)\b", r"\bswitched\s+(?:to|from|away\s+from)\b", r"\bchose\s+\w+\s+over\b", r"\bchanged\s+(?:our|my|the)\s+mind\b",
    r"\breversed\s+(?:our|my|the)\s+(?:decision|call|stance)\b", r"\bcorrected\b", r"\b(?:no\s+longer|not\s+anymore)\b.{0,40}\b(?:going\s+with|using|on)\b",
    r"\breplaced\s+\w+\s+with\b", r"\bupgraded\s+from\b", r"\bdowngraded\s+from\b", r"\bdeprecated\b", r"\bretired\b",
)
CAMEL_CASE = r"\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b"
KEBAB_CASE = r"\b[a-z][a-z0-9]*(?:-[a-z0-9]+){2,}\b"
ERROR_CODE = r"\b[A-Z][A-Z_]{2,}\b"
HTTP_ERROR = r"(?i)\bHTTP\s+[45]\d\d\b"
TICKET = r"(?i)\b(?:#|ticket\s*[#:]?)\s*\d{2,}\b"
MENTION = r"@(\w+)"
TOOLS = (
    "docker", "redis", "postgres", "postgresql", "mongodb", "mysql", "sqlite", "nginx", "kubernetes", "k8s", "terraform", "ansible", "jenkins", "github",
    "gitlab", "jira", "linear", "slack", "grafana", "prometheus", "datadog", "sentry", "webpack", "vite", "eslint", "prettier", "jest", "vitest", "mocha",
    "cypress", "playwright", "storybook", "figma", "vercel", "netlify", "aws", "gcp", "azure", "heroku", "cloudflare", "supabase", "firebase", "stripe",
    "twilio", "sendgrid", "npm", "yarn", "pnpm", "node", "deno", "bun", "python", "rust", "go", "java", "typescript", "react", "vue", "angular", "svelte",
    "next", "nuxt", "express", "fastify", "django", "flask", "rails", "spring", "openai", "gpt", "huggingface", "transformers", "langchain", "llamaindex",
)
QUERY_STOP_WORDS = tuple(
    """a an the is are was were be been being have has had do does did will would could should may might shall can need dare ought used to of in for on with at
    by from as into through during before after above below between out off over under again further then once here there when where why how all both each few
    more most other some such no nor not only own same so than too very just because but and or if while about what which who whom this that these those am it
    its my we our your his her they them their i me he she up down""".split()
)
SIGNAL_STOP_WORDS = tuple(
    """the a an is are was were be been being have has had do does did will would could should may might can shall to of in for on with at by from as into
    through during before after and but or nor not no so if then that this it its all each every both few more most other some such only own same than too
    very""".split()
)


_WORD = "[A-Za-z0-9_]"


def ascii_bounds(pattern: str) -> str:
    r"""The pattern with \b as the border of ASCII words; Java's own \b also sees letters beyond ASCII.
    At the ends of a pattern that begins or ends with a word character one look to the side is enough."""
    flags, body = ("(?i)", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
    head = tail = ""
    if body.startswith(r"\b") and not body.startswith(r"\b(?:#"):
        # Most places have no digit: that is seen before one looks to the side.
        head, body = (r"(?=\d)" if body.startswith(r"\b\d") else "") + f"(?<!{_WORD})", body[2:]
    if body.endswith(r"\b"):
        body, tail = body[:-2], f"(?!{_WORD})"
    return flags + head + body.replace(r"\b", f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))") + tail


def _anchors(pattern: str) -> list[str]:
    """Words of which a match holds one, in lower case: the first word of the pattern, or the longest of
    each alternative that it begins with."""
    body = re.sub(r"\\[bsw][+*]?", " ", pattern).strip()
    if choice := re.match(r"\(\?:([^()]*)\)", body):
        return [max(re.findall("[a-z]+", x), key=len) for x in choice[1].split("|")]
    return re.findall("[a-z]+", body)[:1]


def token_estimate(text: Column) -> Column:
    """One token for each four characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def temporal_tag(text: Column, date: Column) -> Column:
    """`[as of D]` and a blank line in front of the text; a date that isn't one leaves it alone."""
    iso = F.try_to_date(date.cast("string"), "yyyy-MM-dd").cast("string")
    return F.coalesce(F.concat(F.lit("[as of "), iso, F.lit("]\n\n"), text), text)


def found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(ascii_bounds(pattern)), F.lit(group))


_CAMEL, _KEBAB, _CODE = pattern(CAMEL_CASE), pattern(KEBAB_CASE, "-"), pattern(ERROR_CODE)
_HTTP, _TICKET, _MENTION = pattern(HTTP_ERROR, "http"), pattern(TICKET, "#", "ticket"), pattern(MENTION, "@")


def light_entities(text: Column) -> Column:
    """Distinct lower-cased CamelCase names, kebab-case names of three parts or more, and mentions."""
    return terms([_CAMEL, _KEBAB, _MENTION], group=lambda m: m[m.re.groups])(text)


def entities(text: Column, vocabulary: tuple[str, ...] = TOOLS) -> Column:
    """Light entities without mentions, error codes, HTTP errors, ticket ids and the vocabulary's terms."""
    long_code = lambda m: None if m.re is _CODE.compiled and len(m[0]) < 4 else m[0]
    return terms([_CAMEL, _KEBAB, _CODE, _HTTP, _TICKET], vocabulary, long_code)(text)


def decision_markers(text: Column) -> Column:
    """How often the decision patterns match."""
    return counted([pattern(p, *_anchors(p), ignore_case=True) for p in DECISION_MARKERS])(text)


def supersession_markers(text: Column) -> Column:
    """How many of the supersession patterns match."""
    return held([pattern(p, *_anchors(p), ignore_case=True) for p in SUPERSESSION_MARKERS])(text)


def _words(text: Column, gap: str) -> Column:
    return F.split(F.regexp_replace(F.lower(text), r"[^a-zA-Z0-9_\s-]", gap), r"\s+")


def query_keywords(text: Column) -> Column:
    return F.filter(_words(text, " "), lambda w: (F.length(w) > 1) & ~w.isin(*QUERY_STOP_WORDS))


def signal_keywords(text: Column) -> Column:
    return F.filter(_words(text, ""), lambda w: (F.length(w) > 2) & ~w.isin(*SIGNAL_STOP_WORDS))


def catalog_tokens(text: Column) -> Column:
    return F.filter(_words(text, " "), lambda w: F.length(w) > 1)


def expanded_queries(query: Column) -> Column:
    """The query, its keywords (two or more, unlike the query), its first four keywords (of more than three)."""
    words = query_keywords(query)
    joined = F.array_join(words, " ")
    more = F.array(F.when((F.size(words) >= 2) & (joined != F.lower(query)), joined), F.when(F.size(words) > 3, F.array_join(F.slice(words, 1, 4), " ")))
    return F.concat(F.array(query), F.array_compact(more))


SPLIT = r"(?i)\s*(?:,\s*and|\s+and|;|,)\s+(?=(?:what|which|who|when|how|why|where|was|were|did|do|does|is|are|the)\b)"


def decomposed_query(query: Column) -> Column:
    """Up to three questions of four words or more that a query joins; null for a single one."""
    parts = F.filter(F.transform(F.split(query, SPLIT), F.trim), lambda p: p != "")
    long = F.filter(parts, lambda p: F.size(F.split(p, r"\s+")) >= 4)
    return F.when((F.size(parts) >= 2) & (F.size(long) >= 2), F.slice(long, 1, 3))


# Patterns of signatures, by kind.
SIGNATURES = {"money": r"\$\d[\d,.]*(?:[KMB]|\s?(?:million|billion))?", "ratio": r"\b\d+(?:\.\d+)?x\b", "percent": r"\b\d+(?:\.\d+)?%", "time": r"\b\d{1,2}:\d{2}\b", "date": r"\b\d{4}-\d{2}-\d{2}\b"}


def signatures(text: Column) -> Column:
    """(kind, value) of money, ratios, percentages, clock times and ISO dates, in this order."""
    return F.flatten(F.array(*(_kinds(kind, found(text, p)) for kind, p in SIGNATURES.items())))


#: Fixed value: a phrase of two to four capitalised words.
TITLE_CASE = r"\b(?:[A-Z][a-z]+\s+){1,3}[A-Z][a-z]+(?:,?\s+Inc\.?)?\b"


def named_signatures(text: Column) -> Column:
    """signatures and, last, (name, phrase) of capitalised phrases."""
    return F.concat(signatures(text), _kinds("name", found(text, TITLE_CASE)))


#: Words that stand capitalised at the begin of a sentence without being part of a name,
#: and words that say nothing about a passage.
SENTENCE_STARTERS = (
    "Did", "Does", "Do", "Has", "Have", "Had", "Was", "Were", "Is", "Are", "Will", "Would", "Could", "Should", "Can", "What", "Which", "Who", "Whom", "Whose", "When", "Where", "Why", "How", "From", "After",
    "Before", "Across", "During", "By", "In", "On", "Through", "Between", "Among", "Around", "Over", "Under", "About", "With", "Without", "Within", "Throughout", "At", "Until", "Since", "Toward", "Towards", "Upon",
)
VAGUE_ANCHORS = ("which", "where", "answer", "should", "across", "always", "later", "first", "after", "before", "without", "memory", "based")


def proper_nouns(text: Column) -> Column:
    """Distinct capitalised phrases; a first word that begins a sentence is no part of one."""
    first = F.regexp_extract(text, r"^([^ ]+) ", 1)
    scanned = F.when(first.isin(*SENTENCE_STARTERS), F.concat(F.repeat(F.lit(" "), F.length(first)), F.substr(text, F.length(first) + 1))).otherwise(text)
    return F.array_distinct(found(scanned, TITLE_CASE))


def passage_words(text: Column) -> Column:
    """Words of three letters or more without stop words: the third keyword variant."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z'-]{2,}"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*QUERY_STOP_WORDS))


def distinct_passage_words(text: Column) -> Column:
    """The same words, each once: the difference of two sets, which costs no more than the words."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z'-]{2,}"), F.lit(0))
    return F.array_except(words, F.array(*map(F.lit, QUERY_STOP_WORDS)))


def anchor_words(text: Column, most: int = 8) -> Column:
    """The first distinct words of five letters or more that can point to a passage."""
    words = found(F.lower(text), r"\b[a-z]{5,}\b")
    return F.slice(F.array_distinct(F.filter(words, lambda w: ~w.isin(*VAGUE_ANCHORS))), 1, most)


#: A word that the border of a passage cuts is completed by up to so many characters.
WORD_REST = 60


def signature_contexts(text: Column, around: int) -> Column:
    """(kind, value, near) of every signature: near are the distinct words of five letters or more, lower-cased,
    that begin up to `around` characters behind its begin and end up to `around` before its end."""
    return F.flatten(F.array(*(_contexts(text, kind, ascii_bounds(p), around) for kind, p in SIGNATURES.items())))


def _contexts(text: Column, kind: str, pattern: str, around: int) -> Column:
    values, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<value: string, start: int>>").alias("out"))

    def placed(a: Column, r: Column) -> Column:
        begin = a["at"] + F.length(between[r["i"]])
        return F.struct((begin + F.length(r["v"])).alias("at"), F.concat(a["out"], F.array(F.struct(r["v"].alias("value"), begin.alias("start")))).alias("out"))

    def near(r: Column) -> Column:
        first, last = F.greatest(r["start"] + F.length(r["value"]) - around, F.lit(0)), r["start"] + around
        rest = F.greatest(first - WORD_REST, F.lit(0))
        left = F.regexp_extract(F.substr(text, rest + 1, first - rest), rf"{_WORD}*\z", 0)
        right = F.regexp_extract(F.substr(text, last + 1, F.lit(WORD_REST)), rf"\A{_WORD}*", 0)
        passage = F.lower(F.concat(left, F.substr(text, first + 1, last - first), right))
        return F.struct(F.lit(kind).alias("kind"), r["value"].alias("value"), F.array_distinct(found(passage, r"\b[a-z]{5,}\b")).alias("near"))

    numbered = F.transform(values, lambda v, i: F.struct(i.alias("i"), v.alias("v")))
    return F.transform(F.aggregate(numbered, start, placed, lambda a: a["out"]), near)


def links_with_offsets(body: Column) -> Column:
    """(target, offset) of every link in a body, offsets in characters from 0."""
    whole = found(body, r"\[\[[^\]|]+(?:\|[^\]]*)?\]\]")
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<target: string, offset: int>>").alias("out"))

    def step(a: Column, link: Column) -> Column:
        # Each link is looked for behind the one before it.
        at = F.position(link, body, a["at"])
        target = F.regexp_replace(F.trim(F.regexp_extract(link, r"^\[\[([^\]|]+)", 1)), r"^[A-Za-z0-9_-]+:", "")
        return F.struct((at + F.length(link)).alias("at"), F.concat(a["out"], F.array(F.struct(target.alias("target"), (at - 1).alias("offset")))).alias("out"))

    return F.aggregate(whole, start, step, lambda a: a["out"])


def wisdom_entries(text: Column) -> Column:
    """(title, body) of the entries that lines beginning with a bold title open."""
    parts = F.slice(F.split(F.concat(F.lit("\n"), text), r"\n(?=\*\*.+?\*\*)"), 2, 1 << 20)
    body = lambda p: F.when(F.contains(p, F.lit("\n")), F.concat(F.regexp_replace(p, r"\A[^\n]*\n", ""), F.lit("\n"))).otherwise("")
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"\A\*\*(.+?)\*\*", 1).alias("title"), body(p).alias("body")))


def stub_body(category: Column, lede: Column, why: Column, how: Column, where: Column, when: Column, extra: Column) -> Column:
    """(body, error) of a new page: concepts and projects need a reason and a way to apply it, references
    may say where and when, themes can't be stubs."""
    given = lambda c: F.when(F.trim(c) != "", F.trim(c))
    line = lambda head, c: F.concat(F.lit(head), given(c))
    parts = F.when(category.isin("concept", "project"), F.array(line("**Why:** ", why), line("**How to apply:** ", how))).when(category == "reference", F.array(line("## Where to find it\n", where), line("## When to use it\n", when))).otherwise(F.array().cast("array<string>"))
    body = F.concat(F.array_join(F.array_compact(F.concat(F.array(F.trim(lede)), parts, F.array(given(extra)))), "\n\n"), F.lit("\n"))
    lacking = category.isin("concept", "project") & (F.coalesce(why, F.lit("")).eqNullSafe("") | F.coalesce(how, F.lit("")).eqNullSafe(""))
    error = F.when(category == "theme", "themes can't be stubs").when(~category.isin("entity", "concept", "project", "reference"), "unknown category").when(lacking, "why and how are needed")
    return F.struct(F.when(error.isNull(), body).alias("body"), error.alias("error"))


def salvaged_objects(text: Column) -> Column:
    """The complete objects of a JSON array that a model wrote, in order, when its end is missing: the text
    is walked once from the first bracket with the depth of braces and whether it is within a string."""
    from_bracket = F.regexp_extract(text, r"(?s)(\[.*)", 1)
    # Strings, braces and what lies between them, each one piece.
    pieces = F.regexp_extract_all(from_bracket, F.lit(r'(?s)"(?:[^"\\]|\\.)*+"?|[{}]|[^"{}]+'), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("held"), F.array().cast("array<string>").alias("out"), F.lit(False).alias("stop"))

    def step(a: Column, p: Column) -> Column:
        depth = a["depth"] + F.when(p == "{", 1).when(p == "}", -1).otherwise(0)
        held = F.when((a["depth"] > 0) | (p == "{"), F.concat(a["held"], p)).otherwise("")
        closed = (p == "}") & (a["depth"] == 1)
        # Between objects only commas and white space go on; a bracket ends the array.
        stop = a["stop"] | ((a["depth"] == 0) & (p != "{") & ~p.rlike(r"\A(?:\[)?[,\s]*\z"))
        out = F.when(closed & ~stop, F.concat(a["out"], F.array(held))).otherwise(a["out"])
        return F.struct(F.when(stop, a["depth"]).otherwise(depth).alias("depth"), F.when(closed, "").otherwise(held).alias("held"), out.alias("out"), stop.alias("stop"))

    return F.aggregate(pieces, start, step, lambda a: a["out"])


def _kinds(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def fixed_chunks(tokens: Column, size: int = 512, overlap: int = 64) -> Column:
    """Slices of `size` tokens that overlap; the last one ends the text."""
    step = size - overlap
    return F.when(F.size(tokens) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.size(tokens) - overlap - 1, F.lit(0)), F.lit(step)), lambda i: F.slice(tokens, i + 1, size))).otherwise(F.array(F.array().cast("array<string>")).cast("array<array<string>>"))


def line_of(text: Column, position: Column) -> Column:
    """Number of the line that holds a character offset."""
    return F.size(F.split(F.substring(text, F.lit(1), position), "\n", -1))


def ranged_lines(text: Column, first: Column, n: Column) -> tuple[Column, Column]:
    """(n lines from line `first`, lines that are left after them)."""
    lines = F.split(text, "\n", -1)
    return F.array_join(F.slice(lines, first, n), "\n"), F.greatest(F.size(lines) - (first + n - 1), F.lit(0))


def links(body: Column) -> Column:
    """Distinct slugs of [[slug]], [[wiki:slug]] and [[slug|text]]."""
    inner = found(body, r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]", 1)
    return F.array_distinct(F.transform(inner, lambda x: F.regexp_replace(F.trim(x), r"^[A-Za-z0-9_-]+:", "")))


def valid_slug(slug: Column) -> Column:
    return slug.rlike(r"^[a-z0-9]+(-[a-z0-9]+)*$") & (slug != "index")


def snippet(text: Column, size: int = 700) -> Column:
    return F.substring(text, 1, size)


def heading_chunks(text: Column, max_tokens: int = 512) -> Column:
    """(text, start_line, end_line) of sections that begin at `#` to `####` headings; a section over
    max_tokens is packed from its paragraphs. Line numbers count from 0 and take one blank line
    between paragraphs."""
    parts = F.filter(F.split(text, r"(?m)^(?=#{1,4}\s)"), lambda s: s != "")
    lines = lambda s: F.size(F.split(s, "\n", -1))
    # A section that another one follows ends with a line end that belongs to the border.
    start = F.struct(F.lit(0).alias("line"), F.array().cast("array<struct<text: string, start: int>>").alias("out"))
    placed = F.aggregate(parts, start, lambda a, s: F.struct((a["line"] + lines(s) - 1).alias("line"), F.concat(a["out"], F.array(F.struct(s.alias("text"), a["line"].alias("start")))).alias("out")))["out"]
    sections = F.transform(placed, lambda s, i: F.struct(F.when(i < F.size(parts) - 1, F.regexp_replace(s["text"], r"\n\z", "")).otherwise(s["text"]).alias("text"), s["start"].alias("start")))
    chunk = "array<struct<text: string, start_line: int, end_line: int>>"

    def whole(s: Column) -> Column:
        return F.array(F.struct(s["text"].alias("text"), s["start"].alias("start_line"), (s["start"] + lines(s["text"]) - 1).alias("end_line")))

    def packed(s: Column) -> Column:
        zero = F.struct(F.array().cast(chunk).alias("out"), F.lit("").alias("held"), s["start"].alias("held_at"), s["start"].alias("line"))

        def step(a: Column, p: Column) -> Column:
            full = (a["held"] != "") & (token_estimate(F.concat(a["held"], F.lit("\n\n"), p)) > max_tokens)
            done = F.array(F.struct(a["held"].alias("text"), a["held_at"].alias("start_line"), (a["line"] - 1).alias("end_line")))
            held = F.when(full | (a["held"] == ""), p).otherwise(F.concat(a["held"], F.lit("\n\n"), p))
            return F.struct(F.when(full, F.concat(a["out"], done)).otherwise(a["out"]).alias("out"), held.alias("held"), F.when(full, a["line"]).otherwise(a["held_at"]).alias("held_at"), (a["line"] + lines(p) + 1).alias("line"))

        last = lambda a: F.concat(a["out"], F.array(F.struct(a["held"].alias("text"), a["held_at"].alias("start_line"), (s["start"] + lines(s["text"]) - 1).alias("end_line"))))
        return F.aggregate(F.split(s["text"], r"\n\n+"), zero, step, last)

    chunks = F.flatten(F.transform(sections, lambda s: F.when(token_estimate(s["text"]) <= max_tokens, whole(s)).otherwise(packed(s))))
    trimmed = F.transform(chunks, lambda c: F.struct(F.btrim(c["text"], F.lit(" \n\r\t")).alias("text"), c["start_line"].alias("start_line"), c["end_line"].alias("end_line")))
    return F.filter(trimmed, lambda c: c["text"] != "")


def judge_scores(output: Column) -> Column:
    """(correctness, completeness, hallucination, error) of a judge's answer: the first JSON object, with
    or without a fence around it, rounded; a score out of its range is an error."""
    read = F.from_json(F.regexp_extract(output, r"(?s)(\{.*?\})", 1), "struct<correctness: double, completeness: double, hallucination: double>")
    values = {k: F.floor(read[k] + 0.5).cast("int") for k in ("correctness", "completeness", "hallucination")}
    bad = F.lit(False)
    for (_, v), top in zip(values.items(), (3, 2, 1)):
        bad = bad | v.isNull() | ~v.between(0, top)
    error = F.when(F.coalesce(bad, F.lit(True)), "bad output")
    return F.struct(*(F.when(error.isNull(), v).alias(k) for k, v in values.items()), error.alias("error"))


def first_mention(text: Column, keywords: Column, most: int = 120) -> Column:
    """The first sentence that holds one of the keywords, cut to 117 characters and `...` when over 120."""
    sentences = F.split(text, r"(?<=[.!?])\s+")
    found = F.try_element_at(F.filter(sentences, lambda s: F.exists(keywords, lambda k: F.contains(F.lower(s), F.lower(k)))), F.lit(1))
    return F.when(F.length(found) > most, F.concat(F.substring(found, 1, most - 3), F.lit("..."))).otherwise(found)
