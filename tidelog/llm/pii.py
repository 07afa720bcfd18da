r"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Base kinds, leftmost and non-overlapping within a kind:
  email `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+`
  ip    `[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)`, each part at most 255
  card  `[0-9]([\x20-]?[0-9])+`, 12 to 19 digits that pass Luhn
  phone `\+[0-9][\x20().0-9-]+[0-9]`, 9 to 15 digits
A match that fails its check is dropped and not tried again. Base spans always stay; their score
tells how sure they are. Added kinds need their checksum, or context, to reach ACCEPTED:
  iban  two letters, two digits and 11 to 30 letters or digits, remainder 1 modulo 97
  local_phone  ten digits in groups of three, three and four, near a word that speaks of phones

The patterns are run so that their work is proportional to the text, however long a run of letters
or digits is. Defined results: a null or empty text has no spans; offsets are code points; rows are
independent, so repeated rows and null ids are carried through; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import table, text_blocks

#: In the order in which spans with one start are listed.
KINDS = ("email", "ip", "card", "phone", "iban", "local_phone")
BASE = KINDS[:4]

#: Characters before and after a span in which context words count.
CONTEXT = 40

#: Least score of an added span.
ACCEPTED = 0.6

# Score by pattern alone, by checksum, and words that speak of the kind.
PATTERN_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.4, "phone": 0.6, "iban": 0.3, "local_phone": 0.3}
CHECKSUM_SCORE = {"card": 0.4, "iban": 0.5}
CONTEXT_SCORE = {"email": 0.2, "ip": 0.3, "card": 0.2, "phone": 0.3, "iban": 0.2, "local_phone": 0.4}
CONTEXT_WORDS = {
    "email": ("email", "e-mail", "mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "credit", "debit", "visa", "mastercard", "amex"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "contact"),
    "iban": ("iban", "account", "bank", "transfer", "konto", "compte", "cuenta"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax"),
}

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])")
_DIGIT = re.compile(r"[0-9]")
_NEAR = {kind: re.compile(r"(?<![A-Za-z])(?:" + "|".join(words) + r")(?![A-Za-z])", re.IGNORECASE) for kind, words in CONTEXT_WORDS.items()}


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ with a domain takes the local characters before it, back to the end of the last match:
    the same spans as scanning for the whole pattern, without trying every start in a long run."""
    last = 0
    for m in _DOMAIN.finditer(text):
        start = at = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            yield start, m.end()
            last = m.end()


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 12 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        found = m[0]
        # Words in capitals may follow: the groups are shortened at a space until the sum is right.
        while len(found.replace(" ", "")) >= 15:
            if mod97(found.replace(" ", "")):
                yield m.start(), m.start() + len(found)
                break
            found = found.rpartition(" ")[0]


_FIND = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans, "local_phone": lambda text: (m.span() for m in _LOCAL_PHONE.finditer(text))}


def find_spans(text: str) -> list[Span]:
    """All spans of a text, in order of start and kind."""
    spans: list[Span] = []
    has_digit = _DIGIT.search(text) is not None
    for kind in KINDS:
        if kind == "email" and "@" not in text or kind == "phone" and "+" not in text or kind != "email" and not has_digit:
            continue
        for start, end in _FIND[kind](text):
            near = text[max(0, start - CONTEXT) : start] + "\n" + text[end : end + CONTEXT]
            score = PATTERN_SCORE[kind] + CHECKSUM_SCORE.get(kind, 0) + (CONTEXT_SCORE[kind] if _NEAR[kind].search(near) else 0)
            if kind in BASE or score >= ACCEPTED and not any(start < s.end and s.start < end for s in spans):
                spans.append(Span(start, end, kind, round(score, 3)))
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind)))


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())]))


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_blocks(batches):
        found = [[s._asdict() for s in find_spans(text)] if text else [] for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, _SPANS)], ["doc_id", "spans"])


def personal_data(docs: DataFrame) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id and spans (start, end, kind, score)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_scan, "doc_id long, spans array<struct<start: long, end: long, kind: string, score: double>>")


def redacted(docs: DataFrame, least_score: float = 0.0) -> DataFrame:
    """docs with each span of at least that score replaced by its kind in square brackets; of
    overlapping spans the first one counts. All columns stay."""

    def redact(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches):
            texts = batch.column("text").to_pylist()
            for k, text in enumerate(texts):
                parts, at = [], 0
                for s in find_spans(text) if text else ():
                    if s.score >= least_score and s.start >= at:
                        parts += [text[at : s.start], f"[{s.kind}]"]
                        at = s.end
                if parts:
                    texts[k] = "".join([*parts, text[at:]])
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(redact, docs.schema)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of_kind(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [of_kind(kind) for kind in BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("max_score"))
