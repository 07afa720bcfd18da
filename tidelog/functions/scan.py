"""Many patterns over whole texts in one Arrow pass.

A pattern matches only where one of its anchors stands, a word or sign in lower case. A text is lowered
once, its anchors are looked for by plain searches, and only the patterns whose anchor it holds are
run. Patterns see ASCII words, digits and white space, and a dot stops at every line end, as in the JVM.
A null text gives null.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_ANY = r"[^\n\r\u0085  ]"


class Pattern(NamedTuple):
    """A compiled pattern and the anchors of which a match holds one; without anchors it always runs."""

    compiled: re.Pattern
    anchors: tuple[str, ...]

    def likely(self, low: str) -> bool:
        return not self.anchors or any(a in low for a in self.anchors)


def pattern(text: str, *anchors: str, ignore_case: bool = False) -> Pattern:
    flags = re.ASCII | (re.IGNORECASE if ignore_case else 0)
    return Pattern(re.compile(text.replace(".{", _ANY + "{"), flags), anchors)


def each_text(kind: str, value: Callable[[str], Any]) -> Callable[[Column], Column]:
    """A column function that gives value(text) of each text; kind is its type."""

    @F.arrow_udf(kind)
    def apply(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else value(t) for t in texts.to_pylist()], _arrow(kind))

    return apply


def _arrow(kind: str) -> pa.DataType:
    return {"array<string>": pa.list_(pa.string()), "bigint": pa.int64(), MATCHES: pa.list_(pa.struct([("k", pa.int32()), ("pos", pa.int32()), ("m", pa.string())]))}[kind]


#: Number of the pattern, number of the match among the pattern's, the match.
MATCHES = "array<struct<k: int, pos: int, m: string>>"


def counted(patterns: list[Pattern]) -> Callable[[Column], Column]:
    """How often the patterns match, in sum."""

    def count(text: str) -> int:
        low = text.lower()
        return sum(len(p.compiled.findall(text)) for p in patterns if p.likely(low))

    return each_text("bigint", count)


def held(patterns: list[Pattern]) -> Callable[[Column], Column]:
    """How many of the patterns match."""

    def count(text: str) -> int:
        low = text.lower()
        return sum(p.likely(low) and p.compiled.search(text) is not None for p in patterns)

    return each_text("bigint", count)


def matches(patterns: list[Pattern], once: frozenset[int] = frozenset()) -> Callable[[Column], Column]:
    """All matches in order of the patterns; of those in `once` the first one each."""

    def find(text: str) -> list[tuple[int, int, str]]:
        low, out = text.lower(), []
        for k, p in enumerate(patterns):
            if p.likely(low):
                for pos, m in enumerate(p.compiled.finditer(text)):
                    out.append((k, pos, m[0]))
                    if k in once:
                        break
        return [dict(zip(("k", "pos", "m"), x)) for x in out]

    return each_text(MATCHES, find)


def terms(patterns: list[Pattern], vocabulary: tuple[str, ...] = (), group: Callable[[re.Match], str | None] = lambda m: m[0]) -> Callable[[Column], Column]:
    """Distinct lower-cased matches, in order of the patterns, and then the terms of the vocabulary that the
    text holds anywhere."""

    def find(text: str) -> list[str]:
        low, out = text.lower(), {}
        for p in patterns:
            if p.likely(low):
                for m in p.compiled.finditer(text):
                    if (own := group(m)) is not None:
                        out[own.lower()] = None
        for t in vocabulary:
            if t in low:
                out[t] = None
        return list(out)

    return each_text("array<string>", find)
