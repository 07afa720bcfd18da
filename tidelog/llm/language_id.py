"""Language identification with string kernels.

Kernel: two texts are as alike as the share of character n-grams (one to three characters, word
borders included) that both hold, k(x, z) = |x & z| / sqrt(|x| |z|), each n-gram counted once
(blended-spectrum presence). A bounded sample of labelled texts trains the model on the driver:
some of its texts are landmarks, Nyström features z(x) = k(x, landmarks) K^(-1/2) stand for the
kernel, and one ridge regression per language (one language against the rest) is fitted on them.
Tasks score batches of texts by matrix products: presence x landmark n-grams, then the folded
weights. As presence says nothing of shares, a text is scored in parts of PART characters that
cover all of it, and the parts' values are averaged by their lengths: of a text in two languages
the larger one wins.

Bounds (the only sampling; every text is scored whole): LABELLED texts a language, fewer where there
are so many languages that MOST_LABELLED would be passed, taken in the order of a hash of id and text; of a
longer text the first LONGEST_LABELLED characters train; LANDMARKS texts a language are landmarks. All
letters of the sample are letters of the model; letters that it doesn't have count as one.

Defined results: null texts and texts without a letter are `und` with score 0, as is everything
when nothing is labelled; rows are independent, so repeated rows and null ids are carried through
(a null id isn't held out, and trains nothing); a very long text is scored part by part; of equal scores the language that
comes first by name wins; columns beside doc_id, text and lang are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import fold, table, text_blocks

LABELLED = 200
MOST_LABELLED = 4000
LONGEST_LABELLED = 20_000
LANDMARKS = 40

#: Up to so many letters, n-grams are looked up in a table of all possible ones.
DENSE = 128

RIDGE = 1e-2
SHARPNESS = 6.0
PART = 1024
UNKNOWN = "und"

#: Parts in one matrix product.
ROWS = 256

_LIKELY = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a text holds a letter; characters like `½` or `Ⅷ` are numbers, which the pattern also finds."""
    return any(m[0].isalpha() for m in _LIKELY.finditer(text))


def parts(text: str) -> list[str]:
    """A text cut into equal parts of at most PART characters."""
    n = -(-len(text) // PART)
    size = -(-len(text) // max(n, 1))
    return [text[a : a + size] for a in range(0, len(text), size)]


class KernelModel:
    """What a worker needs: n-gram columns, the landmarks' n-grams, and folded weights."""

    def __init__(self, texts: list[str], langs: list[str]):
        self.langs = sorted(set(langs))
        cut = [(p, lang) for t, lang in zip(texts, langs) for p in parts(t) if has_letter(p)]
        texts, langs = [p for p, _ in cut], [lang for _, lang in cut]
        letters = sorted({c for t in texts for c in t.lower() if c.isalpha()})
        # Symbol 0 is a border (anything but a letter), 1 any other letter.
        self.symbols = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=np.int32, count=0x110000)
        for k, c in enumerate(letters):
            self.symbols[ord(c)] = k + 2
        self.n = len(letters) + 2
        by_lang: Counter = Counter()
        marks = []
        for k, lang in enumerate(langs):
            by_lang[lang] += 1
            if by_lang[lang] <= LANDMARKS:
                marks.append(k)
        # The n-grams of the landmarks by size, sorted, and the column of the first of each size.
        self.known = [np.unique(codes) for codes in self._codes([texts[k] for k in marks])[0]]
        self.first = np.cumsum([0, *map(len, self.known)])
        self.width = int(self.first[-1])
        self.tables = []
        if self.n <= DENSE:
            for size, known in enumerate(self.known, 1):
                self.tables.append(np.full(self.n**size, -1, dtype=np.int32))
                self.tables[-1][known] = np.arange(len(known))
        whole = np.vstack([self._presence(texts[a : a + ROWS]) for a in range(0, len(texts), ROWS)])
        size = np.sqrt(np.maximum(whole.sum(axis=1), 1))
        self.landmarks = np.ascontiguousarray((whole[marks] / size[marks, None]).T)
        k_all = (whole @ self.landmarks) / size[:, None]
        values, vectors = np.linalg.eigh(k_all[marks].astype(np.float64))
        keep = values > 1e-6 * values.max()
        nystroem = vectors[:, keep] / np.sqrt(values[keep])
        z = k_all.astype(np.float64) @ nystroem
        target = np.where(np.array(langs)[:, None] == np.array(self.langs)[None, :], 1.0, -1.0)
        # Each language weighs the same, however many of its texts are in the sample.
        weight = np.array([1 / by_lang[x] for x in langs])[:, None]
        center = (target * weight).sum(axis=0) / weight.sum()
        beta = np.linalg.solve(z.T @ (weight * z) + RIDGE * np.eye(z.shape[1]) * weight.sum() / len(langs), z.T @ (weight * (target - center)))
        self.weights, self.center = (nystroem @ beta).astype(np.float32), center.astype(np.float32)

    def _codes(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Codes of all n-grams by size, and the number of the text of each."""
        raw = np.frombuffer("".join(f" {t} " for t in (x.lower() for x in texts)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lengths = np.fromiter((len(x.lower()) + 2 for x in texts), dtype=np.int64, count=len(texts))
        of = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
        symbol = self.symbols[raw]
        keep = np.ones(len(symbol), dtype=bool)
        keep[1:] = (symbol[1:] != 0) | (symbol[:-1] != 0) | (of[1:] != of[:-1])
        symbol, of = symbol[keep].astype(np.int64), of[keep]
        pair = symbol[:-1] * self.n + symbol[1:]
        triple = pair[:-1] * self.n + symbol[2:]
        same2, same3 = of[:-1] == of[1:], of[:-2] == of[2:]
        return [symbol, pair[same2], triple[same3]], [of, of[:-1][same2], of[:-2][same3]]

    def _presence(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width), dtype=np.float32)
        for size, (codes, of) in enumerate(zip(*self._codes(texts))):
            column = self._column(size, codes)
            held = column >= 0
            out[of[held], self.first[size] + column[held]] = 1
        return out

    def _column(self, size: int, codes: np.ndarray) -> np.ndarray:
        """Place of each n-gram among the known ones of its size, -1 for others."""
        if self.tables:
            return self.tables[size][codes]
        known = self.known[size]
        place = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        return np.where(known[place] == codes, place, -1) if len(known) else np.full(len(codes), -1)

    def values(self, texts: list[str]) -> np.ndarray:
        """The regressions' values, a row for each text."""
        presence = self._presence(texts)
        size = np.sqrt(np.maximum(presence.sum(axis=1, keepdims=True), 1))
        return (presence @ self.landmarks / size) @ self.weights + self.center

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language and its score, for each text (none is empty)."""
        cut = [parts(t) for t in texts]
        flat = [p for own in cut for p in own]
        value = np.vstack([self.values(flat[a : a + ROWS]) for a in range(0, len(flat), ROWS)])
        size = np.fromiter(map(len, flat), dtype=np.float64, count=len(flat))[:, None]
        first = np.cumsum([0, *map(len, cut[:-1])])
        value = np.add.reduceat(value * size, first) / np.add.reduceat(size, first)
        chance = np.exp(SHARPNESS * (value - value.max(axis=1, keepdims=True)))
        chance /= chance.sum(axis=1, keepdims=True)
        best = chance.argmax(axis=1)
        return best, chance[np.arange(len(texts)), best].astype(np.float64)


def labelled_sample(docs: DataFrame, trained_on: Column, most: int = LABELLED) -> list[tuple[str, str]]:
    """(text, lang) of at most `most` different rows a language, in the order of a hash of id and text. Rows
    without an id are none of them. Only hashes of about three times as many rows and the texts taken come to
    the driver, whatever repeats in the ids or the texts."""
    labelled = docs.where(trained_on & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    place = F.xxhash64(F.col("doc_id").cast("string"), "text")
    rows = labelled.where(F.col("text").rlike(r"\p{L}")).select("lang", place.alias("place"), F.substring("text", 1, LONGEST_LABELLED).alias("text"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct("place").alias("n")).collect()}
    if not counts:
        return []
    most = max(1, min(most, MOST_LABELLED // len(counts)))
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 3 * most / max(1, n)))).otherwise(share)
    part = F.pmod("place", F.lit(1_000_000))
    few = rows.where(part < share * 1_000_000)
    taken: dict[str, list[int]] = {}
    for r in sorted(few.select("lang", part.alias("part"), "place").distinct().collect()):
        if len(own := taken.setdefault(r.lang, [])) < most:
            own.append(r.place)
    chosen = docs.sparkSession.createDataFrame([(lang, p) for lang, own in taken.items() for p in own], "lang string, place long")
    found = few.join(F.broadcast(chosen), ["lang", "place"], "left_semi").groupBy("lang", "place").agg(F.any_value("text").alias("text")).collect()
    return [(r.text, r.lang) for r in sorted(found, key=lambda r: (r.place % 1_000_000, r.place, r.lang))]


def languages(docs: DataFrame, sample: list[tuple[str, str]]) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, lang_pred, score."""
    model = KernelModel(*map(list, zip(*sample))) if sample else None
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in text_blocks(batches):
            texts = batch.column("text").to_pylist()
            lang, value = [UNKNOWN] * len(texts), np.zeros(len(texts))
            told = [k for k, t in enumerate(texts) if t and has_letter(t)] if model else []
            if told:
                best, value[told] = model.predict([texts[k] for k in told])
                for k, b in zip(told, best):
                    lang[k] = model.langs[b]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang), pa.array(value)], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(score, "doc_id long, lang_pred string, score double")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold() == 0, F.lit(False))
    found = languages(docs, labelled_sample(docs, fold() != 0))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
