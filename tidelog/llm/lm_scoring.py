"""Language-model scores from log-frequency Bloom filters of all word pairs.

Tokens are lower-cased words and one end token a text; the history of a text's first token is a begin
token. Spark counts all training tokens and all pairs (history, token) by their 64-bit hashes; no pair
is left out at any size. Pair counts are quantised, q = 1 + floor(log_BASE(count)), and a Bloom filter
holds each pair once for each level 1 … q. The bits are dealt to SLOTS by the hash of the pair and
sized from the counted entries, so the load is the same at all sizes. When they exceed BITS, they are
cut by slot into several filters, each broadcast in turn for one scan of the texts; a token is scored
in the scan of its pair's filter, and the sums of the scans are added.

The model is a bigram model with a Dirichlet prior (MacKay and Peto) on the base,
  P(w | h) = (c(h, w) + M P(w)) / (c(h) + M), M the mean number of followers of a history,
so that log P(w | h) = log P(w) + log(M / (c(h) + M)) + log(1 + c(h, w) / (M P(w))). Only the last part
belongs to a pair; it stands for the least count of the pair's level. A wrong probe (about one in
forty) can only raise a level.

Base: sum over tokens of log10(P(w)), P(w) = (c + 0.5) / (N + 0.5 (V + 1)), exact for every token: the
counts of FREQUENT words are broadcast, those of the others are joined, in the base and in the model.

Defined results: a null or empty text is its end token; without training tokens every token has
probability 1 in the base and in the model; repeated rows are scored each (they are told apart by
where they were read); null ids are carried through and count as training rows; a very long text is one
row of one task; words of equal counts are frequent together or not at all; columns beside doc_id and
text are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import fold, lists, settled, table, text_blocks
from tidelog.llm.textkernels import Words, as_long, mix

#: Words whose counts are broadcast: at most so many. They are the words above a count, read from a
#: histogram in steps of a quarter of a doubling.
FREQUENT = 200_000
STEPS = 4

#: Most bits of one filter; it is broadcast to each worker.
BITS = 1 << 30
SLOTS = 1024
PROBES = 4
BASE = 1.5

#: Bits for each entry: then about one probe in forty is wrong.
LOAD = 8
CHUNK_BYTES = 1 << 16

#: Stand for the end token and for the begin of a text among word hashes.
END = np.uint64(0x656E64206F662074)
BEGIN = np.uint64(0x626567696E206F66)


def _tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the tokens of all texts, where each text's tokens begin); every text ends with END."""
    words = Words(texts, "lower")
    first = words.first + np.arange(len(words.first))
    out = np.empty(first[-1], dtype=np.uint64)
    out[first[1:] - 1] = END
    out[np.arange(len(words.hashes)) + words.text_of_word()] = words.hashes
    return out, first


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_blocks(batches):
        word, n = np.unique(_tokens(batch.column("text").to_pylist())[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(as_long(word)), pa.array(n)], ["word", "n"])


def _histories(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[first[:-1]] = BEGIN
    return before


def _pair(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a pair; both are hashes themselves."""
    return (before << np.uint64(1) | before >> np.uint64(63)) ^ word


def _slot(codes: np.ndarray) -> np.ndarray:
    return (codes >> np.uint64(32)) * np.uint64(SLOTS) >> np.uint64(32)


def _count_pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_blocks(batches):
        word, first = _tokens(batch.column("text").to_pylist())
        code, n = np.unique(_pair(_histories(word, first), word), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(_slot(code).astype(np.int32)), pa.array(as_long(code)), pa.array(n.astype(np.int32))], ["slot", "code", "n"])


def level(count: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(count) / np.log(BASE) + 1e-9).astype(np.int64)


def meant(q: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of its counts; 0 for level 0."""
    low = np.ceil(BASE ** (q - 1.0) - 1e-9)
    high = np.maximum(low, np.ceil(BASE ** (1.0 * q) - 1e-9) - 1)
    return np.where(q > 0, (low + high) / 2, 0.0)


def lowest(q: np.ndarray) -> np.ndarray:
    """The least count of a level; 0 for level 0."""
    return np.where(q > 0, np.ceil(BASE ** (q - 1.0) - 1e-9), 0.0)


def _bits(codes: np.ndarray, levels: np.ndarray, bits: int | None = None) -> np.ndarray:
    """Places among so many bits, PROBES rows."""
    key = mix(codes.astype(np.uint64) * np.uint64(64) + levels.astype(np.uint64))
    a, b = key & np.uint64(0xFFFFFFFF), (key >> np.uint64(32)) | np.uint64(1)
    return np.stack([(a + np.uint64(k) * b) % np.uint64(bits or BITS) for k in range(PROBES)])


class LogFrequencyFilter:
    """Levels of the pairs whose slots are first … first + slots - 1; without slots, of all."""

    def __init__(self, bits: np.ndarray, highest: int, first: int = 0, slots: int = 0):
        self.bits, self.highest, self.first, self.slots = bits, highest, first, slots

    def holds(self, codes: np.ndarray) -> np.ndarray:
        """Whether the level of each code is this filter's to tell."""
        slot = _slot(codes)
        return (slot >= self.first) & (slot < self.first + self.slots)

    def places(self, codes: np.ndarray, levels: np.ndarray) -> np.ndarray:
        if not self.slots:
            return _bits(codes, levels, 8 * len(self.bits))
        width = 8 * len(self.bits) // self.slots
        return (_slot(codes) - np.uint64(self.first)) * np.uint64(width) + _bits(codes, levels, width)

    def levels(self, codes: np.ndarray) -> np.ndarray:
        """Level of each code: probed upwards until a level is missing."""
        out, open_ = np.zeros(len(codes), dtype=np.int64), np.arange(len(codes))
        for q in range(1, self.highest + 1):
            places = self.places(codes[open_], np.full(len(open_), q))
            held = np.ones(len(open_), dtype=bool)
            for row in places:
                held &= (self.bits[row >> np.uint64(3)] >> (row & np.uint64(7)).astype(np.uint8)) & 1 == 1
            open_ = open_[held]
            if not len(open_):
                break
            out[open_] = q
        return out


class Pairs(NamedTuple):
    """Levels of all pairs(slot, code, q), and the bits that each slot needs."""

    rows: DataFrame
    width: int
    highest: int

    def filters(self) -> Iterator[LogFrequencyFilter]:
        """One after the other, each of at most BITS bits (of one slot's, if these are more)."""
        many = max(1, min(SLOTS, BITS // self.width))
        for first in range(0, SLOTS, many):
            yield self._filter(first, min(many, SLOTS - first))

    def _filter(self, first: int, slots: int) -> LogFrequencyFilter:
        size, highest = slots * self.width // 8, self.highest

        def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = LogFrequencyFilter(np.zeros(size, dtype=np.uint8), highest, first, slots)
            for batch in batches:
                codes, q = batch.column("code").to_numpy().view(np.uint64), batch.column("q").to_numpy().astype(np.int64)
                every = np.repeat(codes, q)
                for row in own.places(every, np.arange(len(every)) - np.repeat(np.cumsum(q) - q, q) + 1):
                    np.bitwise_or.at(own.bits, (row >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (row & np.uint64(7)).astype(np.uint8)))
            for k in range(0, size, CHUNK_BYTES):
                if own.bits[k : k + CHUNK_BYTES].any():
                    yield pa.RecordBatch.from_arrays([pa.array([k // CHUNK_BYTES]), pa.array([own.bits[k : k + CHUNK_BYTES].tobytes()])], ["chunk", "held"])

        # A slot lies in one file of the table, so few chunks come from several tasks.
        wanted = self.rows.where((F.col("slot") >= first) & (F.col("slot") < first + slots)).select("code", "q")
        bits = np.zeros(size, dtype=np.uint8)
        for r in wanted.mapInArrow(partial, "chunk long, held binary").toLocalIterator():
            bits[r.chunk * CHUNK_BYTES : (r.chunk + 1) * CHUNK_BYTES] |= np.frombuffer(r.held, dtype=np.uint8)
        return LogFrequencyFilter(bits, highest, first, slots)


class Model:
    """All but the filters that is broadcast; its size is bounded by FREQUENT."""

    def __init__(self, frequent: np.ndarray, counts: np.ndarray, tokens: int, types: int, ends: int, pairs: int):
        order = np.argsort(frequent)
        self.frequent, self.counts = frequent[order], counts[order]
        self.tokens, self.types, self.ends = tokens, types, ends
        # The histories are all types but the end token, and the begin token.
        self.prior = pairs / types if types else 1.0

    @property
    def total(self) -> float:
        return self.tokens + 0.5 * (self.types + 1)

    def count(self, tokens: np.ndarray) -> np.ndarray:
        """Count of each token that is frequent or the end token, -1 for others."""
        if not len(self.frequent):
            return np.where(tokens == END, self.ends, -1)
        place = np.minimum(np.searchsorted(self.frequent, tokens), len(self.frequent) - 1)
        return np.where(tokens == END, self.ends, np.where(self.frequent[place] == tokens, self.counts[place], -1))


class Joined(NamedTuple):
    """What scored() takes beside the model: the counts(word, n) of all words, and the pairs."""

    counts: DataFrame
    pairs: Pairs


def train(docs: DataFrame, trained_on: Column) -> tuple[Model, Joined]:
    rows = docs.where(trained_on).select("text")
    counts = settled(rows.mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    end = int(END.astype(np.int64))
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("types"), F.coalesce(F.sum(F.when(F.col("word") == end, F.col("n"))), F.lit(0)).alias("ends")).first()
    step = F.floor(F.log2("n") * STEPS + 1e-9)
    words = counts.where(F.col("word") != end)
    sizes = sorted(((r.step, r.words) for r in words.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()), reverse=True)
    above = [s for (s, _), n in zip(sizes, np.cumsum([n for _, n in sizes])) if n <= FREQUENT]
    top = (words.where(step >= above[-1]) if above else words.where("false")).toArrow()
    q = (1 + F.floor(F.log(F.sum("n")) / np.log(BASE) + 1e-9)).cast("int")
    pairs = settled(rows.mapInArrow(_count_pairs, "slot int, code long, n int").repartition("slot").groupBy("slot", "code").agg(q.alias("q")))
    # One row for each slot, SLOTS at most.
    slots = pairs.groupBy("slot").agg(F.sum("q").alias("entries"), F.max("q").alias("highest"), F.count("*").alias("pairs")).collect()
    width = 64 * max([1, *(-(-r.entries * LOAD // 64) for r in slots)])
    model = Model(top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy(), size.tokens, size.types, size.ends, sum(r.pairs for r in slots))
    return model, Joined(counts, Pairs(pairs, width, max([0, *(r.highest for r in slots)])))


_SCORED = "row long, doc_id long, n_tokens long, n_known long, base double, model double, rare array<long>, held array<int>, times array<int>"


def _score(model, levels):
    """Scores each text's tokens whose pairs are the filter's to tell. Tokens that are not frequent are
    given out with the counts of their pairs."""

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, filter_, row = model.value, levels.value, TaskContext.get().partitionId() << 40
        for batch in text_blocks(batches):
            tokens, first = _tokens(batch.column("text").to_pylist())
            _, once, at = np.unique(_pair(_histories(tokens, first), tokens), return_index=True, return_inverse=True)
            word, before = tokens[once], _histories(tokens, first)[once]
            codes = _pair(before, word)
            mine = filter_.holds(codes)
            held = np.zeros(len(codes))
            held[mine] = lowest(filter_.levels(codes[mine]))
            count = own.count(word)
            joined = mine & (count < 0)
            share = (np.maximum(count, 0) + 0.5) / own.total
            scored = mine & (count >= 0)
            exact = np.where(scored, np.log10(share), 0.0)
            # Each word of a text is a history once. The end token is none, but the begin token is, and is as frequent.
            alone = np.where(scored, np.log10(own.prior / (np.maximum(count, 0) + own.prior)), 0.0)
            gain = np.where(scored, np.log10(1 + held / (own.prior * share)), 0.0)
            add = lambda x: np.add.reduceat(x, first[:-1])
            text = np.repeat(np.arange(batch.num_rows), np.diff(first))
            both, times = np.unique(text[joined[at]] * len(codes) + at[joined[at]], return_counts=True)
            per_text = np.bincount(both // len(codes), minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row + np.arange(batch.num_rows)), batch.column("doc_id"), pa.array(add(mine[at].astype(np.int64))), pa.array(add((scored & (count > 0))[at].astype(np.int64))), pa.array(add(exact[at])), pa.array(add((exact + alone + gain)[at])),
                    lists(as_long(word[both % len(codes)]), per_text, pa.int64()), lists(held[both % len(codes)].astype(np.int32), per_text, pa.int32()), lists(times.astype(np.int32), per_text, pa.int32()),
                ],
                ["row", "doc_id", "n_tokens", "n_known", "base", "model", "rare", "held", "times"],
            )
            row += batch.num_rows

    return score


def scored(docs: DataFrame, model: Model, joined: Joined) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    sc = docs.sparkSession.sparkContext
    shared, texts, scans = sc.broadcast(model), docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), []
    for one in joined.pairs.filters():
        levels = sc.broadcast(one)
        scans.append(settled(texts.mapInArrow(_score(shared, levels), _SCORED)))
        levels.unpersist()
    found = reduce(DataFrame.unionByName, scans)
    rare = found.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "held", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.held").alias("held"), F.col("x.times").alias("times"))
    n, times, total, prior = F.coalesce("n", F.lit(0)), F.col("times"), F.lit(model.total), F.lit(model.prior)
    exact, alone = F.log10((n + 0.5) / total), F.log10(prior / (n + prior))
    gain = F.when(n > 0, F.log10(1 + F.col("held") * total / (prior * (n + 0.5)))).otherwise(0.0)
    sums = rare.join(joined.counts, "word", "left").groupBy("row").agg(F.sum(F.when(n > 0, times).otherwise(0)).alias("more_known"), F.sum(times * exact).alias("more"), F.sum(times * (exact + alone + gain)).alias("more_model"))
    whole = found.drop("rare", "held", "times")
    if len(scans) > 1:
        whole = whole.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "model")))
    return whole.join(sums, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("model") + F.coalesce("more_model", F.lit(0.0))).alias("score")
    )


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold() == 1, F.lit(False))
    found = scored(docs, *train(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
