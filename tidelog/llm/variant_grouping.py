"""Spelling variants: words one edit apart, found by grams of variable length.

Every word gets a mark at its begin and one at its end and is cut into grams of 2 to most_gram
characters. The gram dictionary is pruned by frequency: a gram is extended only while it is frequent (it
occurs more than FREQUENT_SHARE of all words' number), so a rare gram stays short. From each place the
word takes the longest gram of the dictionary, and leaves out those that lie within another.

One edit at a place can change only the grams that hold the place, and those beside it whose
choice looked over it: to the left, if a frequent gram runs up to the place from where the gram starts or
before; to the right, if the end of a frequent gram runs on from the place to beyond the gram. They
follow each other, so each word has, for each gram, the last one that an edit can change with it. Two
words that are one edit apart share all other grams, at one distance from the begin, or shifted by one
in the longer word. Of these the rarest stands behind grams that the edit changed, all of them in each of
the two words. So a word is looked up by its rarest grams up to the first that no edit can change
together with all before it, and no pair is missed. Only these lists are merged, split by place and
length, and the merged pairs are verified. With most_gram = (least length + 1) // 2 at least one gram
survives any edit, so no word lacks a list.

A list of more than LONG_LIST entries isn't merged: its words get the hash of each string that one
deletion makes of them, and meet there. At most some hundred words times the length have one such
string, so no group grows with the data.

Defined results: a null or empty text has no words; a null doc_id counts as empty in the hash that
deletes letters; other columns are not read; repeated rows count each; a very long run is one word,
with work proportional to its length (its square only in a long list, in numbers, not texts); among near
words of one count the smallest by code points is the form; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import settled, table, text_blocks

LEAST_LENGTH = 7
LEAST_COUNT = 2
TIMES = 10
DAMAGE = 31

SHORTEST_GRAM = 2

#: A gram is frequent when it occurs more often than once in so many words; so there are at most
#: SHARE * (mean length) * 2 frequent grams, and with 92 characters at most 92**2 + 92**3.
FREQUENT_SHARE = 5000
LEAST_FREQUENT = 8

#: Entries of a list that is merged as it is.
LONG_LIST = 1000

BEGIN, END = "\x01", "\x02"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- words and their counts


def _counter(least_length: int):
    run_of = re.compile(f"[A-Za-zÀ-ÿ]{{{least_length},}}")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches):
            found: Counter = Counter()
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if not text:
                    continue
                begin = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run in run_of.findall(text.translate(LOWER)):
                    h = zlib.crc32(run.encode(), begin)
                    if h % DAMAGE == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < least_length:
                            continue
                    found[run] += 1
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])

    return count


def counted_words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of docs(doc_id, text): each run's letters by the rule of damage, lower case."""
    runs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_counter(least_length), "word string, n long")
    return runs.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# --- grams


class Grams:
    """The pruned dictionary: a gram is in it when it has two characters, or what comes before its last
    character is frequent. count gives the occurrences of the frequent grams of up to most - 1 characters."""

    def __init__(self, count: dict[str, int], most: int):
        self.count, self.most = count, most
        #: Proper ends of frequent grams.
        self.ends = {g[k:] for g in count for k in range(1, len(g))}

    def decomposed(self, marked: str) -> list[tuple[int, int]]:
        """(start, end) of the grams of a marked word, by start; none lies within another."""
        out, n, last = [], len(marked), 0
        for start in range(n - SHORTEST_GRAM + 1):
            end = start + SHORTEST_GRAM
            while end < n and end - start < self.most and marked[start:end] in self.count:
                end += 1
            if end > last:
                out.append((start, end))
                last = end
        return out

    def changed(self, marked: str, grams: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """For each edit inside the word, (first, end) of the numbers of the grams that it can change."""
        n, count, ends, most = len(marked), self.count, self.ends, self.most
        starts, stops = [a for a, _ in grams], [b for _, b in grams]
        out = []
        # The character at place `at` changes or goes (after = at + 1); one comes in front of it (after = at).
        for at in range(1, n):
            first = bisect_right(stops, at)
            for p in range(max(0, at - most + 1), at - 1):
                if marked[p:at] in count:
                    # What starts here looked at the place, and could cover all that starts later.
                    first = min(first, bisect_left(starts, p))
                    break
            for after in (at, at + 1) if at < n - 1 else (at,):
                end = bisect_left(starts, after)
                for e in range(min(n, after + most - 1), after + 1, -1):
                    if marked[after : e - 1] in ends:
                        # What ends here may come to start before the place, and cover all that ends earlier.
                        end = max(end, bisect_right(stops, e))
                        break
                out.append((first, end))
        return out

    def rarity(self, gram: str) -> tuple[int, str]:
        """A fixed order of all grams, rare ones first: counts of the frequent ones; of others, what the
        counts of their parts suggest."""
        known = self.count.get(gram)
        if known is None:
            a, b = self.count.get(gram[:-1], 1), self.count.get(gram[1:], 1)
            known = a * b // max(1, self.count.get(gram[1:-1], a * b))
        return known, gram

    def lists(self, word: str) -> list[tuple[str, int]]:
        """(gram, place) of the lists in which the word is looked up: its rarest grams up to the first that no
        edit can change together with all before it."""
        marked = BEGIN + word + END
        grams = self.decomposed(marked)
        # far[k]: one more than the last gram that one edit can change together with gram k.
        far = [0] * len(grams)
        for first, end in self.changed(marked, grams):
            if first < end and far[first] < end:
                far[first] = end
        far = list(accumulate(far, max))
        out, low, high = [], len(grams), -1
        for _, gram, place, k in sorted((*self.rarity(marked[a:b]), a, k) for k, (a, b) in enumerate(grams)):
            out.append((gram, place))
            low, high = min(low, k), max(high, k)
            if high >= far[low]:
                break
        return out


def _gram_counts(longest: int):
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, "word"):
            found: Counter = Counter()
            for word in batch.column("word").to_pylist():
                marked = BEGIN + word + END
                for size in range(SHORTEST_GRAM, longest + 1):
                    found.update(marked[k : k + size] for k in range(len(marked) - size + 1))
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["gram", "n"])

    return count


def gram_dictionary(words: DataFrame, least_length: int = LEAST_LENGTH) -> Grams:
    """The dictionary of words(word). Only frequent grams come to the driver (see FREQUENT_SHARE)."""
    most = (least_length + 1) // 2
    least = max(LEAST_FREQUENT, words.count() // FREQUENT_SHARE)
    if most <= SHORTEST_GRAM:
        return Grams({}, most)
    grams = words.select("word").mapInArrow(_gram_counts(most - 1), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return Grams({r.gram: r.n for r in grams.where(F.col("n") > least).collect()}, most)


# --- pairs


def _entries(shared):
    def entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = shared.value
        for batch in text_blocks(batches, "word"):
            gram, place, length, own, words = [], [], [], [], []
            for word in batch.column("word").to_pylist():
                n = len(word)
                for g, at in grams.lists(word):
                    gram += [g] * 3
                    place += [at, at, at + 1]
                    length += [n, n + 1, n + 1]
                    own += [True, False, False]
                    words += [word] * 3
            arrays = [pa.array(gram, pa.string()), pa.array(place, pa.int32()), pa.array(length, pa.int32()), pa.array(own, pa.bool_()), pa.array(words, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["gram", "place", "length", "own", "word"])

    return entries


_RNG = np.random.default_rng(7)
_CHARACTER = _RNG.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_ROOT = np.uint64(0x9E3779B97F4A7C15)


def _character_values(codes: np.ndarray) -> np.ndarray:
    value = np.zeros(len(codes), dtype=np.uint64)
    for shift in (0, 8, 16):
        value = value * _ROOT + _CHARACTER[(codes >> np.uint32(shift)) & np.uint32(255)]
    return value


def shortened(word: str) -> np.ndarray:
    """Hashes of the word and of each string that one deletion makes of it, without repetitions."""
    values = _character_values(np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32))
    n = len(values)
    powers = np.full(n + 1, _ROOT, dtype=np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    before = np.concatenate([[np.uint64(0)], np.cumsum(values * powers[:n], dtype=np.uint64)])
    # What follows the deleted character moves one place to the front.
    moved = np.concatenate([np.cumsum((values[1:] * powers[: n - 1])[::-1], dtype=np.uint64)[::-1], [np.uint64(0)]])
    return np.unique(np.concatenate([before[n:], before[:n] + moved])).view(np.int64)


def _shortened(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_blocks(batches, "word"):
        words = batch.column("word").to_pylist()
        for k in range(0, len(words), 5000):
            hashes = [shortened(w) for w in words[k : k + 5000]]
            of = np.repeat(np.arange(k, k + len(hashes)), [len(h) for h in hashes])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), batch.column("word").take(pa.array(of))], ["short", "word"])


#: One edit apart, for two different words.
ONE_EDIT = "levenshtein(a.word, b.word, 1) = 1"


def near_pairs(words: DataFrame, least_length: int = LEAST_LENGTH, long_list: int = LONG_LIST) -> DataFrame:
    """(a, b) for all pairs of words(word) that are one edit apart, once each. Words are distinct, of at
    least least_length characters (3 or more)."""
    if least_length < 3:
        raise ValueError("words must have three characters at least")
    shared = words.sparkSession.sparkContext.broadcast(gram_dictionary(words, least_length))
    entries = settled(words.select("word").mapInArrow(_entries(shared), "gram string, place int, length int, own boolean, word string"))
    of_list = ["gram", "place", "length"]
    sizes = settled(entries.groupBy(of_list).agg(F.count("*").alias("n"), F.max("own").alias("owned")).where("n > 1 and owned").drop("owned"))
    small, long = sizes.where(F.col("n") <= long_list).select(of_list), sizes.where(F.col("n") > long_list).select(of_list)
    merged = entries.join(small, of_list)
    pairs = _verified(merged.where("own"), merged, of_list, F.col("b.own") & (F.col("a.word") >= F.col("b.word")))
    hot = entries.join(F.broadcast(settled(long)) if long.count() < 100_000 else long, of_list, "left_semi").select("word").distinct()
    short = settled(hot.mapInArrow(_shortened, "short long, word string"))
    more = _verified(short, short, ["short"], F.col("a.word") >= F.col("b.word"))
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    return pairs.unionByName(more).select(*ordered).distinct()


def _verified(left: DataFrame, right: DataFrame, on: list[str], out) -> DataFrame:
    a, b = left.alias("a"), right.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in on]
    matched = F.expr(ONE_EDIT) & ~out
    for c in same:
        matched = c & matched
    return a.join(b, matched).select(F.col("a.word").alias("a"), F.col("b.word").alias("b"))


# --- forms and roots


def grouped(words: DataFrame, least_length: int = LEAST_LENGTH, times: int = TIMES, long_list: int = LONG_LIST) -> DataFrame:
    """For each row of words(word, n): word, n, n_near (near words), form (the near word of largest n, if
    that is at least times the word's), form_n, and root, where following forms ends."""
    words = settled(words.select("word", "n"))
    pairs = settled(near_pairs(words, least_length, long_list))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    of = words.select(F.col("word").alias("b"), F.col("n").alias("near_n"))
    # The least of (-n, word) is the largest count and, among equals, the smallest word.
    near = both.join(of, "b").groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("near_n"), F.col("b"))).alias("best"))
    best_n = -F.col("best.col1")
    found = words.join(near.withColumnRenamed("a", "word"), "word", "left")
    is_form = best_n >= F.lit(times) * F.col("n")
    found = settled(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.b")).alias("form"), F.when(is_form, best_n).alias("form_n")))
    roots = found.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        # Each round doubles how far a word sees; counts grow tenfold a step, so there are few rounds.
        roots = settled(roots)
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        jumped = settled(roots.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        roots = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            break
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_variant_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(counted_words(table(spark, sf_dir, "documents")))
