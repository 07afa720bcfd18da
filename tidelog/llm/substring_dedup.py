"""Substring dedup with a log-structured fingerprint index.

Every window of 50 consecutive words has a fingerprint: the least hash of the 8-word runs inside it.
Equal windows have equal fingerprints, and neighbouring windows mostly share theirs, so a document
gives about one fingerprint for each 22 words. The index has three kinds of immutable runs, one of each
for a batch of documents, bucketed and sorted by their keys:
  fingerprint runs  (print, least, most, n): the smallest and the largest doc_id that hold a fingerprint,
                    and how many texts do;
  window runs       (print, doc_id, hashes): the windows at fingerprints that several documents hold,
                    each under the smallest doc_id that has it;
  crowd runs        (hash, print, least, most): the windows at fingerprints of more than CROWD documents.
When there are MOST_RUNS of a kind, the next batch begins by compacting them into one. A batch is
deduplicated in these steps:
  1. its fingerprints become a run, which is merge-joined with the earlier runs, bucket by bucket:
     those of its fingerprints that several documents hold are candidates;
  2. the batch's texts with candidates, and earlier texts that alone held one until now, give the
     hashes of their windows at these fingerprints; the windows of fingerprints that were shared
     before come from the window runs, by a merge join;
  3. a window whose hash a smaller doc_id has is a duplicate. The windows of one fingerprint meet in
     one group; those of a fingerprint of more than CROWD documents are never brought together: the
     smallest doc_id of each window is a combined minimum, merge-joined with the crowd runs, and the
     windows of several documents go out in broadcast sets of at most SET_WINDOWS, one scan of the
     texts that hold them for each set.
Windows count as equal when their fingerprints and their 64-bit hashes over all 50 words are.
Batches come in rising order of doc_id, so each document is judged when its batch is.

Defined results: null, empty and short texts have no windows and stay whole; a very long text is one
row of one task; a row without an id has no smaller or larger id: it stays whole and removes nothing;
repeated rows (same id, same text) get equal results; of several texts under one id, none removes
words of another, each is judged by its own words, and all of them count for larger ids; equal
windows within one document stay (there are no other ties); columns beside doc_id and text are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import lists, looked_up, of_ids, settled, shared_dir, table, text_blocks
from tidelog.llm.textkernels import Words, as_long, sliding_min

WIDTH = 50
GRAM = 8
MOST_RUNS = 2
BATCHES = 3

#: Documents of one fingerprint whose windows meet in one group.
CROWD = 500

#: Documents whose windows at one crowded fingerprint are united in one group, before the runs.
UNITED = 20 * CROWD

#: Windows in one broadcast set (24 bytes each).
SET_WINDOWS = 1_000_000


def _least_grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(first word, fingerprint) of each window that lies within one text."""
    least = sliding_min(words.window_hashes(GRAM), WIDTH - GRAM + 1)
    at = np.flatnonzero(words.valid(WIDTH))
    return at, least[at]


def _digest(text: str | None) -> str:
    """SHA-256 of a text's words joined by one space."""
    return hashlib.sha256(b" ".join((text or "").encode().split())).hexdigest()


def _text_key(digest: str) -> int:
    """Tells texts of one doc_id apart."""
    return int.from_bytes(bytes.fromhex(digest[:16]), "big", signed=True)


def _facts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_blocks(batches):
        texts = batch.column("text").to_pylist()
        words = Words(texts, "exact")
        at, least = _least_grams(words)
        of = words.text_of_word()[at]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (of[1:] != of[:-1]) | (least[1:] != least[:-1])
        of, least = of[new], least[new]
        order = np.lexsort((least, of))
        of, least = of[order], least[order]
        new = np.ones(len(of), dtype=bool)
        new[1:] = (of[1:] != of[:-1]) | (least[1:] != least[:-1])
        of, least = of[new], least[new]
        whole = [_digest(t) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([_text_key(x) for x in whole], pa.int64()), pa.array(words.counts), pa.array(whole), lists(as_long(least), np.bincount(of, minlength=len(texts)), pa.int64())],
            ["doc_id", "text_key", "n_words", "whole_sha256", "prints"],
        )


def document_facts(docs: DataFrame) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, text_key, n_words, whole_sha256, prints (distinct fingerprints)."""
    return docs.mapInArrow(_facts, "doc_id long, text_key long, n_words long, whole_sha256 string, prints array<long>")


class FingerprintIndex:
    """Immutable runs, bucketed and sorted by their keys, in a folder that the whole cluster sees."""

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int | None = None):
        self.spark, self.folder = spark, folder or shared_dir(spark)
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.prints: list[str] = []
        self.windows: list[str] = []
        self.crowds: list[str] = []

    def _write(self, rows: DataFrame, key: str) -> str:
        name = f"tidelog_run_{uuid.uuid4().hex}"
        ordered = rows.repartition(self.buckets, key).sortWithinPartitions(key)
        ordered.write.format("parquet").option("compression", "zstd").option("path", f"{self.folder}/{name}").bucketBy(self.buckets, key).sortBy(key).saveAsTable(name)
        return name

    def _merged(self, runs: list[str], rows: DataFrame, keys: list[str], columns: tuple[str, ...]) -> DataFrame:
        """Writes a run and gives it back with old_… of the columns of the earlier runs, from a merge join
        with each: their least, most and sum."""
        name = self._write(rows, keys[0])
        new, old = self.spark.table(name), {c: [F.lit(None).cast("long")] * 2 for c in columns}
        for k, run in enumerate(runs):
            new = new.hint("merge").join(self.spark.table(run).select(*keys, *(F.col(c).alias(f"{c}_{k}") for c in columns)), keys, "left")
            for c in columns:
                old[c].append(F.col(f"{c}_{k}"))
        runs.append(name)
        how = {"least": lambda x: F.least(*x), "most": lambda x: F.greatest(*x), "n": lambda x: sum((F.coalesce(y, F.lit(0)) for y in x), F.lit(0).cast("long"))}
        return new.select(*keys, *columns, *(how[c](old[c]).alias(f"old_{c}") for c in columns))

    def add_prints(self, rows: DataFrame) -> DataFrame:
        """Adds a run of rows(print, least, most, n), one a print, and looks up the earlier ones."""
        return self._merged(self.prints, rows, ["print"], ("least", "most", "n"))

    def add_crowds(self, rows: DataFrame) -> DataFrame:
        """Adds a run of rows(hash, print, least, most), one a window, and looks up the earlier ones."""
        return self._merged(self.crowds, rows, ["hash", "print"], ("least", "most"))

    def add_windows(self, rows: DataFrame) -> None:
        self.windows.append(self._write(rows, "print"))

    def compact(self) -> None:
        """Merges the runs of each kind into one when there are MOST_RUNS."""
        ends = (F.min("least").alias("least"), F.max("most").alias("most"))
        if len(self.prints) >= MOST_RUNS:
            self.prints = [self._write(self._united(self.prints).groupBy("print").agg(*ends, F.sum("n").alias("n")), "print")]
        if len(self.crowds) >= MOST_RUNS:
            self.crowds = [self._write(self._united(self.crowds).groupBy("hash", "print").agg(*ends), "hash")]
        if len(self.windows) >= MOST_RUNS:
            self.windows = [self._write(self._united(self.windows), "print")]

    def forget(self) -> None:
        """Takes the runs out of the session's catalog."""
        for name in self.prints + self.windows + self.crowds:
            self.spark.sql(f"DROP TABLE {name}")

    def _united(self, runs: list[str]) -> DataFrame:
        rows = self.spark.table(runs[0])
        for name in runs[1:]:
            rows = rows.unionByName(self.spark.table(name))
        return rows

    def windows_at(self, prints: DataFrame) -> DataFrame:
        """The rows (print, doc_id, hashes) of all window runs at prints(print)."""
        out = self.spark.createDataFrame([], "print long, doc_id long, hashes array<long>")
        for name in self.windows:
            out = out.unionByName(self.spark.table(name).hint("merge").join(prints, "print", "left_semi"))
        return out


def _candidate_windows(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, text key, starts, fingerprints, hashes, parts) of the windows at each text's candidates
    (print, parts), in order of fingerprint."""
    texts = batch.column("text").to_pylist()
    words = Words(texts, "exact")
    at, least = _least_grams(words)
    if not len(at):
        return
    hashes = words.window_hashes(WIDTH)[at]
    first = np.searchsorted(words.text_of_word()[at], np.arange(batch.num_rows + 1))
    for k, candidates in enumerate(batch.column("candidates").to_pylist()):
        own = least[first[k] : first[k + 1]].view(np.int64)
        wanted, parts = np.array([(c["print"], c["parts"]) for c in candidates], dtype=np.int64).reshape(-1, 2).T
        order = np.argsort(wanted)
        wanted, parts = wanted[order], parts[order]
        if not len(own) or not len(wanted):
            continue
        place = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
        found = np.flatnonzero(wanted[place] == own)
        if len(found):
            # The windows of one fingerprint need not be neighbours.
            found = found[np.lexsort((found, place[found]))]
            yield k, _text_key(_digest(texts[k])), at[first[k] : first[k + 1]][found] - words.first[k], own[found], as_long(hashes[first[k] : first[k + 1]][found]), parts[place[found]]


def _windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each fingerprint of each text."""
    for batch in text_blocks(batches):
        prints, rows, keys, starts, counts, taken = [], [], [], [], [], []
        for k, key, at, own, hashes, _ in _candidate_windows(batch):
            new = np.flatnonzero(np.concatenate([[True], np.diff(own) != 0]))
            prints.append(own[new])
            rows.append(np.full(len(new), k))
            keys.append(np.full(len(new), key))
            counts.append(np.diff(np.append(new, len(own))))
            starts.append(at)
            taken.append(hashes)
        if rows:
            n, row = np.concatenate(counts), pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(prints)), batch.column("doc_id").take(row), pa.array(np.concatenate(keys)), batch.column("is_new").take(row), lists(np.concatenate(starts), n, pa.int32()), lists(np.concatenate(taken), n, pa.int64())],
                ["print", "doc_id", "text_key", "is_new", "starts", "hashes"],
            )


_WINDOWS = "print long, doc_id long, text_key long, is_new boolean, starts array<int>, hashes array<long>"


_ENDS = "print long, part long, hashes array<long>, least array<long>, most array<long>"


def _window_ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest and the largest doc_id of each window in a batch, a row for each fingerprint and part;
    windows are dealt to the parts of a fingerprint by their hash."""
    for batch in text_blocks(batches):
        ids, found = batch.column("doc_id").to_numpy(), list(_candidate_windows(batch))
        if found:
            own, hashes, parts = (np.concatenate([x[k] for x in found]) for k in (3, 4, 5))
            doc = np.repeat(ids[[x[0] for x in found]], [len(x[3]) for x in found])
            yield from _united_ends(own, ((hashes.view(np.uint64) >> np.uint64(8)) % parts.astype(np.uint64)).astype(np.int64), hashes, doc, doc)


def _united_ends(own: np.ndarray, part: np.ndarray, hashes: np.ndarray, least: np.ndarray, most: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each (fingerprint, part) with its distinct windows, their least and their most."""
    order = np.lexsort((hashes, part, own))
    own, part, hashes, least, most = (x[order] for x in (own, part, hashes, least, most))
    new = np.concatenate([[True], (np.diff(own) != 0) | (np.diff(part) != 0) | (np.diff(hashes) != 0)])
    at = np.flatnonzero(new)
    least, most = np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)
    own, part, hashes = own[at], part[at], hashes[at]
    row = np.flatnonzero(np.concatenate([[True], (np.diff(own) != 0) | (np.diff(part) != 0)]))
    sizes = np.diff(np.append(row, len(own)))
    yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(part[row]), *(lists(x, sizes, pa.int64()) for x in (hashes, least, most))], ["print", "part", "hashes", "least", "most"])


def _all_ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _window_ends in order of (print, part), united."""
    held: list[pa.RecordBatch] = []

    def united() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        sizes = pc.list_value_length(rows.column("hashes").combine_chunks()).to_numpy()
        flat = [rows.column(c).combine_chunks().flatten().to_numpy() for c in ("hashes", "least", "most")]
        yield from _united_ends(np.repeat(rows.column("print").to_numpy(), sizes), np.repeat(rows.column("part").to_numpy(), sizes), *flat)

    for batch in batches:
        if not batch.num_rows:
            continue
        own, part = batch.column("print").to_numpy(), batch.column("part").to_numpy()
        cut = int(np.flatnonzero((own == own[-1]) & (part == part[-1]))[0])
        same = held and (held[0].column("print")[0].as_py(), held[0].column("part")[0].as_py()) == (own[-1], part[-1])
        if not same:
            held.append(batch.slice(0, cut))
            if sum(h.num_rows for h in held):
                yield from united()
            held = [batch.slice(cut)]
        else:
            held.append(batch)
            # A group of many rows is united as it comes.
            if len(held) > 8:
                held = list(united())
    if held:
        yield from united()


def _held_windows(shared):
    """The starts of each new text's windows that a smaller doc_id has, by a broadcast set of windows."""

    def held(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, prints, least = shared.value
        for batch in text_blocks(batches):
            ids, new, out = batch.column("doc_id").to_pylist(), batch.column("is_new").to_pylist(), []
            for k, key, at, own, mine, _ in _candidate_windows(batch) if len(hashes) else ():
                place = np.searchsorted(hashes, mine)
                again = np.zeros(len(mine), dtype=bool)
                # Windows with equal hashes and other fingerprints stand together.
                while True:
                    inside = place < len(hashes)
                    same = inside & (hashes[np.minimum(place, len(hashes) - 1)] == mine)
                    if not same.any():
                        break
                    at_place = np.minimum(place, len(hashes) - 1)
                    again |= same & (prints[at_place] == own) & (least[at_place] < ids[k])
                    place = np.where(same, place + 1, len(hashes))
                if new[k] and again.any():
                    out.append((ids[k], key, at[again].tolist()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.int32()))], ["doc_id", "text_key", "starts"])

    return held


def _repeats(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (print, doc_id), at most CROWD documents a print; those without starts are from
    the index. Gives the starts of a text's windows that a smaller doc_id holds, and, as rows with
    hashes, the windows that the index lacks, under their smallest doc_id."""
    group, doc, found = None, None, []
    seen, held, own = set(), set(), set()  # of smaller documents; of this one, in the index and in its texts

    def close() -> None:
        if more := own - seen - held:
            found.append((None, doc, None, group, sorted(more)))
        seen.update(own, held)
        own.clear()
        held.clear()

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("print", "doc_id", "text_key", "is_new", "starts", "hashes")]
        for key, doc_id, text_key, is_new, starts, hashes in zip(*columns):
            if key != group or doc_id != doc:
                close()
                if key != group:
                    seen.clear()
                group, doc = key, doc_id
            if starts is None:
                held.update(hashes)
                continue
            own.update(hashes)
            if is_new and seen:
                again = [start for start, h in zip(starts, hashes) if h in seen]
                if again:
                    found.append((text_key, doc_id, again, None, None))
        if found:
            yield _found_rows(found)
            found.clear()
    close()
    if found:
        yield _found_rows(found)


def _found_rows(found: list[tuple]) -> pa.RecordBatch:
    keys, docs, starts, prints, hashes = zip(*found)
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(keys, pa.int64()), pa.array(starts, pa.list_(pa.int32())), pa.array(prints, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], ["doc_id", "text_key", "starts", "print", "hashes"])


def repeated_windows(index: FingerprintIndex, facts: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds a batch to the index and gives (doc_id, text_key, starts) of the windows of its documents
    that a smaller doc_id holds. docs(doc_id, text) has the texts of this and the earlier batches."""
    index.compact()
    posts = facts.where("doc_id is not null").select("doc_id", F.explode("prints").alias("print"))
    own = posts.groupBy("print").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n"))
    shared = F.greatest("most", "old_most") > F.least("least", "old_least")
    alone = F.coalesce(F.col("old_least") == F.col("old_most"), F.lit(False)).alias("alone")
    met = settled(index.add_prints(own).where(shared).select("print", "old_least", "old_n", alone, (F.col("n") + F.col("old_n") > CROWD).alias("crowded"), F.ceil((F.col("n") + F.col("old_n")) / UNITED).alias("parts")))

    def texts(crowded: bool) -> DataFrame:
        """The texts at the candidates, with their candidates: those of the batch, and earlier ones that
        were alone."""
        candidates = met.where("crowded" if crowded else "not crowded")
        one = candidates.select("print", "parts")
        new = (looked_up(posts, one, "print") if crowded else posts.join(one, "print")).select("doc_id", "print", "parts", F.lit(True).alias("is_new"))
        lone = candidates.where("alone").select(F.col("old_least").alias("doc_id"), "print", "parts", F.lit(False).alias("is_new"))
        wanted = new.unionByName(lone).groupBy("doc_id").agg(F.collect_set(F.struct("print", "parts")).alias("candidates"), F.max("is_new").alias("is_new"))
        return of_ids(docs, wanted)

    def past(crowded: bool) -> DataFrame:
        return index.windows_at(met.where("crowded" if crowded else "not crowded").where("old_n > 0 AND NOT alone").select("print"))

    # Groups of few documents. A row of the index comes before the texts of its document.
    history = past(False).select("print", "doc_id", F.lit(None).cast("long").alias("text_key"), F.lit(False).alias("is_new"), F.lit(None).cast("array<int>").alias("starts"), "hashes")
    groups = texts(False).mapInArrow(_windows, _WINDOWS).unionByName(history).repartition("print").sortWithinPartitions("print", "doc_id", F.col("starts").isNotNull())
    few = settled(groups.mapInArrow(_repeats, "doc_id long, text_key long, starts array<int>, print long, hashes array<long>"))
    index.add_windows(few.where("print is not null").select("print", "doc_id", "hashes"))
    found = few.where("print is null").select("doc_id", "text_key", "starts")

    # Crowds: the smallest doc_id of each window, and a scan with the windows of several documents.
    crowded = texts(True)
    before = past(True).select(F.explode("hashes").alias("hash"), "print", F.col("doc_id").alias("least"), F.col("doc_id").alias("most"))
    united = crowded.mapInArrow(_window_ends, _ENDS).repartition("print", "part").sortWithinPartitions("print", "part").mapInArrow(_all_ends, _ENDS)
    one = united.select("print", F.explode(F.arrays_zip("hashes", "least", "most")).alias("x")).select(F.col("x.hashes").alias("hash"), "print", F.col("x.least").alias("least"), F.col("x.most").alias("most"))
    ends = one.unionByName(before).groupBy("hash", "print").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    several = settled(index.add_crowds(ends).where(F.col("most") > F.least("least", "old_least")).select("hash", "print", F.least("least", "old_least").alias("least")))
    parts = -(-several.count() // SET_WINDOWS)
    for part in range(parts):
        rows = several.where(F.pmod(F.xxhash64("hash"), F.lit(parts)) == part).orderBy("hash").toArrow()
        shared = docs.sparkSession.sparkContext.broadcast(tuple(rows.column(c).to_numpy() for c in ("hash", "print", "least")))
        found = found.unionByName(settled(crowded.mapInArrow(_held_windows(shared), "doc_id long, text_key long, starts array<int>")))
        shared.unpersist()
    return settled(found.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("starts")).alias("starts")))


def _kept_words(words: list[bytes], starts: list[int]) -> list[bytes]:
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, np.asarray(starts) + WIDTH, -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(cover[:-1]) == 0)]


def _remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_blocks(batches):
        ids, keys, removed, kept_texts = [], [], [], []
        for doc_id, text, repeats in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("repeats").to_pylist()):
            key = _text_key(_digest(text))
            starts = [r["starts"] for r in repeats if r["text_key"] == key]
            if starts:
                words = text.encode().split()
                kept = _kept_words(words, starts[0])
                ids.append(doc_id)
                keys.append(key)
                removed.append(len(words) - len(kept))
                kept_texts.append(b" ".join(kept).decode())
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept_texts, pa.string())], ["doc_id", "text_key", "n_removed", "kept_text"])


def without_repeats(docs: DataFrame, batches: int = BATCHES, index: FingerprintIndex | None = None) -> tuple[DataFrame, DataFrame]:
    """(facts, changed): a row of document_facts for each row of docs, and doc_id, text_key, n_removed
    and kept_text for the rows that lose words."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    facts = settled(document_facts(docs))
    kept_index, index = index, index or FingerprintIndex(docs.sparkSession)
    # Borders between batches: a few quantiles of the ids.
    borders = facts.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0] or []
    borders = sorted(set(borders))
    found = None
    for low, high in zip([None, *borders], [*borders, None]):
        own = facts if low is None else facts.where(F.col("doc_id") > low)
        so_far = docs
        if high is not None:
            own, so_far = own.where(F.col("doc_id") <= high), docs.where(F.col("doc_id") <= high)
        repeats = repeated_windows(index, own, so_far)
        found = repeats if found is None else found.unionByName(repeats)
    if kept_index is None:
        index.forget()
    by_id = found.groupBy("doc_id").agg(F.collect_list(F.struct("text_key", "starts")).alias("repeats"))
    return facts, of_ids(docs, by_id).mapInArrow(_remove, "doc_id long, text_key long, n_removed long, kept_text string")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, changed = without_repeats(table(spark, sf_dir, "documents"))
    digest = changed.groupBy("doc_id", "text_key").agg(F.max("n_removed").alias("n_removed"), F.max(F.sha2("kept_text", 256)).alias("changed_sha256"))
    told = facts.where("doc_id is not null").join(digest, ["doc_id", "text_key"], "left")
    nameless = facts.where("doc_id is null").withColumns({"n_removed": F.lit(None).cast("long"), "changed_sha256": F.lit(None).cast("string")})
    columns = ["doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("changed_sha256", "whole_sha256").alias("kept_sha256")]
    return told.select(*columns).unionByName(nameless.select(*columns))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50
), g AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM s
), f AS (
  SELECT h, min(doc_id) AS first_id FROM g GROUP BY h
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM g JOIN f ON g.h = f.h WHERE g.doc_id > f.first_id
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS t FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p WHERE gone.p IS NULL GROUP BY words.doc_id
), n AS (
  SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
