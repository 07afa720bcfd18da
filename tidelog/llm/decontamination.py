"""Benchmark decontamination with a broadcast hash set of test n-grams.

Benchmark texts are normalised to words (A-Z lowered; words are runs of 0-9, a-z and characters
beyond ASCII). Each run of 10 item words is a window; an item with fewer words, but at least one,
is one window. Tasks hash every window of every document, look it up in the set, and compare the
words of each hit in full. A broadcast set never holds more than MAX_WINDOWS windows: a larger
benchmark is taken in several such sets, one scan each, and each row carries its hits from scan to scan;
between scans the rows are written to a table and the set is released.

Defined results: null or wordless documents have no hits; null or wordless items have no windows;
items without an id are skipped; repeated items hit under each of their ids; an empty benchmark
finds nothing; repeated documents each get their row; a very long text is one row of one task; nothing
depends on order, so there are no ties; columns beside doc_id and text are not read by contamination(),
and may have any names in decontaminated().
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import settled, table, text_blocks
from tidelog.llm.textkernels import Words

WIDTH = 10

#: Windows in one broadcast set: about 150 MB at ten words of seven letters each.
MAX_WINDOWS = 1_000_000


def _windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_blocks(batches):
        words = Words(batch.column("text").to_pylist(), "alnum")
        items, out, sizes = batch.column("item_id").to_pylist(), [], []
        for k, (a, b) in enumerate(zip(words.first[:-1], words.first[1:])):
            own = [words.word(i).decode("utf-8", "surrogatepass").translate(_LOWER) for i in range(a, b)]
            width = min(WIDTH, len(own))
            found = {" ".join(own[i : i + width]) for i in range(len(own) - width + 1)} if own else ()
            out += [(items[k], x) for x in found]
            sizes += [width] * len(found)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string()), pa.array(sizes, pa.int32())], ["item_id", "window", "width"])


_LOWER = {c: c + 32 for c in range(65, 91)}


class WindowSet:
    """Test windows by hash, in one sorted array for each width."""

    def __init__(self, rows: list[tuple[str, str]]):
        items: dict[str, set[str]] = defaultdict(set)
        for item, window in rows:
            items[window].add(item)
        by_width: dict[int, list[str]] = defaultdict(list)
        for window in items:
            by_width[window.count(" ") + 1].append(window)
        self.tables = []
        for width, windows in sorted(by_width.items()):
            hashes = np.array([Words([x], "alnum").window_hashes(width)[0] for x in windows], dtype=np.uint64)
            order = np.argsort(hashes)
            likely = np.zeros(1 << 16, dtype=bool)
            likely[hashes >> np.uint64(48)] = True
            self.tables.append((width, hashes[order], likely, [windows[i] for i in order], [sorted(items[windows[i]]) for i in order]))

    def hits(self, words: Words) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, width, items) of each occurrence of a test window within one text."""
        for width, hashes, likely, windows, items in self.tables:
            own = words.window_hashes(width)
            at = np.flatnonzero(likely[own >> np.uint64(48)])
            at = at[words.valid(width)[at]]
            place = np.minimum(np.searchsorted(hashes, own[at]), len(hashes) - 1)
            same = hashes[place] == own[at]
            for i, k in zip(at[same].tolist(), place[same].tolist()):
                while k < len(hashes) and hashes[k] == own[i]:  # windows with equal hashes stand together
                    if b" ".join(words.word(j) for j in range(i, i + width)).decode("utf-8", "surrogatepass").translate(_LOWER) == windows[k]:
                        yield i, width, items[k]
                    k += 1


def _found(words: Words, windows: WindowSet) -> tuple[np.ndarray, dict[int, set[str]]]:
    """Whether each word of the block is hit, and the items found in each text that has hits."""
    cover = np.zeros(len(words.hashes) + 1, dtype=np.int32)
    items: dict[int, set[str]] = defaultdict(set)
    for i, width, own in windows.hits(words):
        cover[i] += 1
        cover[i + width] -= 1
        items[int(np.searchsorted(words.first, i, side="right")) - 1].update(own)
    return np.cumsum(cover[:-1]) > 0, items


def _spans(hit: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return [{"start": a, "end": b} for a, b in zip(edges[0::2].tolist(), edges[1::2].tolist())]


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scan(shared) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds what the set finds to the hits of the scans before."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches):
            words = Words(batch.column("text").to_pylist(), "alnum")
            hit, found = _found(words, shared.value)
            spans = [_spans(hit[words.first[k] : words.first[k + 1]]) if k in found else [] for k in range(batch.num_rows)]
            items = [sorted(found.get(k, ())) for k in range(batch.num_rows)]
            if "spans" in batch.schema.names:
                spans = [a + b for a, b in zip(batch.column("spans").to_pylist(), spans)]
                items = [sorted({*a, *b}) for a, b in zip(batch.column("items").to_pylist(), items)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words.counts), pa.array(spans, _SPAN), pa.array(items, pa.list_(pa.string())), batch.column("text")], ["doc_id", "n_words", "spans", "items", "text"])

    return scan


def _clean(shared, text: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, text):
            words = Words(batch.column(text).to_pylist(), "alnum")
            _, items = _found(words, shared.value)
            yield batch.filter(pa.array([k not in items for k in range(batch.num_rows)]))

    return clean


def _mark(shared, text: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the hit spans to column "spans"."""

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, text):
            words = Words(batch.column(text).to_pylist(), "alnum")
            hit, items = _found(words, shared.value)
            spans = [(own or []) + (_spans(hit[words.first[k] : words.first[k + 1]]) if k in items else []) for k, own in enumerate(batch.column("spans").to_pylist())]
            yield batch.set_column(batch.schema.get_field_index("spans"), "spans", pa.array(spans, _SPAN))

    return mark


def _cut(text: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Removes the bytes from the first to the last word of each united span."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, text):
            texts, marked = batch.column(text).to_pylist(), batch.column("spans").to_pylist()
            words = Words(texts, "alnum")
            for k, spans in enumerate(marked):
                if not spans:
                    continue
                hit = np.zeros(words.counts[k], dtype=bool)
                for span in spans:
                    hit[span["start"] : span["end"]] = True
                first, at, kept = words.first[k], words.text_start[k], []
                for span in _spans(hit):
                    kept.append(words.raw[at : words.starts[first + span["start"]]].tobytes())
                    at = words.ends[first + span["end"] - 1]
                kept.append(words.raw[at : words.text_start[k + 1] - 1].tobytes())
                texts[k] = b"".join(kept).decode("utf-8", "surrogatepass")
            at = batch.schema.get_field_index(text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return cut


def _scanned(rows: DataFrame, benchmark: DataFrame, most: int, scan: Callable, schema) -> DataFrame:
    """rows after one scan(set) for each set of at most `most` test windows of benchmark(item_id, text)."""
    spark = benchmark.sparkSession
    named = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    windows = named.mapInArrow(_windows, "item_id string, window string, width int")
    parts = max(1, -(-windows.count() // most))
    for part in range(parts):
        # Equal windows go to one part, so that each part is a whole answer for its windows.
        own = windows if parts == 1 else windows.where((F.pmod(F.xxhash64("window"), F.lit(parts)) == part))
        shared = spark.sparkContext.broadcast(WindowSet([(r.item_id, r.window) for r in own.select("item_id", "window").collect()]))
        rows = rows.mapInArrow(scan(shared), schema)
        if part < parts - 1:
            rows = settled(rows)
            shared.unpersist()
    return rows


def contamination(docs: DataFrame, benchmark: DataFrame, most: int = MAX_WINDOWS) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, n_words, spans of hit words (start, end: numbers
    of words, end exclusive; merged within a set of windows), items found (sorted)."""
    schema = "doc_id long, n_words long, spans array<struct<start: long, end: long>>, items array<string>, text string"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _scanned(rows, benchmark, most, _scan, schema).drop("text")


def decontaminated(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", most: int = MAX_WINDOWS) -> DataFrame:
    """docs without contaminated documents (remove="documents"), or without the hit words
    (remove="spans"); all columns stay."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is documents or spans, not {remove!r}")
    # Columns go by number meanwhile.
    text, rows = f"c{docs.columns.index('text')}", docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    if remove == "documents":
        return _scanned(rows, benchmark, most, lambda shared: _clean(shared, text), rows.schema).toDF(*docs.columns)
    # All sets mark their hits before anything is removed.
    marked = rows.withColumn("spans", F.lit(None).cast("array<struct<start: long, end: long>>"))
    marked = _scanned(marked, benchmark, most, lambda shared: _mark(shared, text), marked.schema)
    return marked.mapInArrow(_cut(text), marked.schema).drop("spans").toDF(*docs.columns)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    words = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["end"] - 1)))
    n_hit = F.when(F.size("spans") == 0, F.lit(0)).otherwise(F.size(F.array_distinct(words))).cast("long")
    items = F.array_join("items", ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), bs AS (
  SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM bs
), ks AS (
  SELECT DISTINCT k FROM bw
), ds AS (
  SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k
), dw AS (
  SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM ds
), h AS (
  SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(hit.n_hit, 0) AS n_hit, coalesce(items.n_items, 0) AS n_items,
       sha256(coalesce(items.names, '')) AS items_sha256, items.n_items IS NOT NULL AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""
