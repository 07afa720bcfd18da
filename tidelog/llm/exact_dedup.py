"""Exact dedup by content sort.

Sampled splitters range-partition the normalised texts, each task sorts its range (Spark's
external sort, which spills), equal texts become neighbours, and one pass over the sorted rows
compares each text with the one before it in full. The splitters look at the first characters, a
hash, the id and, for ties of these, a seeded number: they stay small, and a text that a third of all rows share is spread over as
many tasks as it needs. A run of equal texts that crosses a border between two tasks shows up as
their last and first run; those few (two a task at most) are put together by their digest.

Defined results: a null text counts as empty; a row with a null doc_id sorts after all ids and
stays only when no equal text has an id; of repeated rows (same id, same text) exactly one stays; a
very long text is one row, of which the splitters see the begin and a hash; an empty table gives an
empty result; other columns are not looked at, and may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import settled, table

#: Characters of a text that the splitters see.
SPLITTER_CHARS = 32

_GROUPS = "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string, border_task long"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _segments(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch] | None]:
    """(text, rows of this text) for each stretch of neighbours whose texts are equal in full; a
    stretch ends with its batch, so a run may take several. None comes after each batch."""
    for batch in batches:
        n = batch.num_rows
        if n:
            text = batch.column("normal")
            changes = np.flatnonzero(pc.not_equal(text.slice(1), text.slice(0, n - 1)).to_numpy(zero_copy_only=False)) + 1
            for a, b in zip([0, *changes.tolist()], [*changes.tolist(), n]):
                yield text[a].as_py(), batch.slice(a, b - a)
        yield None


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows become rows that tell their run of equal texts. Of a run in progress only ids are held."""
    task = TaskContext.get().partitionId()
    ids: list[pa.Array] = []
    text, parts, runs, n_closed = None, [], [], 0

    def close() -> None:
        nonlocal ids, n_closed
        head, size = ids[0][0].as_py(), sum(map(len, ids))
        runs.append((size, head, hashlib.sha256(text.encode()).hexdigest(), task if n_closed == 0 else None))
        parts.extend(ids)
        ids, n_closed = [], n_closed + 1

    def flush() -> pa.RecordBatch:
        sizes = np.array([r[0] for r in runs])
        of = np.repeat(np.arange(len(runs)), sizes)
        kept = np.zeros(len(of), dtype=bool)
        kept[np.cumsum(sizes) - sizes] = True
        told = [pa.array([r[k] for r in runs], kind).take(pa.array(of)) for k, kind in ((1, pa.int64()), (2, pa.string()), (3, pa.int64()))]
        out = pa.RecordBatch.from_arrays([pa.concat_arrays(parts), told[0], pa.array(sizes[of]), pa.array(kept), told[1], told[2]], ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "border_task"])
        parts.clear()
        runs.clear()
        return out

    for segment in _segments(batches):
        if segment is None:
            if runs:
                yield flush()
            continue
        if ids and segment[0] != text:
            close()
        text = segment[0]
        ids.append(segment[1].column("doc_id"))
    if ids:
        close()
        runs[-1] = (*runs[-1][:3], task)
        yield flush()


def _heads(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each run of equal texts, whole, without "normal"; the first and the last run
    of the task are marked as touching a border, with their digest."""
    task = TaskContext.get().partitionId()
    text, held, first = None, None, True

    def told(row: pa.RecordBatch, border: bool) -> pa.RecordBatch:
        digest = hashlib.sha256(text.encode()).hexdigest() if border else None
        names = [x for x in row.schema.names if x != "normal"]
        return pa.RecordBatch.from_arrays([*(row.column(x) for x in names), pa.array([digest], pa.string()), pa.array([task if border else None], pa.int64())], [*names, "_digest", "_border"])

    for segment in _segments(batches):
        if segment is None or segment[0] == text:
            continue
        if held is not None:
            yield told(held, first)
            first = False
        text, held = segment[0], segment[1].slice(0, 1)
    if held is not None:
        yield told(held, True)


def _content_sorted(docs: DataFrame, *carried: str) -> DataFrame:
    """Rows in content order: equal texts are neighbours, of these the smallest id comes first."""
    normal = F.col("normal")
    order = [F.substring(normal, 1, SPLITTER_CHARS), F.col("_hash")]
    # Rows that are equal in text and id, or have no id, are told apart by a seeded number of their own.
    told = docs.withColumns({"_hash": F.xxhash64("normal"), "_tie": F.rand(5)})
    ranged = told.repartitionByRange(*order, F.col("doc_id").asc_nulls_last(), "_tie")
    return ranged.sortWithinPartitions(*order, normal, F.col("doc_id").asc_nulls_last()).select(*carried, "normal")


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("normal"))
    runs = settled(_content_sorted(rows, "doc_id").mapInArrow(_groups, _GROUPS))
    # Two runs a task at most touch a border, so this table has two rows a task at most.
    order = F.struct(F.col("keep_id").isNull(), "keep_id", "border_task")
    border = runs.where("border_task is not null and kept").groupBy("text_sha256").agg(F.min_by("keep_id", order).alias("all_keep"), F.min_by("border_task", order).alias("keep_task"), F.sum("group_size").alias("all_size"))
    inner = runs.where("border_task is null").drop("border_task")
    outer = runs.where("border_task is not null").join(F.broadcast(border), "text_sha256")
    kept = F.col("kept") & (F.col("border_task") == F.col("keep_task"))
    return inner.unionByName(outer.select("doc_id", F.col("all_keep").alias("keep_id"), F.col("all_size").alias("group_size"), kept.alias("kept"), "text_sha256"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: of equal texts the smallest id."""
    # Columns go by number meanwhile, so that no name clashes.
    names = [f"c{k}" for k in range(len(docs.columns))]
    rows = docs.toDF(*names).withColumn("doc_id", F.col(names[docs.columns.index("doc_id")]).cast("long")).withColumn("normal", normalised(F.col(names[docs.columns.index("text")])))
    schema = ", ".join([*(f"{name} {f.dataType.simpleString()}" for name, f in zip(names, docs.schema)), "doc_id long, _digest string, _border long"])
    heads = settled(_content_sorted(rows, *names, "doc_id").mapInArrow(_heads, schema))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_border")
    winner = heads.where("_border is not null").groupBy("_digest").agg(F.min_by("_border", order).alias("_border"))
    inner = heads.where("_border is null").select(*names)
    return inner.unionByName(heads.join(F.broadcast(winner), ["_digest", "_border"]).select(*names)).toDF(*docs.columns)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS normal FROM documents
), g AS (
  SELECT normal, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY normal
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.normal) AS text_sha256
FROM n JOIN g ON n.normal = g.normal
"""
