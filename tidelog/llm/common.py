"""What several operators of this subpackage need: reading, settled intermediate tables, batches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handed to the numpy kernels in blocks of about so many bytes; one text is never cut.
BLOCK_BYTES = 2_000_000

FOLDS = 5

#: Ids of texts to look at again are broadcast up to so many (8 bytes each); beyond, they are joined.
MOST_BROADCAST_IDS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5: the fold that a document belongs to."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see: in spark.checkpoint.dir. Where that setting
    is missing, local mode takes a temporary folder of this machine; a cluster is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/tidelog-shared-{os.getuid()}"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def settled(df: DataFrame, where: str | None = None) -> DataFrame:
    """The same rows read back from a table in the shared folder: later steps neither compute
    them again nor depend on the executors that made them."""
    spark = df.sparkSession
    where = where or shared_dir(spark)
    df.write.mode("overwrite").option("compression", "zstd").parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def text_blocks(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that the texts of each part have about BLOCK_BYTES bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // BLOCK_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """One list of counts[k] of the values for each k."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def of_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose doc_id is among ids (each id once there), with the other columns of ids. When the
    ids are few enough, their broadcast keeps all other texts out of the join's shuffle."""
    ids = settled(ids)
    if ids.count() <= MOST_BROADCAST_IDS:
        docs = docs.join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi")
    return docs.join(ids.hint("shuffle_hash"), "doc_id")


def looked_up(rows: DataFrame, few: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """rows joined with a table of one row a key. When that table is small enough it is broadcast, so
    rows of a frequent key stay where they are; beyond, adaptive execution splits such keys."""
    few = settled(few)
    return rows.join(F.broadcast(few) if few.count() <= MOST_BROADCAST_IDS else few, on, how)


def of_ids_or_null(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose doc_id is among ids, where a null among them stands for all rows without an id."""
    ids = settled(ids.distinct())
    named = ids.where("doc_id is not null")
    few = ids.count() <= MOST_BROADCAST_IDS
    found = docs.join(F.broadcast(named) if few else named.hint("shuffle_hash"), "doc_id", "left_semi")
    return found if named.count() == ids.count() else found.unionByName(docs.where("doc_id is null"))


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose doc_id is not among ids; rows without an id stay."""
    ids = settled(ids)
    few = ids.count() <= MOST_BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids.hint("shuffle_hash"), "doc_id", "left_anti")
