"""Token counts with a whole-token shortcut.

Offline, once per worker, the vocabulary is searched for the words that encode alone as one token,
and it is proved that no merge crosses the start of a word (see tokens.PieceCounts). Documents are
then counted word by word: a listed word counts one, and only the others are merged, once each as
long as a bounded table remembers them. Texts with white space other than single spaces and line
ends are counted whole.

Defined results: a null or empty text has no tokens; rows are independent, so repeated rows and
null ids are carried through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import table, text_blocks
from tidelog.llm.tokens import piece_counts

LIMIT = 4096


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = piece_counts()
    for batch in text_blocks(batches):
        n = [count(text) if text else 0 for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, n_bytes, n_tokens, over_limit."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(_count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
