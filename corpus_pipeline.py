"""A training corpus from raw documents, in five stages that each call an operator of tidelog.llm.

  toxicity              documents that the model rejects go
  exact_dedup           of equal texts the smallest id stays
  ngram_join            of each group of near copies the smallest id stays
  decontamination       documents with passages of the benchmark go
  packing               the rest becomes sequences of at most 2048 tokens

Defined results: null and empty texts are equal to each other, not toxic without evidence, near to nothing and clean; the
first of them stays and is packed as its end token. Of repeated rows one stays. A row without an id comes after all ids and
stays only where no equal or similar text has one. Other columns, whatever their names, are carried along to the packing,
which doesn't read them. An empty table gives no rows at each stage; without labels nothing is toxic.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of documents. ORACLE_SQL is None: SQL can express neither the trained toxicity
model nor packing; the tests compare the stages with brute force instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import decontamination, exact_dedup, ngram_join, packing, toxicity
from tidelog.llm.common import settled, shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    return toxicity.without_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.near_dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"), remove="documents")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what each one keeps is written as Parquet and reread."""
    docs, folder = table(spark, sf_dir, "documents"), shared_dir(spark)
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return docs
