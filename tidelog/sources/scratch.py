"""Intermediate tables in a folder that the driver and all executors see."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir. Where that setting is missing, local mode takes a temporary
    folder of this machine; a cluster is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/tidelog-shared-{os.getuid()}"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


#: What this process has settled and not forgotten.
_SETTLED: list[str] = []


def forget(spark: SparkSession) -> int:
    """Deletes the tables that this process has settled so far, and tells how many. Call it when the results
    that read them are written."""
    n = len(_SETTLED)
    while _SETTLED:
        path = spark._jvm.org.apache.hadoop.fs.Path(_SETTLED.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def settled(df: DataFrame) -> DataFrame:
    """The same rows read back from a table: later steps neither compute them again nor depend on the
    executors that made them."""
    where = scratch(df.sparkSession)
    _SETTLED.append(where)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to all cores when its scan has fewer splits than there are cores, as with a small
    file of one row group; a larger table stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
