"""A table of newest rows by key that only ever gains folders, so that a batch can be written again.

Each batch is a folder named by its id; writing a batch again replaces its own folder with the same rows.
Reading takes the newest base and the batches after it, and of each key the row of the latest batch (within a
batch rows are reduced first). Compaction writes a new base, bucketed by key, from what reading gives.
A folder counts when its writer has committed it, so a writer that dies leaves nothing to be seen, and
state is found from the folder alone: a restarted stream needs nothing else.

Defined results: rows with a null key are one key; a row whose `deleted` is true hides its key until a
later batch brings it again; of rows of one key in one batch the largest by `order` counts; batches may come
in any order of time, but a batch that a base already holds is not written again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col


class VersionedTable:
    """The table in a folder of the shared file system; rows have the key and `columns`, a DDL string."""

    def __init__(self, spark: SparkSession, folder: str, columns: str, key: str, order: str | None = None):
        self.spark, self.folder, self.columns, self.key, self.order = spark, folder.rstrip("/"), columns, key, order
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda name="": hadoop(f"{self.folder}/{name}" if name else self.folder)
        self._files = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def _committed(self, kind: str) -> list[int]:
        """Ids of the committed folders of a kind, in order."""
        if not self._files.exists(self._path()):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._path())]
        return sorted(int(n.partition("=")[2]) for n in names if n.startswith(kind + "=") and self._files.exists(self._path(n + "/_SUCCESS")))

    @property
    def base(self) -> int:
        """The last batch that the newest base holds; -1 without a base."""
        return max(self._committed("base"), default=-1)

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """The rows of a batch: an upsert(batch, batch_id) for a stream."""
        if batch_id <= self.base:
            return
        rows = batch if "deleted" in batch.columns else batch.withColumn("deleted", F.lit(False))
        rest = [c for c in rows.columns if c != self.key]
        by = F.struct(*([self.order] if self.order else []), *(c for c in rest if c != self.order))
        newest = rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), by).alias("x")).select(self.key, "x.*")
        newest.write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")

    def _versions(self) -> DataFrame:
        base, schema = self.base, f"{self.columns}, deleted boolean"
        held = [("base", base)] * (base >= 0) + [("batch", b) for b in self._committed("batch") if b > base]
        parts = [self.spark.read.schema(schema).parquet(f"{self.folder}/{kind}={k}").withColumn("_batch", F.lit(k).cast("long")) for kind, k in held]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"{schema}, _batch long")

    def read(self) -> DataFrame:
        """The newest row of each key."""
        every = self._versions()
        rest = [c for c in every.columns if c not in (self.key, "_batch")]
        newest = every.groupBy(self.key).agg(F.max_by(F.struct(*rest), "_batch").alias("x")).select(self.key, "x.*")
        return newest.where("NOT deleted").drop("deleted")

    def compact(self, files: int | None = None) -> None:
        """Writes a base of all committed batches. Readers see the old folders until it is there."""
        last = max(self._committed("batch"), default=-1)
        if last > self.base:
            rows = self.read().withColumn("deleted", F.lit(False))
            rows = rows.repartition(self.key) if files is None else rows.repartition(files, self.key)
            rows.sortWithinPartitions(self.key).write.mode("overwrite").parquet(f"{self.folder}/base={last}")

    def clean(self) -> None:
        """Deletes the batches and bases that the newest base replaces, when no reader of theirs is left."""
        base = self.base
        for kind, upto in (("batch", base), ("base", base - 1)):
            for k in self._committed(kind):
                if k <= upto:
                    self._files.delete(self._path(f"{kind}={k}"), True)
