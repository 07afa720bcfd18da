"""Approximate nearest vectors by an inverted file: k-means cells, and only the cells near a query.

Cells are fitted on a sample of at most SAMPLE vectors by their directions; every vector is then assigned to
its cell and written once, by cell. A search gives each query to its nearest cells and meets the cells'
vectors there: cells of more than PART_ROWS vectors and cells that more than QUERY_ROWS queries ask
for are cut into parts, so a tile of vectors and queries is bounded whatever a cell holds. A tile is
one matrix product and gives k rows a query. The number of cells asked for is tuned on a sample of
queries against the exact search until the wanted recall is reached.

Defined results: rows whose uri or vector is null, or whose vector has another length than most of the
sample, are left out; equal vectors are each a hit of their own; queries without a fitting vector have
no hits; an empty corpus has none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import retrieval
from tidelog.sources.scratch import settled

C = F.col

#: Vectors that the cells are fitted on, at most; rounds of k-means; cells, at most.
SAMPLE = 65_536
ROUNDS = 8
MOST_CELLS = 4096

#: Vectors and queries of a tile.
PART_ROWS = 16_384
QUERY_ROWS = 4096

#: Queries that the number of probed cells is tuned on, and the recall that is wanted on them.
TUNED_ON = 200
RECALL = 0.95


def _matrix(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float64).reshape(n, -1)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def fitted_cells(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Directions of so many cells, by k-means on the unit vectors of a sample. A cell that gets
    nothing keeps its direction."""
    sample = _unit(sample)
    centre = sample[np.random.default_rng(5).permutation(len(sample))[:cells]]
    for _ in range(rounds):
        own = np.argmax(sample @ centre.T, axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, own, sample)
        held = np.bincount(own, minlength=len(centre)) > 0
        centre[held] = _unit(sums[held])
    return centre


def _sampled(rows: DataFrame, key: str, n: int, most: int) -> DataFrame:
    """About half of `most` rows, and never more, spread by a hash of the key."""
    share = min(1.0, most / 2 / max(1, n))
    return (rows if share == 1.0 else rows.where(F.pmod(F.xxhash64(C(key).cast("string")), F.lit(1 << 30)) < int(share * (1 << 30)))).limit(most)


@dataclass(frozen=True)
class VectorIndex:
    """rows(cell, part, uri, vector), the cells' directions, the parts of each cell, cells to probe."""

    rows: DataFrame
    centre: np.ndarray
    parts: dict[int, int]
    probes: int

    @property
    def spark(self) -> SparkSession:
        return self.rows.sparkSession

    def probed(self, queries: DataFrame) -> DataFrame:
        """query_id, vector and cell: each query with its nearest cells."""
        shared, probes, size = self.spark.sparkContext.broadcast(self.centre), min(self.probes, len(self.centre)), self.centre.shape[1]

        def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    near = np.argsort(-(_matrix(batch.column("vector"), batch.num_rows) @ shared.value.T), axis=1, kind="stable")[:, :probes]
                    at = pa.array(np.repeat(np.arange(batch.num_rows), probes))
                    yield pa.RecordBatch.from_arrays([batch.column("query_id").take(at), batch.column("vector").take(at), pa.array(near.ravel().astype(np.int32))], ["query_id", "vector", "cell"])

        kind = dict(queries.dtypes)["query_id"]
        fitting = queries.where(F.size("vector") == size).select("query_id", C("vector").cast("array<double>").alias("vector"))
        return fitting.mapInArrow(probe, f"query_id {kind}, vector array<double>, cell int")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, uri, score: the k best of queries(query_id, vector) among the vectors of their cells."""
        kinds = dict(queries.dtypes) | dict(self.rows.dtypes)
        schema = f"query_id {kinds['query_id']}, uri {kinds['uri']}, score double"
        if not self.parts:
            return self.spark.createDataFrame([], schema)
        asked = settled(self.probed(queries))
        blocks = {r.cell: -(-r.n // QUERY_ROWS) for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        cells = self.spark.createDataFrame([(c, self.parts.get(c, 0), n) for c, n in blocks.items()], "cell int, parts int, blocks int")
        cells = F.broadcast(cells.where("parts > 0"))
        count = lambda n: F.explode(F.sequence(F.lit(0), C(n) - 1))
        held = self.rows.join(cells, "cell").select("cell", "part", count("blocks").alias("block"), "uri", "vector")
        block = F.pmod(F.xxhash64("query_id"), C("blocks")).cast("int")
        met = asked.join(cells, "cell").select("cell", count("parts").alias("part"), block.alias("block"), "query_id", "vector")
        tile = ["cell", "part", "block"]

        def best(corpus: pa.Table, asking: pa.Table) -> pa.Table:
            n, m = corpus.num_rows, asking.num_rows
            if not n or not m:
                return pa.table({"query_id": asking["query_id"].slice(0, 0), "uri": corpus["uri"].slice(0, 0), "score": pa.array([], pa.float64())})
            scores = _matrix(asking["vector"], m) @ _matrix(corpus["vector"], n).T
            most = min(k, n)
            near = np.argpartition(-scores, most - 1, axis=1)[:, :most]
            who = np.repeat(np.arange(m), most)
            return pa.table({"query_id": asking["query_id"].take(pa.array(who)), "uri": corpus["uri"].take(pa.array(near.ravel())), "score": pa.array(scores[who, near.ravel()])})

        found = held.groupBy(*tile).cogroup(met.groupBy(*tile)).applyInArrow(best, schema)
        return retrieval.top(found, k, C("score").desc(), C("uri"))

    def recall(self, queries: DataFrame, exact: DataFrame, k: int) -> float:
        """Share of the exact hits(query_id, uri) that the index finds too."""
        n = exact.count()
        return exact.join(self.search(queries, k), ["query_id", "uri"], "left_semi").count() / n if n else 1.0

    def tuned(self, queries: DataFrame, corpus: DataFrame, k: int, recall: float = RECALL) -> VectorIndex:
        """The index with as many probes, in doublings, as give that recall on at most TUNED_ON queries. With all
        cells the search is exact, so this ends."""
        some = settled(_sampled(queries, "query_id", queries.count(), TUNED_ON))
        exact = settled(retrieval.nearest(some, corpus, k).select("query_id", "uri"))
        index = self
        while index.probes < len(self.centre) and index.recall(some, exact, k) < recall:
            index = replace(index, probes=min(2 * index.probes, len(self.centre)))
        return index


def vector_index(corpus: DataFrame, probes: int = 4, cells: int | None = None) -> VectorIndex:
    """An index of corpus(uri, vector). The number of cells grows with the square root of its rows."""
    spark, rows = corpus.sparkSession, corpus.select("uri", C("vector").cast("array<double>").alias("vector")).where("uri IS NOT NULL AND size(vector) > 0")
    n = rows.count()
    found = [r.vector for r in _sampled(rows, "uri", n, SAMPLE).select("vector").collect()]
    sizes = [len(v) for v in found]
    size = max(set(sizes), key=lambda x: (sizes.count(x), -x)) if sizes else 0
    sample = np.array([v for v in found if len(v) == size and None not in v], dtype=np.float64).reshape(-1, max(1, size))
    centre = fitted_cells(sample, min(MOST_CELLS, cells or max(1, round(n**0.5)))) if len(sample) else np.zeros((1, 1))
    shared = spark.sparkContext.broadcast(centre)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = np.argmax(_unit(_matrix(batch.column("vector"), batch.num_rows)) @ shared.value.T, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *batch.columns], ["cell", *batch.schema.names])

    fitting = rows.where((F.size("vector") == size) & ~F.exists("vector", lambda x: x.isNull()))
    assigned = settled(fitting.mapInArrow(assign, f"cell int, uri {dict(corpus.dtypes)['uri']}, vector array<double>"))
    parts = {r.cell: -(-r.n // PART_ROWS) for r in assigned.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    of_cell = F.broadcast(spark.createDataFrame(list(parts.items()), "cell int, parts int"))
    placed = assigned.join(of_cell, "cell").select("cell", F.pmod(F.xxhash64("uri"), C("parts")).cast("int").alias("part"), "uri", "vector")
    return VectorIndex(settled(placed.repartition("cell", "part").sortWithinPartitions("cell", "part")), centre, parts, probes)


def approximate(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """As retrieval.nearest, with RECALL of its hits on the queries that the index was tuned on: a search
    for branches()."""
    corpus = settled(corpus.select("uri", "vector"))
    return vector_index(corpus).tuned(queries, corpus, k).search(queries, k)
