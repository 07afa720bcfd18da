import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.operators import retrieval, vectors

C = F.col


def clustered(n=3000, groups=60, size=16, seed=2):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, size))
    x = centre[rng.integers(0, groups, n)] + 0.35 * rng.normal(size=(n, size))
    return [(k, (v / np.linalg.norm(v)).tolist()) for k, v in enumerate(x)]


def frames(spark, rows, every=20):
    corpus = spark.createDataFrame(rows, "uri long, vector array<double>").repartition(4)
    return corpus, corpus.where(C("uri") % every == 0).select(C("uri").alias("query_id"), "vector")


def test_recall_of_every_row_against_the_exact_search(spark):
    corpus, queries = frames(spark, clustered())
    exact = retrieval.nearest(queries, corpus, 10)
    index = vectors.vector_index(corpus).tuned(queries, corpus, 10)
    assert index.rows.count() == 3000 and index.probes < len(index.centre) / 2
    assert index.recall(queries, exact, 10) >= 0.9
    every = {(r.query_id, r.uri): r.score for r in vectors.approximate(queries, corpus, 10).collect()}
    wanted = {(r.query_id, r.uri): r.score for r in exact.collect()}
    assert all(score == pytest.approx(wanted[pair]) for pair, score in every.items() if pair in wanted)


def test_all_cells_are_exact_whatever_the_tiles(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PART_ROWS", 50)
    monkeypatch.setattr(vectors, "QUERY_ROWS", 7)
    rows = clustered(900)
    rows += [(10_000 + k, rows[0][1]) for k in range(300)]
    corpus, queries = frames(spark, rows)
    index = vectors.vector_index(corpus, probes=1000)
    assert max(index.parts.values()) > 5
    found, exact = (sorted((r.query_id, round(r.score, 9)) for r in x.collect()) for x in (index.search(queries, 5), retrieval.nearest(queries, corpus, 5)))
    assert found == exact


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [1.0]), (None, [0.0, 1.0]), (4, [0.0, 0.0]), (5, [0.5, 0.5]), (6, [1.0, None])]
    corpus = spark.createDataFrame(rows, "uri long, vector array<double>")
    queries = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [1.0])], "query_id string, vector array<double>")
    assert sorted((r.query_id, r.uri, r.score) for r in vectors.vector_index(corpus, probes=9).search(queries, 2).collect()) == [("a", 1, 1.0), ("a", 5, 0.5)]
    assert vectors.vector_index(corpus.where("false")).search(queries, 2).count() == 0


def test_recall_on_the_given_vectors(spark):
    from tidelog.plans import rollup_queries, search_queries

    folder = "/root/testdata/sf0.01"
    wanted = {(r.query_id, r.uri) for r in rollup_queries.r1_nearest(spark, folder).collect()}
    found = {(r.query_id, r.uri) for r in search_queries.r1_approximate(spark, folder).collect()}
    assert len(found & wanted) >= 0.9 * len(wanted)


def test_exact_search_holds_tiles_not_all_scores():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    queries, rows = rng.normal(size=(4096, 8)), rng.normal(size=(10_000, 8)).round(1)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), pa.array(list(rows), pa.list_(pa.float64()))], ["uri", "vector"])
    tracemalloc.start()
    (found,) = retrieval.best_rows([batch], list(range(4096)), queries, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # All scores of the batch would be 328 MB.
    assert peak < 80e6
    got = found.to_pandas()
    for q in (0, 700, 4095):
        score = np.add.accumulate(rows * queries[q], axis=1)[:, -1]
        assert got[got.query_id == q].uri.tolist() == sorted(range(10_000), key=lambda i: (-score[i], i))[:5]
