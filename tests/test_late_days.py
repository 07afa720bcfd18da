"""Queries against their SQL where the notes' days lie far ahead, as in large tables."""

import duckdb
import pytest

from tidelog import registry


@pytest.mark.parametrize("name", ["a10_completions", "w3_applied_ops"])
def test_late_days_equal_sql(spark, tmp_path, name):
    ids = [*range(0, 40), *range(2180, 2210), *range(27380, 27450)]
    spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    answer = con.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in answer.description]
    found = registry.QUERIES[name](spark, str(tmp_path))
    assert sorted(str(tuple(r[c] for c in columns)) for r in found.collect()) == sorted(map(str, answer.fetchall()))


def test_timeline_takes_notes_of_all_numbers(spark, tmp_path):
    spark.createDataFrame([(i, f"text {i}") for i in range(900, 1000)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, "q") for i in range(4)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = registry.QUERIES["r27_timeline"](spark, str(tmp_path))
    assert {r.query_id for r in found.collect()} == {0, 1, 2, 3}
