"""Every registered query of the library against its DuckDB SQL on the smallest tables."""

import math

import duckdb
import pytest

from tidelog import registry

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return f"{x:.6f}"
    return str(x)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    found = registry.QUERIES[name](spark, SF_DIR)
    answer = con.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in answer.description]
    assert sorted(found.columns) == sorted(columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in found.collect())
    theirs = sorted(tuple(plain(x) for x in r) for r in answer.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF_DIR).count() > 0


def test_every_sql_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
