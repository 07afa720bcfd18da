"""The expansion and the whole search run over 50 weeks at any size, not over weeks of 28 vectors."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from tidelog import registry

SF_DIR = "/root/testdata/sf0.001"


def test_expansion_gives_a_fifth_of_all_rows(spark, tmp_path):
    vectors = [[float((k * 7 + d * 3) % 11 - 5) for d in range(4)] for k in range(3000)]
    pq.write_table(pa.table({"vec_id": pa.array(range(3000), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([0] * 3000, pa.int32())}), f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet')")
    wanted = con.execute(f"SELECT count(*), sum(uri), round(sum(score), 3) FROM ({registry.ORACLE_SQL['r11_expansion']})").fetchone()
    found = registry.QUERIES["r11_expansion"](spark, str(tmp_path))
    n, uris, scores = found.selectExpr("count(*)", "sum(uri)", "round(sum(score), 3)").first()
    # Ten of 50 weeks for each of 150 queries, and direct hits.
    assert n >= 150 * 600 and (n, uris) == wanted[:2] and abs(scores - wanted[2]) < 0.01


def test_search_sql_has_all_weeks():
    for name in ("r11_expansion", "r16_search"):
        assert "vec_id % 50 AS week" in registry.ORACLE_SQL[name] and "% 28" not in registry.ORACLE_SQL[name] and "// 28" not in registry.ORACLE_SQL[name]
