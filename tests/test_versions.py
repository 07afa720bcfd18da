from tidelog.sources.versions import VersionedTable
from tidelog.streaming import jobs

COLUMNS = "uri string, text string, at int"


def found(table):
    return sorted(((r.uri, r.text) for r in table.read().collect()), key=str)


def rows(spark, *values, deleted=False):
    df = spark.createDataFrame(list(values), COLUMNS)
    return df.selectExpr("*", "true AS deleted") if deleted else df


def test_newest_rows_whatever_is_written_again(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), COLUMNS, "uri", "at")
    assert found(table) == []
    table.write(rows(spark, ("a", "1", 1), ("b", "1", 1), ("b", "2", 2), (None, "n", 1)), 0)
    table.write(rows(spark, ("a", "3", 0), ("c", "1", 1)), 1)
    wanted = [("a", "3"), ("b", "2"), ("c", "1"), (None, "n")]
    assert found(table) == wanted
    table.write(rows(spark, ("a", "3", 0), ("c", "1", 1)), 1)
    assert found(table) == wanted
    # An older batch that is run again stays older.
    table.write(rows(spark, ("a", "1", 1), ("b", "1", 1), ("b", "2", 2), (None, "n", 1)), 0)
    assert found(table) == wanted
    table.write(rows(spark, ("b", "", 9), deleted=True), 2)
    assert found(table) == [("a", "3"), ("c", "1"), (None, "n")]
    table.write(rows(spark, ("b", "back", 1)), 3)
    assert ("b", "back") in found(VersionedTable(spark, str(tmp_path / "t"), COLUMNS, "uri", "at"))


def test_compaction_and_half_written_folders(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), COLUMNS, "uri")
    for k in range(4):
        table.write(rows(spark, (f"u{k}", str(k), k), ("same", str(k), k)), k)
    before = found(table)
    table.compact(2)
    assert table.base == 3 and found(table) == before
    table.clean()
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if "=" in p.name) == ["base=3"] and found(table) == before
    table.write(rows(spark, ("same", "old", 0)), 2)
    assert found(table) == before
    # A writer that died has left no mark of success.
    rows(spark, ("same", "lost", 9)).selectExpr("*", "false AS deleted").write.parquet(str(tmp_path / "t" / "batch=7"))
    (tmp_path / "t" / "batch=7" / "_SUCCESS").unlink()
    assert found(table) == before
    table.write(rows(spark, ("same", "new", 9)), 7)
    assert ("same", "new") in found(table)


def test_a_restarted_stream_finds_its_state(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for turn, text in enumerate(["first", "second"]):
        for k in range(3 - turn):
            (tmp_path / "in" / f"note{k}-{turn}.md").write_text(f"n{k}\n{text}")
        table = VersionedTable(spark, str(tmp_path / "t"), "uri string, text string, modified timestamp", "uri", "modified")

        def upsert(batch, batch_id, table=table):
            own = batch.selectExpr("substring_index(text, '\n', 1) AS uri", "substring_index(text, '\n', -1) AS text", "modified")
            table.write(own, batch_id)
            table.write(own, batch_id)

        jobs.watched_notes(spark, str(tmp_path / "in"), upsert, str(tmp_path / "checkpoint"), once=True).awaitTermination()
    assert found(table) == [("n0", "second"), ("n1", "second"), ("n2", "first")]
