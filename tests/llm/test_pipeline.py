"""The pipeline's stages on the smallest tables against brute force, and the SQL of the operators."""

import re
import zlib
from array import array

import duckdb
import pytest

import corpus_pipeline
from tests.llm.helpers import ALNUM, LOWER, TEXTS, frame, links, numbered
from tidelog.llm import registry, toxicity
from tidelog.llm.common import settled, table
from tidelog.llm.tokens import byte_bpe

SF_DIR = "/root/testdata/sf0.001"


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages(spark):
    docs = table(spark, SF_DIR, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, columns = docs, docs.columns
        docs = settled(stage(spark, docs, SF_DIR))
        if name != "packing":
            assert docs.columns == columns
            kept[name] = (texts(before), texts(docs))

    before, after = kept["toxicity"]
    source = table(spark, SF_DIR, "documents")
    scores = {r.doc_id: r.score for r in toxicity.scored(source, toxicity.train(source, table(spark, SF_DIR, "labels"), ~toxicity.held_out())).collect()}
    assert set(after) == {i for i in before if scores[i] < 0.5}

    before, after = kept["exact_dedup"]
    first = {}
    for i in sorted(before):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before[i]), i)
    assert set(after) == set(first.values())

    before, after = kept["ngram_join"]
    assert set(after) == {c for _, c in links(list(before.items())).values()}

    before, after = kept["decontamination"]
    windows = set()
    for r in table(spark, SF_DIR, "benchmark").collect():
        w = ALNUM.findall(r.text.translate(LOWER))
        windows |= {tuple(w[k : k + 10]) for k in range(max(len(w) - 9, 1))}
    widths = {len(w) for w in windows}
    clean = {i for i, t in before.items() if not any(tuple(w[k : k + n]) in windows for w in [ALNUM.findall(t.translate(LOWER))] for n in widths for k in range(len(w) - n + 1))}
    assert set(after) == clean

    bpe, pieces = byte_bpe(), {}
    for r in docs.collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == clean
    for i, own in pieces.items():
        ids = array("I", bpe.whole.encode(after[i], add_special_tokens=False).ids + [1])
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    answer = con.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in answer.description]
    found = registry.QUERIES[name](spark, SF_DIR)
    assert sorted(found.columns) == sorted(columns)
    assert sorted(tuple(r[c] for c in columns) for r in found.collect()) == sorted(answer.fetchall())


def test_stages_on_odd_rows(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([*((i, 1, int(i == 13)) for i in range(1, 15)), (1, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, numbered("q", 9)), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for rows in (TEXTS, []):
        docs = frame(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            after = settled(stage(spark, docs, folder))
            if name != "packing":
                assert after.columns == docs.columns and after.count() <= docs.count()
                docs = after
        kept = {r.doc_id for r in docs.collect()}
        if not rows:
            assert not kept and after.count() == 0
        else:
            # The first of equal and of similar texts stays, a text with a benchmark passage (13) goes.
            assert kept == {1, 3, 5, 6, 7, 9, 10, 11, 14, None}
            assert {r.doc_id for r in after.collect()} == kept
