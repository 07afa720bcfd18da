"""Children of parent hits come as a task makes them: pairs of queries and children are neither shuffled nor kept."""

import random

import pytest

from tests.plan_rows import _nodes
from tidelog import registry
from tidelog.operators import retrieval

SF_DIR = "/root/testdata/sf0.01"


def test_no_pair_is_shuffled(spark):
    found = registry.QUERIES["r11_expansion"](spark, SF_DIR)
    plan = found._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    sent = [node.metrics().get("shuffleRecordsWritten") for node in _nodes(plan)]
    # 25 queries with a tenth of 500 rows each, 20 direct hits a query.
    assert found.count() > 2500 and sum(c.get().value() for c in sent if c.isDefined()) <= 1000


@pytest.mark.parametrize("block", [4096, 3])
@pytest.mark.parametrize("more_parents", [False, True])
def test_expansion_equals_plain_lists(spark, monkeypatch, block, more_parents):
    draw = random.Random(3)
    # Equal parents, the same parent and the same pointer twice, direct hits under parents, children of no hit.
    pointers = [(i % 7 if not more_parents else k, f"c{i}") for i in range(200) for k in {i % 7, i * 3 % 7, i % 5}] + [(0, "c0"), (None, "c1"), (3, None)]
    parents = [(q, p, draw.choice([-0.5, 0.25, 0.123456789, 1.0])) for q in range(11) for p in draw.sample(range(9), 4)] + [(0, 0, 0.7), (0, 0, 0.1), (12, 8, 1.0)]
    direct = [(q, f"c{i}", i / 300.0) for q in range(1, 12) for i in draw.sample(range(200), 20)]
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
    monkeypatch.setattr(retrieval, "PAIRS", 50)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    found = retrieval.expanded(frame(parents, "query_id long, parent long, score double"), frame(pointers, "parent long, child string"), frame(direct, "query_id long, uri string, score double"), places=6)
    wanted = {(q, u): (round(s, 6), 0.0) for q, u, s in direct}
    for q in {x[0] for x in parents}:
        best = {}
        for _, p, s in (x for x in parents if x[0] == q):
            for _, u in (x for x in pointers if x[0] == p):
                best[u] = max(s, best.get(u, s))
        wanted |= {(q, u): (round(s * 0.8, 6), round(s, 6)) for u, s in best.items() if (q, u) not in wanted}
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(wanted) and {r[:2]: r[2:] for r in rows} == wanted


def test_no_parents_leave_the_direct_hits(spark):
    empty = spark.createDataFrame([], "query_id long, parent string, score double")
    pointers = spark.createDataFrame([("a", "c")], "parent string, child string")
    direct = spark.createDataFrame([(1, "c", 0.5)], "query_id long, uri string, score double")
    assert [tuple(r) for r in retrieval.expanded(empty, pointers, direct).collect()] == [(1, "c", 0.5, 0.0)]
