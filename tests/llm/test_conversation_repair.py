import hashlib
import itertools
import random
import re
import zlib

from tidelog.llm import conversation_repair as repair

SPACES = " \t\n\x0b\x0c\r"


def options(fault):
    """(letters, roles written, cost) of one row: up to two insertions, then what becomes of it."""
    inserts = [("", "", 0), *(("I", r, 5) for r in "ua"), *(("II", r + q, 10) for r in "ua" for q in "ua")]
    for letters, roles, cost in inserts:
        yield letters + "D", roles, cost + 2
        if fault not in (repair.BLANK, repair.DUPLICATE):
            more = 5 if fault == repair.CUT else 0
            yield letters + "K", roles + "k", cost + more
            for r in "ua":
                yield letters + "R", roles + r, cost + 1 + more


def brute(rows):
    """Least (cost, audit) of rows [(role initial, fault)] over all edits."""
    ends = [("", "", 0), *(("I", r, 5) for r in "ua"), *(("II", r + q, 10) for r in "ua" for q in "ua")]
    best = None
    for chosen in itertools.product(*(options(fault) for _, fault in rows), ends):
        roles = "".join(x[1].replace("k", r) for x, (r, _) in zip(chosen, [*rows, ("", 0)]))
        if re.fullmatch("(s?(ua)+)?", roles):
            best = min(best or (10**9, ""), (sum(x[2] for x in chosen), "".join(x[0] for x in chosen)))
    return best


def least(rows):
    """The same for longer conversations, back to front over (row, state)."""
    later = {0: (0, ""), 1: (10, "II"), 2: (5, "I"), 3: (0, "")}
    after = {0: 2, 1: 2, 2: 3, 3: 2}
    for role, fault in reversed(rows):
        own = {}
        for q in range(4):
            found = [(2 + later[q][0], "D" + later[q][1])]
            if fault not in (repair.BLANK, repair.DUPLICATE):
                more = 5 if fault == repair.CUT else 0
                to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((role, q))
                if to is not None:
                    found.append((more + later[to][0], "K" + later[to][1]))
                found.append((1 + more + later[after[q]][0], "R" + later[after[q]][1]))
            own[q] = min(found)
        later = {q: min(own[q], *((5 * k + own[x][0], "I" * k + own[x][1]) for k, x in ((1, after[q]), (2, after[after[q]])))) for q in range(4)}
    return later[0]


def letters(rows):
    return "".join(repair.symbol("sua".index(r) if r in "sua" else 3, f) for r, f in rows)


def test_cheapest_edits_equal_all_edits():
    rng = random.Random(2)
    for n, times in ((0, 1), (1, 40), (2, 60), (3, 12)):
        for _ in range(times):
            rows = [(rng.choice("suax"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(n)]
            cost, edits = repair.cheapest(letters(rows))
            assert (cost, "".join(edits)) == brute(rows) == least(rows)


def test_long_conversations_and_runs():
    rng = random.Random(3)
    for _ in range(300):
        rows = []
        for _ in range(rng.randint(1, 12)):
            rows += [(rng.choice("suax"), rng.choice([0, 0, 0, 1, 2, 3]))] * rng.choice([1, 1, 2, 3, 17, 64])
        cost, edits = repair.cheapest(letters(rows))
        assert (cost, "".join(edits)) == least(rows) and len(edits) == len(rows) + 1
    for symbol in ("u", "a", "s", "x"):
        cost, edits = repair.cheapest(letters([(symbol, 0)] * 100_001))
        assert len(edits) == 100_002 and cost <= 100_002


def expected(rows):
    """conv_id -> the query's row, one conversation after the other."""
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            n = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            role, text = "user" if n == 4 else role, "" if n == 1 else re.sub("[.!?]", "", text) if n == 2 else text
            kept += [(turn, role, text)] * (0 if n == 0 else 2 if n == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:32], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        seen, symbols = set(), []
        for _, role, text in kept:
            body = text.strip(SPACES)
            fault = 1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0
            seen.add((role, text))
            symbols.append((role[:1], fault))
        cost, audit = least([(r if r in ("s", "u", "a") else "x", f) for r, f in symbols])
        initials = [r for r, _ in symbols]
        bad = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = {t for t, _, _ in kept if t is not None}
        told, state, todo = [], "", list(kept)
        for edit in audit:
            if edit == "I":
                role, text = "-", ""
            else:
                _, role, text = todo.pop(0)
            if edit == "D":
                continue
            if edit in "IR":
                role = "assistant" if state == "u" else "user"
            state = role[0]
            told.append(f"{role}:{text}")
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *([f for _, f in symbols].count(k) for k in (1, 2, 3)), bad, cost, audit, hashlib.sha256("\n".join(told).encode()).hexdigest())
    return out


def conversations(seed=5):
    rng = random.Random(seed)
    texts = ["Hello there.", "Well?", "cut off in the", "", " \n", None, "Yes!", "a.b", "ä. \t", "x" * 3000 + "."]
    rows = [(conv, turn, rng.choice(["user", "assistant", "assistant", "system", "tool", "User", "", None, "user"]), rng.choice(texts)) for conv in [*range(60), None] for turn in range(rng.randint(1, 9))]
    rows += [(70, t, ("user", "assistant")[t % 2], f"turn {t % 40}.") for t in range(600)]
    rows += [(71, None, "user", "the same."), (71, None, "user", "the same."), (71, 5, "user", "the same."), (72, 3, "system", "one."), (72, 3, "system", "two."), (72, 9, "user", "z.")]
    rows += [(80 + k, t, "user", "q.") for k in range(40) for t in range(1)]
    return rows


def found(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def frame(spark, rows):
    """conversations with columns whose names clash with those used inside."""
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, digest string, number int, place int")


def test_query_equals_brute_force(spark, tmp_path):
    rows = conversations()
    frame(spark, rows).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    assert found(repair.op12_conversation_repair(spark, str(tmp_path))) == expected(rows)


def test_large_conversations_give_the_same(spark, monkeypatch):
    rows = conversations(6)
    docs = repair.damaged(frame(spark, rows))
    whole = {k: v for k, v in expected(rows).items() if k in found(repair.digests(repair.repair(docs)))}
    monkeypatch.setattr(repair, "BLOCK_ROWS", 7)
    in_blocks = repair.repair(docs, most_rows=4)
    assert in_blocks.large is not None and in_blocks.large.count() > 20
    assert found(repair.digests(in_blocks)) == whole
    assert found(repair.digests(repair.repair(docs, most_bytes=0))) == whole


def test_empty_table(spark):
    assert repair.digests(repair.repair(repair.damaged(frame(spark, [])))).count() == 0
