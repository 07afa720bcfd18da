"""Stop words are looked up in sets, and each row's words are made once."""

import re

from pyspark.sql import functions as F

from tidelog.functions import text
from tidelog.operators import evals

C = F.col
TEXTS = ("The cat's en-route: to be, x y2 ab abc --a' it's ÄB the-end", "of and the", "", "Ab abc ABC a-b-c 'quoted' 2fast", None)


def test_words_are_those_of_the_plain_filter(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k int, t string")
    found = rows.select("k", text.passage_words(C("t")).alias("every"), text.distinct_passage_words(C("t")).alias("once")).collect()
    for r in found:
        t = TEXTS[r.k]
        wanted = None if t is None else [w for w in re.findall("[a-z][a-z'-]+", t.lower()) if len(w) > 2 and w not in text.QUERY_STOP_WORDS]
        assert r.every == wanted
        assert r.once == (None if wanted is None else list(dict.fromkeys(wanted)))


def test_digits_are_seen_before_borders(spark):
    t = "a5x 5x 12.5x 3.4% x1% 7:30 17:305 2024-01-02 2024-01-023 é5x $5M 1.5x."
    (row,) = spark.createDataFrame([(t,)], "t string").select(text.signatures(C("t")).alias("s")).collect()
    wanted = [(k, v) for k, p in text.SIGNATURES.items() for v in re.findall(p, t, re.ASCII)]
    assert [(s.kind, s.value) for s in row.s] == wanted and len(wanted) > 6


def test_no_stop_word_is_compared_word_by_word(spark):
    pairs = spark.createDataFrame([(1, "Did Jordan Miles go?", "the cat sat on 3.5%", [1]), (2, "what?", "zzqx wwqx", [1]), (3, "what?", "of the", [1, 9]), (4, "", "cat", [])], "qa_id int, question string, answer string, relevant_days array<int>")
    days = spark.createDataFrame([(1, "A cat, and 3.5% more. Jordan Miles")], "day_number int, text string")
    found = evals.audit(pairs, days, "2024-01-01")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains" not in plan and plan.count("array_except") == 2
    assert {r.qa_id: r.codes for r in found.collect()} == {1: [], 2: ["no common word"], 3: ["missing day"], 4: ["empty days"]}
    for words in (text.query_keywords, text.signal_keywords, text.anchor_words):
        assert "array_contains" not in pairs.select(words(C("answer")))._jdf.queryExecution().optimizedPlan().toString()
