import collections
import hashlib
import math
import random
import re
import zlib
from array import array

import numpy as np
import pytest

from tests.llm.helpers import ALNUM, LOWER, TEXTS, WORD, counted, frame, links, numbered, repeated_words
from tidelog.llm import decontamination, exact_dedup, language_id, lm_scoring, ngram_join, packing, pii, substring_dedup, token_counts, toxicity
from tidelog.llm.components import components
from tidelog.llm.textkernels import Words, sliding_min
from tidelog.llm.tokens import byte_bpe, piece_counts

EMPTY = []


def rows(df):
    return [r.asDict() for r in df.collect()]


# --- kernels


@pytest.mark.parametrize("kind, pattern, lower", [("exact", WORD, False), ("lower", WORD, True), ("alnum", ALNUM, True)])
def test_words_are_cut_as_the_pattern_says(kind, pattern, lower):
    texts = [t for _, t in TEXTS]
    words = Words(texts, kind)
    for k, t in enumerate(texts):
        expected = pattern.findall((t or "").translate(LOWER) if lower else t or "")
        own = [words.word(i).decode() for i in range(words.first[k], words.first[k + 1])]
        assert ([w.translate(LOWER) for w in own] if lower else own) == expected


def test_equal_windows_have_equal_hashes_and_others_do_not():
    words = Words([numbered("w", 40), numbered("w", 40).upper(), numbered("w", 39) + " other"], "lower")
    h = words.window_hashes(10)
    assert (h[:31] == h[40:71]).all() and h[30] != h[110] and len(np.unique(h[:31])) == 31
    assert words.valid(10)[:31].all() and not words.valid(10)[31:40].any()


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 1000, 200)
    for width in (1, 2, 3, 7, 43):
        assert (sliding_min(x, width) == [x[i : i + width].min() for i in range(len(x) - width + 1)]).all()


# --- 1 language id


def test_language_id_on_held_out_texts(spark):
    rng = random.Random(4)
    vocabulary = {"aa": "kal mor tin sev dul pra".split(), "bb": "ösch ung keit berg lich äm".split()}
    data = [(k, " ".join(rng.choice(vocabulary[lang]) + rng.choice(vocabulary[lang]) for _ in range(rng.randint(5, 600))), lang) for k in range(300) for lang in [("aa", "bb")[k % 2]]]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    sample = language_id.labelled_sample(docs, docs.doc_id < 200)
    found = {r["doc_id"]: r for r in rows(language_id.languages(docs, sample))}
    assert sum(found[i]["lang_pred"] == lang for i, _, lang in data if i >= 200) >= 99
    assert all(0 <= r["score"] <= 1 for r in found.values())
    odd = {r["doc_id"]: r for r in rows(language_id.languages(frame(spark), sample))}
    assert odd[3]["lang_pred"] == odd[4]["lang_pred"] == odd[5]["lang_pred"] == "und" and odd[1]["lang_pred"] in vocabulary
    assert len(rows(language_id.languages(frame(spark), sample))) == len(TEXTS)
    assert {r["lang_pred"] for r in rows(language_id.languages(frame(spark), EMPTY))} == {"und"}
    assert rows(language_id.languages(frame(spark, EMPTY), sample)) == []


# --- 2 personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 12 <= len(digits) <= 19 and pii.luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15:
                out.append((m.start(), pii.KINDS.index(kind), m.end()))
    return sorted(out)


def test_personal_data_equals_plain_patterns_on_random_texts():
    rng = random.Random(7)
    parts = ["@", ".", "a", "B", "1", "2", "25", " ", "-", "+", "(", ")", "_", "%", "4539 1488 0343 6467", "999", "é", "\n", "10.1.2.3"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert base_spans(text) == [(s.start, pii.KINDS.index(s.kind), s.end) for s in pii.find_spans(text) if s.kind in pii.BASE]


def test_checksums_and_context():
    assert [s.kind for s in pii.find_spans("IBAN DE89 3704 0044 0532 0130 00 AND MORE")] == ["iban"]
    assert pii.find_spans("DE88 3704 0044 0532 0130 00") == []
    assert [s.kind for s in pii.find_spans("call 555-123-4567 now")] == ["local_phone"] and pii.find_spans("part 555-123-4567 now") == []


def test_personal_data_rows_and_redaction(spark):
    found = {(r["doc_id"], len(r["spans"])) for r in rows(pii.personal_data(frame(spark)))}
    assert len(rows(pii.personal_data(frame(spark)))) == len(TEXTS) and (3, 0) in found
    docs = frame(spark, [(1, "mail a.b@c.de, ip 10.0.0.1."), (2, None)])
    clean = rows(pii.redacted(docs))
    assert clean[0]["text"] == "mail [email], ip [ip]." and clean[1]["text"] is None and list(clean[0]) == docs.columns
    assert rows(pii.personal_data(frame(spark, EMPTY))) == []


# --- 3 n-gram join


def near_copies(seed=3, groups=6, copies=12, words=60):
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        base = [f"g{g}x{rng.randint(0, 10**6)}" for _ in range(words + 20 * g)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = f"e{rng.randint(0, 10**6)}"
            out.append((len(out) * 3 + 1, " ".join(own)))
    shared = numbered("boiler", 40)
    out += [(1000 + k, shared + " " + " ".join(f"own{k}x{j}" for j in range(30 + k))) for k in range(25)]
    return out


def test_ngram_join_equals_brute_force(spark):
    texts = [t for t in dict(reversed([x for x in TEXTS if x[0]])).items()] + [(20 + i, t) for i, t in near_copies()]
    expected = links(texts)
    found = rows(ngram_join.jaccard_components(frame(spark, texts)))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == expected
    kept = rows(ngram_join.near_dedup(frame(spark, texts)))
    assert {r["doc_id"] for r in kept} == {c for _, c in expected.values()}


def test_ngram_join_odd_rows(spark):
    found = rows(ngram_join.jaccard_components(frame(spark)))
    assert len(found) == len(TEXTS)
    by_id = {r["doc_id"]: r for r in found if r["doc_id"]}
    assert by_id[3]["component_id"] == 3 and by_id[3]["n_shingles"] == 0 and by_id[12]["component_id"] == 11
    assert [r["component_id"] for r in found if r["doc_id"] is None and r["n_shingles"] > 100] == [7]
    assert rows(ngram_join.jaccard_components(frame(spark, EMPTY))) == []


def links_of_rows(texts):
    """(doc_id, set size, component) of each row, by comparing all pairs of rows."""
    found = links(list(enumerate(t for _, t in texts)))
    least = {}
    for k, (_, root) in found.items():
        if texts[k][0] is not None:
            least[root] = min(texts[k][0], least.get(root, texts[k][0]))
    return [(i, found[k][0], least.get(found[k][1], i) if found[k][0] else i) for k, (i, _) in enumerate(texts)]


def by_row(found):
    return sorted([-1 if x is None else x for x in r] for r in found)


@pytest.mark.parametrize("block, frequent", [(512, 30), (4, 30), (4, -2)])
def test_ngram_join_links_through_null_and_shared_ids(spark, monkeypatch, block, frequent):
    # With small blocks, buckets of frequent and of other shingles are dealt into several.
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "FREQUENT_LEAST", frequent)
    if block == 4:
        monkeypatch.setattr(ngram_join, "ROUNDS", 0)
        monkeypatch.setattr(ngram_join, "CROWD", 2)
        monkeypatch.setattr(ngram_join, "REMEMBERED", 3)
    a, z, q = (numbered(x, 60).split() for x in "azq")
    text = lambda w, k=0, new="n": " ".join([*w[k:], *(f"{new}{j}" for j in range(k))])
    texts = [(1, text(q)), (2, text(q, 12)), (None, text(q, 6)), (7, text(a)), (7, text(z)), (9, text(a, 3)), (11, text(z, 3)), (None, text(z, 5, "m")), (None, None), (30, text(q[:3]))]
    texts += [(40 + i, t) for i, t in near_copies(groups=3, copies=8)]
    expected = links_of_rows(texts)
    assert {c for i, _, c in expected if i in (1, 2)} == {1} and {c for i, _, c in expected if i == 11} == {7}
    found = rows(ngram_join.jaccard_components(frame(spark, texts)))
    assert by_row((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == by_row(expected)


def test_near_dedup_judges_texts_of_one_id_apart(spark):
    a, z = numbered("a", 60), numbered("z", 60)
    docs = frame(spark, [(5, a), (7, a + " more"), (7, z), (9, z + " more"), (None, a + " end")])
    assert sorted((r["doc_id"] or 0, r["text"]) for r in rows(ngram_join.near_dedup(docs))) == [(0, a + " end"), (5, a), (7, z)]


def test_sets_that_share_a_key_stay_apart(spark, monkeypatch):
    keys = ngram_join._keys
    monkeypatch.setattr(ngram_join, "_keys", lambda own: (keys(own)[0] % 3, keys(own)[1]))
    texts = near_copies(groups=2, copies=3)[:6]
    found = rows(ngram_join.jaccard_components(frame(spark, texts)))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == links(texts)


def test_rtree_finds_all_pairs_with_a_high_enough_bound():
    rng = np.random.default_rng(2)
    points = rng.integers(0, 5, (300, 16)).astype(np.int32)
    order = np.argsort(points.sum(axis=1), kind="stable")
    points, sizes = points[order], points[order].sum(axis=1)
    tree = ngram_join.RTree(points, sizes)
    for k in range(0, 300, 7):
        bound = np.minimum(points, points[k]).sum(axis=1)
        assert set(tree.search(points[k], int(sizes[k]))[0]) == set(np.flatnonzero(175 * bound >= 75 * (sizes + sizes[k])))


def test_count_vectors_survive_packing():
    rng = np.random.default_rng(4)
    for n in (1, 40, 500, 30_000, 2_000_000):
        own = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        counts = ngram_join.count_vector(own)
        assert (ngram_join.unpacked_vector(ngram_join.packed_vector(counts), len(own)) == counts).all() and counts.sum() == len(own)


def test_small_units_give_the_pairs_of_the_tree():
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (30, 60, 64, 130, 500, 9000)]
    sets = [np.unique(np.concatenate([b[: len(b) - k], rng.integers(0, 2**64, k, dtype=np.uint64)])) for b in base for k in (0, 2, 5, len(b) // 4)]
    order = rng.permutation(len(sets))
    sets = [sets[k] for k in order]
    n, node = np.array([len(s) for s in sets]), np.arange(len(sets))
    near, component = rng.random(len(sets)) < 0.7, rng.integers(0, 9, len(sets))
    raw = [ngram_join.packed_vector(ngram_join.count_vector(s)) for s in sets]
    starts, sizes = np.array([0, 3, 10, 12]), np.array([3, 7, 2, 12])
    i, j, _ = ngram_join._small_units(starts, sizes, n, near, component, raw, False)
    expected = set()
    for a, size in zip(starts, sizes):
        own = slice(a, a + size)
        block = ngram_join.Block(node[own], n[own], near[own], component[own], raw[own])
        for k in range(a, a + size):
            found, _ = block.partners(int(n[k]), bool(near[k]), component[k], lambda k=k: block.vector(int(k - a)), False)
            expected |= {tuple(sorted((k, int(node[own][x])))) for x in found}
    assert set(zip(i.tolist(), j.tolist())) == expected and expected


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, k) for k in range(101, 130)] + [(5, 5)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[k] == 1 for k in range(1, 61)) and all(found[k] == 100 for k in range(100, 130))
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- 4 exact dedup


def test_exact_dedup_with_runs_over_task_borders(spark):
    texts = TEXTS + [(100 + k, "same  text\n") for k in range(300)] + [(50, "same text ")]
    found = rows(exact_dedup.exact_groups(frame(spark, texts)))
    groups = {}
    for i, t in texts:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    assert len(found) == len(texts)
    for text, ids in groups.items():
        own = [r for r in found if r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()]
        keep = min((i for i in ids if i is not None), default=None)
        assert sorted(map(str, (r["doc_id"] for r in own))) == sorted(map(str, ids))
        assert {(r["keep_id"], r["group_size"]) for r in own} == {(keep, len(ids))} and sum(r["kept"] for r in own) == 1
    docs = frame(spark, texts)
    kept = rows(exact_dedup.exact_dedup(docs))
    assert len(kept) == len(groups) and list(kept[0]) == docs.columns
    assert rows(exact_dedup.exact_groups(frame(spark, EMPTY))) == [] and rows(exact_dedup.exact_dedup(frame(spark, EMPTY))) == []


# --- 5 substring dedup


@pytest.mark.parametrize("batches, crowd", [(1, 500), (4, 500), (4, 3), (3, 0)])
def test_substring_dedup_equals_brute_force(spark, monkeypatch, batches, crowd):
    monkeypatch.setattr(substring_dedup, "CROWD", crowd)
    monkeypatch.setattr(substring_dedup, "SET_WINDOWS", 50)
    monkeypatch.setattr(substring_dedup, "UNITED", 5)
    passage = numbered("p", 70)
    texts = dict(x for x in TEXTS if x[0])
    texts |= {200 + k: f"{numbered(f'a{k}x', 5 * k)} {passage if k % 2 else passage[:200]} {numbered(f'b{k}x', 30)}" for k in range(20)}
    texts = list(texts.items())
    words, kept = repeated_words(texts)
    facts, changed = substring_dedup.without_repeats(frame(spark, [*texts, (None, passage)]), batches)
    assert {r["doc_id"]: r["n_words"] for r in rows(facts) if r["doc_id"]} == {i: len(w) for i, w in words.items()}
    assert {r["doc_id"]: (r["n_removed"], r["kept_text"]) for r in rows(changed)} == {i: (len(words[i]) - len(w), " ".join(w)) for i, w in kept.items() if len(w) < len(words[i])}


def test_substring_dedup_with_several_texts_under_one_id(spark):
    p, q = numbered("p", 60), numbered("q", 55)
    texts = [(7, p), (7, q + " " + p), (7, p), (9, "x " + q), (9, numbered("y", 70)), (12, p + " " + q + " z"), (None, p)]
    facts, changed = substring_dedup.without_repeats(frame(spark, texts), 3)
    assert sorted((r["doc_id"], r["n_removed"], r["kept_text"]) for r in rows(changed)) == [(9, 55, "x"), (12, 115, "z")]
    assert len(rows(facts)) == len(texts)


def test_fingerprint_index_over_batches_in_any_order(spark):
    p = numbered("p", 60)
    batches = [[(20, "a " + p)], [(5, p + " b")], [(30, p), (31, numbered("r", 80))], [(40, "c " + p + " d")], [(50, numbered("r", 80))]]
    index, found, so_far = substring_dedup.FingerprintIndex(spark, buckets=3), [], []
    for own in batches:
        so_far += own
        facts = substring_dedup.document_facts(frame(spark, own).select("doc_id", "text"))
        found.append({r["doc_id"]: len(r["starts"]) for r in rows(substring_dedup.repeated_windows(index, facts, frame(spark, so_far).select("doc_id", "text")))})
    assert found == [{}, {}, {30: 11}, {40: 11}, {50: 31}] and len(index.prints) <= substring_dedup.MOST_RUNS


def test_substring_dedup_of_nothing(spark):
    facts, changed = substring_dedup.without_repeats(frame(spark, EMPTY))
    assert rows(facts) == [] and rows(changed) == []


# --- 6 token counts, 10 packing

ODD = ["", " ", "a", "a b\n c", "a\n\nb", "don't  do", "x <|endoftext|> y", "a\tb c", "a b\n", " x y", "é 12 !!", "\n", "a\r\nb", "▁x y", "ﬁ Å ½ ｱ z", "x\x00 y", "日本 語\n中", "<s> </s>", "a b c", "x" * 300]


def test_tokens_equal_the_libraries():
    bpe, pieces = byte_bpe(), piece_counts()
    assert pieces.parts and len(pieces.whole_tokens) > 10_000
    for text in [*ODD, *(t or "" for _, t in TEXTS)]:
        assert bpe(text) == array("I", bpe.whole.encode(text, add_special_tokens=False).ids).tobytes(), text
        assert pieces(text) == len(pieces.model.encode(text)), text


def test_token_counts_rows(spark):
    found = rows(token_counts.token_counts(frame(spark), limit=100))
    assert len(found) == len(TEXTS) and {r["n_tokens"] for r in found if r["doc_id"] in (3, 4)} == {0}
    assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in found)
    assert rows(token_counts.token_counts(frame(spark, EMPTY))) == []


def test_packing_is_a_round_trip(spark):
    texts = [(i, t) for i, t in {**dict(TEXTS), **{500 + k: numbered(f"z{k}", 40 * k) for k in range(40)}}.items()]
    found = rows(packing.packed(frame(spark, texts)))
    bpe = byte_bpe()
    for i, t in texts:
        ids = bpe.whole.encode(t or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted((r for r in found if r["doc_id"] == i), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(array("I", ids[at : at + r["length"]]).tobytes())
            at += r["length"]
        assert at == len(ids)
    for s in {r["sequence_id"] for r in found}:
        at = 0
        for r in sorted((r for r in found if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= packing.CAPACITY
    assert rows(packing.packed(frame(spark, EMPTY))) == []


def test_differencing_gives_nearly_equal_windows():
    rng = random.Random(1)
    sizes = [rng.randint(1, 128) for _ in range(1500)]
    dealt = packing.differencing(sizes, 40)
    sums = [sum(sizes[k] for k in own) for own in dealt]
    assert sorted(k for own in dealt for k in own) == list(range(1500)) and max(sums) - min(sums) <= 8
    assert packing.differencing([5], 3) == [[0]] and packing.differencing([], 3) == []


# --- 7 toxicity


def test_toxicity_learns_from_positives_and_unlabelled(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))
    data = []
    for k in range(900):
        own = [word() for _ in range(40)]
        if k % 8 == 0:
            own[3] = rng.choice(["zzoaf", "zzunk"]) + rng.choice(["", "ed", "ing"])
        data.append((k, " ".join(own), int(k % 8 == 0)))
    docs = spark.createDataFrame([x[:2] for x in data], "doc_id long, text string")
    labels = spark.createDataFrame([(k, t) for k, _, t in data] + [(5000, 1), (None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, ~toxicity.held_out())
    found = {r["doc_id"]: r["score"] for r in rows(toxicity.scored(docs, model))}
    held = [(k, t) for k, _, t in data if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum((found[k] >= 0.5) == t for k, t in held) >= 0.97 * len(held)
    odd = rows(toxicity.scored(frame(spark), model))
    assert len(odd) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in odd) and {r["score"] < 0.5 for r in odd if r["doc_id"] in (3, 4)} == {True}
    assert list(rows(toxicity.without_toxic(frame(spark), model))[0]) == frame(spark).columns
    nothing = toxicity.train(docs, labels.where("toxic = 0"), ~toxicity.held_out())
    assert {r["score"] for r in rows(toxicity.scored(docs, nothing))} == {0.0}
    assert rows(toxicity.scored(frame(spark, EMPTY), model)) == []


# --- 8 language model


def test_lm_base_scores_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "FREQUENT", 40)
    texts = [*TEXTS, *((300 + k, numbered("w", k % 17) + " tail") for k in range(60))]
    docs = frame(spark, texts)
    known = counted(texts)
    total, types = sum(known.values()), len(known)
    model, counts = lm_scoring.train(docs, docs.doc_id.isNotNull() | docs.doc_id.isNull())
    found = rows(lm_scoring.scored(docs, model, counts))
    assert len(found) == len(texts) and {r["train_tokens"] for r in found} == {total}
    by_id = {r["doc_id"]: r for r in found}
    for i, t in texts:
        if i is not None:
            own = [*WORD.findall((t or "").translate(LOWER)), None]
            base = sum(math.log10((known[w] + 0.5) / (total + 0.5 * (types + 1))) for w in own)
            assert by_id[i]["n_tokens"] == by_id[i]["n_known"] == len(own) and math.isclose(by_id[i]["base_score"], base, rel_tol=1e-9)
            assert by_id[i]["score"] < 0
    assert sum(r["score"] for r in found) > sum(r["base_score"] for r in found)


@pytest.mark.parametrize("frequent, bits", [(2, 1 << 15), (10**6, 1 << 30)])
def test_lm_scores_equal_brute_force_over_all_pairs(spark, monkeypatch, frequent, bits):
    monkeypatch.setattr(lm_scoring, "FREQUENT", frequent)
    monkeypatch.setattr(lm_scoring, "BITS", bits)
    texts = [*((k, f"common a{k % 40} b{k % 40} c{k} common") for k in range(3000)), (3000, "a1 b1"), (3001, "a1 b2"), (3002, "new b1"), (3003, None), (3003, "a1 b1")]
    docs = frame(spark, texts)
    token = lambda t: [*WORD.findall((t or "").translate(LOWER)), None]
    known = collections.Counter(x for _, t in texts[:3000] for x in token(t))
    seen = collections.Counter(x for _, t in texts[:3000] for x in zip(["<begin>", *token(t)], token(t)))
    before = collections.Counter()
    for (h, _), n in seen.items():
        before[h] += n
    total, prior = sum(known.values()) + 0.5 * (len(known) + 1), len(seen) / len(before)

    def chance(h, w):
        held = lm_scoring.lowest(lm_scoring.level(np.array([seen[h, w]])))[0] if seen[h, w] else 0
        return (held + prior * (known[w] + 0.5) / total) / (before[h] + prior)

    expected = sorted((i, sum(math.log10(chance(h, w)) for h, w in zip(["<begin>", *token(t)], token(t)))) for i, t in texts)
    found = sorted((r["doc_id"], r["score"]) for r in rows(lm_scoring.scored(docs, *lm_scoring.train(docs, docs.doc_id < 3000))))
    assert [i for i, _ in found] == [i for i, _ in expected]
    # A wrong probe of the filter can only raise a score, and is rare; a pair that is left out would lower it.
    same = [math.isclose(a, b, rel_tol=1e-9) for (_, a), (_, b) in zip(found, expected)]
    assert sum(same) > 0.8 * len(same) and all(ok or a > b for ok, (_, a), (_, b) in zip(same, found, expected))


def test_lm_knows_the_pairs_of_rare_words(spark):
    texts = [*((k, numbered("f", 2500)) for k in range(3)), (10, "rare1 rare2"), (11, "rare4 rare3"), (20, "rare1 rare2"), (21, "rare1 rare3")]
    docs = frame(spark, texts)
    score = {r["doc_id"]: r["score"] for r in rows(lm_scoring.scored(docs, *lm_scoring.train(docs, docs.doc_id < 20)))}
    assert score[20] > score[21] + 1


def test_lm_without_training_tokens(spark):
    docs = frame(spark)
    model, counts = lm_scoring.train(docs.where("false"), docs.doc_id > 0)
    assert {(r["base_score"], r["score"], r["n_known"]) for r in rows(lm_scoring.scored(docs, model, counts))} == {(0.0, 0.0, 0)}


def test_log_frequency_filter_never_reads_too_low_a_level():
    counts = np.array([1, 2, 3, 5, 9, 100, 4000])
    q = lm_scoring.level(counts)
    assert (np.abs(lm_scoring.meant(q) / counts - 1) < 0.5).all() and lm_scoring.meant(np.array([0]))[0] == 0
    bits = np.zeros(lm_scoring.BITS // 8, dtype=np.uint8)
    for code, n in enumerate(q):
        for row in lm_scoring._bits(np.full(n, code), np.arange(1, n + 1)):
            for x in row:
                bits[int(x) >> 3] |= 1 << (int(x) & 7)
    held = lm_scoring.LogFrequencyFilter(bits, int(q.max()))
    assert (held.levels(np.arange(len(q))) >= q).all() and held.levels(np.arange(100, 200)).sum() == 0


# --- 9 decontamination


@pytest.mark.parametrize("most", [10, 10**6])
def test_decontamination_equals_brute_force(spark, most):
    items = [(1, numbered("w", 15)), (2, "ONE, two"), (3, None), (4, "..."), (5, numbered("w", 14).upper()), (None, "quick brown"), (12, "fox Jumps; over")]
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n int")
    docs = frame(spark, [x for x in TEXTS if x[0] not in (11, None)] + [(11, "one two")])
    windows = {}
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        for k in range(len(w) - min(10, len(w)) + 1) if w and i is not None else ():
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    for r in rows(decontamination.contamination(docs, benchmark, most)):
        w = ALNUM.findall((dict(TEXTS)[r["doc_id"]] or "").translate(LOWER))
        hit, found = set(), set()
        for window, ids in windows.items():
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    hit.update(range(k, k + len(window)))
                    found |= ids
        assert {x for s in r["spans"] for x in range(s["start"], s["end"])} == hit and r["items"] == sorted(found) and r["n_words"] == len(w)
    clean = rows(decontamination.decontaminated(docs, benchmark, most=most))
    assert {r["doc_id"] for r in clean} == {3, 4, 5, 6, 10, 13, 14} and list(clean[0]) == docs.columns
    spans = {r["doc_id"]: r["text"] for r in rows(decontamination.decontaminated(docs, benchmark, "spans", most))}
    assert spans[11] == "" and spans[8].split() == [*numbered("w", 120).split()[15:], "tail"] and len(spans) == docs.count()
    nothing = decontamination.contamination(docs, benchmark.where("false"), most)
    assert {len(r["items"]) for r in rows(nothing)} == {0}


def test_decontamination_keeps_repeated_and_null_ids_apart_with_several_sets(spark):
    benchmark = spark.createDataFrame([(1, numbered("w", 15)), (2, "ONE, two"), (3, numbered("v", 30))], "item_id long, text string")
    same = [(None, "x " + numbered("w", 119)), (None, "y " + numbered("q", 119)), (11, "one three")]
    docs = frame(spark, [*TEXTS, *same])

    def found(most):
        out = rows(decontamination.contamination(docs, benchmark, most))
        return sorted((r["doc_id"] or -1, r["n_words"], sorted({x for s in r["spans"] for x in range(s["start"], s["end"])}), list(r["items"])) for r in out)

    assert len(found(5)) == len(TEXTS) + len(same) and found(5) == found(10**6)


# --- the queries' own columns


def tables(spark, folder, texts, labels=None):
    """A folder with documents, and labels, for the queries."""
    frame(spark, texts).withColumn("lang", _lang()).write.parquet(f"{folder}/documents.parquet")
    if labels:
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def _lang():
    from pyspark.sql import functions as F

    return F.when(F.col("doc_id") % 2 == 0, "aa").when(F.col("doc_id") % 3 == 0, None).otherwise("bb")


def is_held_out(doc_id, fold):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == fold


def two_languages(n=120, seed=8):
    rng = random.Random(seed)
    words = ["kal mor tin sev dul".split(), "ösch ung keit berg 日本".split()]
    return [(k, " ".join(rng.choice(words[k % 2]) for _ in range(rng.randint(3, 40)))) for k in range(n)]


def test_language_id_query_folds(spark, tmp_path):
    texts = [*two_languages(), *[(i, t) for i, t in TEXTS if i is None]]
    found = rows(language_id.op1_language_id(spark, tables(spark, tmp_path, texts)))
    assert list(found[0]) == ["doc_id", "held_out", "lang_pred", "score"] and len(found) == len(texts)
    assert all(r["held_out"] == is_held_out(r["doc_id"], 0) for r in found)
    assert all(r["lang_pred"] == ("aa" if r["doc_id"] % 2 == 0 else "bb") for r in found if r["doc_id"] is not None)


def test_language_id_tells_scripts_with_many_letters_apart(spark):
    rng = random.Random(3)
    # Two languages whose letters are all among hundreds of rare ones.
    data = [(k, "".join(chr((0x4E00, 0x5200)[k % 2] + rng.randrange(300)) for _ in range(60)), ("xx", "yy")[k % 2]) for k in range(160)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    sample = language_id.labelled_sample(docs, docs.doc_id < 100)
    found = {r["doc_id"]: r["lang_pred"] for r in rows(language_id.languages(docs, sample))}
    assert sum(found[i] == lang for i, _, lang in data if i >= 100) >= 58
    long = spark.createDataFrame([(k, t * 500, lang) for k, t, lang in data[:20]], "doc_id long, text string, lang string")
    assert {lang for _, lang in language_id.labelled_sample(long, long.doc_id >= 0)} == {"xx", "yy"}


def test_personal_data_query_digests(spark, tmp_path):
    texts = [*TEXTS, (90, "a.b@c.de and 10.0.0.1, 4539 1488 0343 6467 or +49 170 1234567"), (91, "x@y.z x@y.z 300.1.1.1 999.1.1.1")]
    found = rows(pii.op2_pii(spark, tables(spark, tmp_path, texts)))
    assert len(found) == len(texts)
    of = {}
    for i, t in texts:
        spans = base_spans(t or "")
        told = ",".join(f"{pii.KINDS[kind]}:{a}:{b}" for a, kind, b in spans)
        of.setdefault(i, []).append((*(sum(pii.KINDS[kind] == name for _, kind, _ in spans) for name in ("email", "ip", "card", "phone")), hashlib.sha256(told.encode()).hexdigest()))
    for i in of:
        assert sorted((r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in found if r["doc_id"] == i) == sorted(of[i])


def test_toxicity_query_folds_and_threshold(spark, tmp_path):
    rng = random.Random(6)
    texts = [(k, " ".join([*(rng.choice("alpha beta gamma delta".split()) for _ in range(20)), *(["zzvile"] * (k % 7 == 0))])) for k in range(420)]
    found = rows(toxicity.op7_toxicity(spark, tables(spark, tmp_path, [*texts, (None, "alpha")], [(k, 1, int(k % 7 == 0)) for k, _ in texts])))
    assert len(found) == len(texts) + 1
    assert all(r["held_out"] == is_held_out(r["doc_id"], 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    held = [r for r in found if r["held_out"]]
    assert sum(r["predicted"] == int(r["doc_id"] % 7 == 0) for r in held) >= 0.97 * len(held)


def test_lm_query_folds_and_counts(spark, tmp_path):
    texts = [*((k, f"one two word{k % 9} {'rare' + str(k)}") for k in range(60)), (None, "one"), (70, None)]
    found = rows(lm_scoring.op8_lm_scoring(spark, tables(spark, tmp_path, texts)))
    known = counted([(i, t) for i, t in texts if not is_held_out(i, 1)])
    total, types = sum(known.values()), len(known)
    assert len(found) == len(texts) and {r["train_tokens"] for r in found} == {total}
    by_id = {r["doc_id"]: r for r in found}
    for i, t in texts:
        own, r = [*WORD.findall((t or "").translate(LOWER)), None], by_id[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"]) == (is_held_out(i, 1), len(own), sum(known[w] > 0 for w in own))
        assert math.isclose(r["base_score"], sum(math.log10((known[w] + 0.5) / (total + 0.5 * (types + 1))) for w in own), rel_tol=1e-9)


def test_packing_leaves_most_documents_whole(spark):
    rng = random.Random(9)
    texts = [(k, numbered(f"t{k}", rng.choice([5, 30, 80, 150]))) for k in range(1500)]
    found = rows(packing.packed(frame(spark, texts).coalesce(1)))
    pieces = collections.Counter(r["doc_id"] for r in found if r["doc_tokens"] < packing.CAPACITY)
    assert sum(n == 1 for n in pieces.values()) > 0.9 * len(pieces)
    filled = collections.Counter()
    for r in found:
        filled[r["sequence_id"]] += r["length"]
    padding = sum(packing.CAPACITY - n for n in filled.values() if n & (n - 1))
    assert padding < 0.01 * sum(filled.values())
