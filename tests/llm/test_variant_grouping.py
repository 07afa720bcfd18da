import random
import re
import zlib
from collections import Counter

import pytest

from tests.llm.helpers import LOWER, TEXTS, frame
from tidelog.llm import variant_grouping as variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def by_all_pairs(words):
    near = {w: [] for w in words}
    for a in words:
        for b in words:
            if one_edit(a, b):
                near[a].append(b)
    return near


def groups(counts, times=10):
    near, form = by_all_pairs(counts), {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= times * counts[w]:
            form[w] = best
    out = {}
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), counts.get(form.get(w)))
    return out


def counted(texts, least_length=7, least_count=2):
    found = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (t or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_length:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= least_count}


def edited(rng, word, letters):
    k = rng.randrange(len(word) + 1)
    return rng.choice([word[:k] + rng.choice(letters) + word[k:], word[:k] + word[k + 1 :], word[: k - 1] + rng.choice(letters) + word[k:] if k else word])


def vocabulary(seed, n, least, letters="abcdeé"):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(least, least + 4))) for _ in range(n)}
    for _ in range(3):
        words |= {edited(rng, w, letters) for w in sorted(words)[:n]}
    return {w: rng.choice([2, 3, 5, 40, 700, 9000]) for w in sorted(words) if len(w) >= least}


def found(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("frequent", [2, 8, 40])
def test_changed_grams_cover_every_edit(frequent):
    words = sorted(vocabulary(1, 150, 7))
    parts = Counter(g for w in words for size in (2, 3) for m in [variants.BEGIN + w + variants.END] for g in (m[k : k + size] for k in range(len(m) - size + 1)))
    grams = variants.Grams({g: n for g, n in parts.items() if n > frequent}, 4)

    def placed(word):
        marked = variants.BEGIN + word + variants.END
        return marked, grams.decomposed(marked)

    for a in words[:120]:
        marked, own = placed(a)
        ranges = grams.changed(marked, own)
        assert all(x < y and s < t for (s, x), (t, y) in zip(own, own[1:])) and max(end - first for first, end in ranges) < len(own)
        for k in range(len(a) + 1):
            for b in {a[:k] + c + a[k:] for c in "abé"} | {a[:k] + a[k + 1 :]} | {a[:k] + c + a[k + 1 :] for c in "abé"}:
                if b == a:
                    continue
                other, theirs = placed(b)
                shift = len(b) - len(a)
                left = {s for s, e in own if e <= k + 1 and (s, e) in theirs and marked[s:e] == other[s:e]}
                right = {s for s, e in own if s >= k + 1 and (s + shift, e + shift) in theirs and marked[s:e] == other[s + shift : e + shift]}
                lost = {n for n, (s, _) in enumerate(own) if s not in left | right}
                assert any(lost <= set(range(first, end)) for first, end in ranges), (a, b)


def test_shortened_words_meet_when_one_edit_apart():
    rng = random.Random(4)
    words = sorted(vocabulary(3, 80, 7))
    for _ in range(3000):
        a, b = rng.choice(words), rng.choice(words)
        b = rng.choice([b, edited(rng, a, "abc")])
        if one_edit(a, b):
            assert set(variants.shortened(a).tolist()) & set(variants.shortened(b).tolist())
    assert len(variants.shortened("aaaa")) == 2 and len(variants.shortened("x" * 5000)) == 2


@pytest.mark.parametrize("least, long_list", [(7, 200), (7, 3), (5, 200), (3, 1)])
def test_grouping_equals_all_pairs(spark, least, long_list):
    counts = vocabulary(least, 220, least)
    words = spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n long, gram string")
    assert found(variants.grouped(words, least, long_list=long_list)) == groups(counts)


def test_query_on_texts(spark, tmp_path):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(7, 12))) for _ in range(40)]
    texts = [(k, " ".join([*rng.choices(base, k=200), *(edited(rng, rng.choice(base), "xyz") for _ in range(3)), "SHOUTED×Word Émigrés"])) for k in range(60)]
    texts += [*TEXTS, (900, "q" * 9000 + " " + "q" * 9001), (901, "q" * 9000 + " " + "q" * 9001), (902, "łódźłódź straße Straßenbahn straßenbahn")]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    wanted = groups(counted(texts))
    assert len(wanted) > 60 and found(variants.op13_variant_grouping(spark, str(tmp_path))) == wanted
    assert sum(form is not None for form, *_ in wanted.values()) > 10


def test_empty_table(spark):
    assert variants.grouped(variants.counted_words(frame(spark, []))).count() == 0
    with pytest.raises(ValueError):
        variants.near_pairs(spark.createDataFrame([("ab", 1)], "word string, n long"), 2)
