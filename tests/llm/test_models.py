"""Trained models against the same formulas written plainly."""

import random

import numpy as np

from tests.llm.helpers import frame
from tidelog.llm import language_id, toxicity


def grams(text):
    """Distinct n-grams of one to three symbols; all that is no letter is one border."""
    symbols = [" "]
    for c in text.lower() + " ":
        if c.isalpha() or symbols[-1] != " ":
            symbols.append(c if c.isalpha() else " ")
    return {tuple(symbols[k : k + n]) for n in (1, 2, 3) for k in range(len(symbols) - n + 1)}


def test_language_model_equals_plain_kernel_ridge():
    rng = random.Random(5)
    words = {"aa": "kal mor tin sev dul pra".split(), "bb": "ösch ung keit berg lich äm".split(), "cc": "que los del ñan".split()}
    sample = [(" ".join(rng.choice(words[lang]) for _ in range(rng.randint(3, 20))) + rng.choice(["", ".", " 12!"]), lang) for k in range(50) for lang in [("aa", "bb", "cc")[k % 3]]]
    texts, langs = map(list, zip(*sample))
    new = ["kal keit los", "mor, mor", "berg lich que 7", *texts[:5]]
    model = language_id.KernelModel(texts, langs)
    marks, seen = [], {}
    for k, lang in enumerate(langs):
        seen[lang] = seen.get(lang, 0) + 1
        if seen[lang] <= language_id.LANDMARKS:
            marks.append(k)
    known = set().union(*(grams(texts[k]) for k in marks))
    own = lambda t: grams(t) & known
    kernel = lambda a, b: len(own(a) & own(b)) / np.sqrt(len(own(a)) * len(own(b)))
    k_mm = np.array([[kernel(texts[i], texts[j]) for j in marks] for i in marks])
    values, vectors = np.linalg.eigh(k_mm)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = np.array([[kernel(t, texts[j]) for j in marks] for t in texts]) @ root
    target = np.array([[1.0 if lang == x else -1.0 for x in sorted(words)] for lang in langs])
    weight = np.array([1 / seen[lang] for lang in langs])
    center = (weight[:, None] * target).sum(0) / weight.sum()
    left = sum(w * np.outer(x, x) for w, x in zip(weight, z)) + language_id.RIDGE * weight.sum() / len(texts) * np.eye(z.shape[1])
    beta = np.linalg.solve(left, sum(w * np.outer(x, y - center) for w, x, y in zip(weight, z, target)))
    plain = np.array([[kernel(t, texts[j]) for j in marks] for t in new]) @ root @ beta + center
    assert np.allclose(model.values(new), plain, atol=2e-3)
    best, score = model.predict(new)
    assert list(best) == list(plain.argmax(1)) and ((0 < score) & (score <= 1)).all()


def test_toxicity_fit_reaches_the_risk_of_a_plain_run():
    rng = np.random.default_rng(3)
    toxic, other = (rng.random((20, 6)) < np.array([0.8, 0.7, 0.2, 0.3, 0.5, 0.1])).astype(np.float32), (rng.random((30, 6)) < 0.25).astype(np.float32)
    prior = 0.2
    loss = lambda f: np.log1p(np.exp(f))

    def parts(w):
        """Scores of both kinds, risk of the toxic ones, risk of the clean ones."""
        f_p, f_u = toxic @ w[:6] + w[6], other @ w[:6] + w[6]
        return f_p, f_u, prior * loss(-f_p).mean(), loss(f_u).mean() - prior * loss(f_p).mean()

    w = np.append(np.zeros(6), np.log(prior / (1 - prior)))
    m, v = np.zeros(7), np.zeros(7)
    for step in range(1, toxicity.STEPS + 1):
        f_p, f_u, _, clean = parts(w)
        gradient = np.zeros(7)
        for x, f in zip(toxic, f_p):
            s = 1 / (1 + np.exp(-f))
            gradient += np.append(x, 1.0) * (prior * s if clean < 0 else prior * (s - 1) - prior * s) / 20
        for x, f in zip(other, f_u):
            gradient += np.append(x, 1.0) * (-1 if clean < 0 else 1) / (1 + np.exp(-f)) / 30
        gradient[:6] += toxicity.SHRINK * w[:6]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        w = w - toxicity.RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    # At the start the bias has no gradient but rounding, so weights differ; the risks don't.
    found = np.append(*toxicity.nn_pu_fit(toxic, other, prior))
    risk = lambda x: parts(x)[2] + max(0.0, parts(x)[3])
    assert abs(risk(found) - risk(w)) < 0.02 and risk(found) < 0.5 * risk(np.append(np.zeros(6), np.log(prior / (1 - prior))))
    assert np.corrcoef(np.append(*parts(found)[:2]), np.append(*parts(w)[:2]))[0, 1] > 0.99


def test_number_characters_are_no_letters(spark):
    sample = [("kal mor", "aa"), ("ung berg", "bb")] * 5
    found = {r.doc_id: (r.lang_pred, r.score) for r in language_id.languages(frame(spark, [(1, "½ ² Ⅷ 12"), (2, "½ mor"), (3, "٣")]), sample).collect()}
    assert found[1] == found[3] == ("und", 0.0) and found[2][0] == "aa"


def test_sample_is_bounded_whatever_repeats(spark):
    rows = [(None, f"null {k}", "aa") for k in range(3000)] + [(7, f"seven {k}", "aa") for k in range(3000)] + [(k, "one text", "bb") for k in range(500)] + [(9, "again", "bb")] * 3000 + [(k, f"text {k}", "cc") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language_id.labelled_sample(docs, docs.doc_id >= 0, 100)
    of = {lang: [t for t, x in sample if x == lang] for lang in ("aa", "bb", "cc")}
    assert len(of["aa"]) == 100 and all(t.startswith("seven") for t in of["aa"]) and len(of["bb"]) == 100 and len(set(of["cc"])) == 100
    assert language_id.labelled_sample(docs, docs.doc_id > 10**6) == []
