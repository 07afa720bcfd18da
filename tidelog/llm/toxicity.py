"""Toxicity scores by non-negative positive-unlabelled learning.

Only confirmed toxic examples count as labelled; all other training text is unlabelled. A linear
model over the presence of words and word beginnings is fitted in numpy to the class-prior-corrected
risk   prior * E_toxic[loss(f, +1)] + max(0, E_unlabelled[loss(f, -1)] - prior * E_toxic[loss(f, -1)])
with logistic loss: what toxic texts put into the unlabelled risk is taken out of it again, and the
remainder, the risk on clean text, is kept from going below zero. The class prior is the share of
toxic rows among the labelled training rows. Spark counts in how many toxic and unlabelled examples
each feature occurs; features are chosen by these counts.

Bounds (the only sampling; every text is scored whole): at most POSITIVES toxic and UNLABELLED other
texts, taken by a hash of the id, of at most LONGEST_EXAMPLE characters, equal texts once; FEATURES
features.

Defined results: null and empty texts get the score of a text without features; without toxic
examples all scores are 0; rows are independent, so repeated rows and null ids are carried through
(a null id isn't held out); labels without a document, null labels and repeated labels do no harm.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import fold, lists, table, text_blocks
from tidelog.llm.textkernels import Words, as_long

POSITIVES = 3000
UNLABELLED = 9000
LONGEST_EXAMPLE = 20_000
FEATURES = 1500

#: Least number of toxic examples that a feature occurs in, and how many times its share among
#: toxic texts must exceed that among clean ones.
SUPPORT = 4
CONTRAST = 8.0

#: A feature is a whole word or its first so many bytes.
BEGINNINGS = (4, 5, 6, 7)

STEPS = 400
RATE = 0.1
SHRINK = 3e-4


def _features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of everything that occurs, with repetitions."""
    of = words.text_of_word()
    texts, found = [of], [words.hashes]
    for size in BEGINNINGS:
        at, hashes = words.prefix_hashes(size)
        texts.append(of[at])
        found.append(hashes)
    return np.concatenate(texts), np.concatenate(found)


def _distinct(texts: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((found, texts))
    texts, found = texts[order], found[order]
    new = np.ones(len(texts), dtype=bool)
    new[1:] = (texts[1:] != texts[:-1]) | (found[1:] != found[:-1])
    return texts[new], found[new]


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_blocks(batches):
        texts, found = _distinct(*_features(Words(batch.column("text").to_pylist(), "alnum")))
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)[texts]
        values, at = np.unique(found, return_inverse=True)
        n_toxic, n = np.bincount(at, weights=toxic), np.bincount(at)
        yield pa.RecordBatch.from_arrays([pa.array(as_long(values)), pa.array(n_toxic.astype(np.int64)), pa.array(n.astype(np.int64) - n_toxic.astype(np.int64))], ["feature", "n_toxic", "n_other"])


class Chosen:
    """The chosen features, sorted, with a quick test that most others fail."""

    def __init__(self, features: np.ndarray):
        self.features = np.sort(features.astype(np.int64).view(np.uint64))
        self.likely = np.zeros(1 << 16, dtype=bool)
        self.likely[self.features >> np.uint64(48)] = True

    def present(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(text, number of the feature), each once."""
        texts, found = _features(words)
        maybe = self.likely[found >> np.uint64(48)] if len(self.features) else np.zeros(len(found), dtype=bool)
        texts, found = texts[maybe], found[maybe]
        place = np.minimum(np.searchsorted(self.features, found), max(len(self.features) - 1, 0))
        same = self.features[place] == found if len(self.features) else maybe[maybe]
        return _distinct(texts[same], place[same])


def nn_pu_fit(toxic: np.ndarray, other: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative PU risk (Adam, full batches)."""
    n = toxic.shape[1]
    w = np.zeros(n + 1, dtype=np.float64)
    w[n] = np.log(prior / (1 - prior))
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        f_p, f_u = toxic @ w[:n].astype(np.float32) + w[n], other @ w[:n].astype(np.float32) + w[n]
        s_p, s_u = 1 / (1 + np.exp(-f_p)), 1 / (1 + np.exp(-f_u))
        clean_risk = np.logaddexp(0, f_u).mean() - prior * np.logaddexp(0, f_p).mean()
        pull = prior * (s_p - 1) / len(f_p)
        back_p, back_u = -prior * s_p / len(f_p), s_u / len(f_u)
        if clean_risk < 0:  # only undo what makes the clean risk negative
            pull, back_p, back_u = np.zeros_like(pull), -back_p, -back_u
        g_p = (pull + back_p).astype(np.float32)
        gradient = np.append(toxic.T @ g_p + other.T @ back_u.astype(np.float32), g_p.sum() + back_u.sum()).astype(np.float64)
        gradient[:n] += SHRINK * w[:n]
        mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        w -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return w[:n].astype(np.float32), float(w[n])


class Model:
    def __init__(self, chosen: Chosen, weights: np.ndarray, bias: float | None):
        self.chosen, self.weights, self.bias = chosen, weights, bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.bias is None:
            return np.zeros(len(texts))
        of, feature = self.chosen.present(Words(texts, "alnum"))
        value = np.bincount(of, weights=self.weights[feature], minlength=len(texts)) + self.bias
        return 1 / (1 + np.exp(-value))


def train(docs: DataFrame, labels: DataFrame, trained_on: Column) -> Model:
    """Fits a model to docs(doc_id, text) and labels(doc_id, toxic) of the rows in trained_on."""
    nothing = Model(Chosen(np.zeros(0, dtype=np.int64)), np.zeros(0, dtype=np.float32), None)
    known = labels.where(trained_on & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    told = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    rows = docs.where(trained_on & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= LONGEST_EXAMPLE)).select("doc_id", "text")
    total = rows.select("doc_id").count()
    if not told.toxic or not total:
        return nothing
    prior = min(max(told.toxic / told.n, 1e-3), 0.5)
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000))
    share = lambda most, n: int(min(1.0, most / n) * 1_000_000)
    some_toxic = F.broadcast(known.where((F.col("toxic") == 1) & (place < share(POSITIVES, told.toxic))).select("doc_id", F.lit(1).alias("toxic")))
    # Unlabelled examples come from the other end of the hash, whatever their label.
    toxic = rows.join(some_toxic, "doc_id").select("doc_id", "text", "toxic")
    other = rows.where(place >= 1_000_000 - share(UNLABELLED, total)).select("doc_id", "text", F.lit(0).alias("toxic"))
    examples = toxic.unionByName(other).groupBy(F.xxhash64("text").alias("h"), "toxic").agg(F.min_by("text", "doc_id").alias("text")).select("text", "toxic").persist()
    try:
        sizes = {r.toxic: r.n for r in examples.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        n_toxic, n_other = sizes.get(1, 0), sizes.get(0, 0)
        if not n_toxic or not n_other:
            return nothing
        counted = examples.mapInArrow(_count, "feature long, n_toxic long, n_other long").groupBy("feature").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_other").alias("n_other"))
        among_toxic, among_other = (F.col("n_toxic") + 0.5) / (n_toxic + 1), (F.col("n_other") + 0.5) / (n_other + 1)
        among_clean = F.greatest((among_other - prior * among_toxic) / (1 - prior), F.lit(0.5 / (n_other + 1)))
        gain = F.col("n_toxic") * F.log(among_toxic / among_clean)
        best = counted.where((F.col("n_toxic") >= SUPPORT) & (among_toxic > CONTRAST * among_clean)).orderBy(gain.desc(), "feature").limit(FEATURES)
        chosen = Chosen(np.array([r.feature for r in best.select("feature").collect()], dtype=np.int64))
        shared = examples.sparkSession.sparkContext.broadcast(chosen)

        def presence(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in text_blocks(batches):
                of, feature = shared.value.present(Words(batch.column("text").to_pylist(), "alnum"))
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), lists(feature, np.bincount(of, minlength=batch.num_rows), pa.int32())], ["toxic", "features"])

        found = examples.mapInArrow(presence, "toxic int, features array<int>").collect()
    finally:
        examples.unpersist()
    matrix = {1: np.zeros((n_toxic, len(chosen.features)), dtype=np.float32), 0: np.zeros((n_other, len(chosen.features)), dtype=np.float32)}
    at = {0: 0, 1: 0}
    for r in sorted(found):
        matrix[r.toxic][at[r.toxic], r.features] = 1
        at[r.toxic] += 1
    return Model(chosen, *nn_pu_fit(matrix[1], matrix[0], prior))


def _shared_scores(docs: DataFrame, model: Model):
    return docs.sparkSession.sparkContext.broadcast(model)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, score."""
    shared = _shared_scores(docs, model)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.scores(batch.column("text").to_pylist()))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows of docs whose score is below the limit, with all their columns."""
    shared = _shared_scores(docs, model)

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches):
            yield batch.filter(pa.array(shared.value.scores(batch.column("text").to_pylist()) < limit))

    return docs.mapInArrow(keep, docs.schema)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scored(docs, train(docs, table(spark, sf_dir, "labels"), ~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
