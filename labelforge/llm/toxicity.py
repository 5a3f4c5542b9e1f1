"""Toxicity: character n-gram linear classifier with naive Bayes scaling.

Features are the distinct character n-grams of a text, taken inside its words
(with a mark at either end) and hashed. Each feature is scaled by its naive
Bayes log-count ratio between the classes, and a ridge logistic regression is
fitted on the scaled features. The n-grams of a word are the same wherever it
stands, so they are computed once per distinct word of a bounded run of texts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.llm.common import labels_of, parallelism, whole_text

#: Lengths of the n-grams.
NGRAMS = (4, 5, 6, 7)

#: Hashed features.
FEATURES = 1 << 21

#: Labelled rows per class that the classifier is fitted on, at most (the bound of the training sample).
SAMPLE_PER_CLASS = 2000

#: Pseudo-documents added to the counts, shared by class size.
SMOOTHING = 4.0

#: A feature of fewer training documents has no weight.
MIN_DOCUMENTS = 3

#: A feature whose log-count ratio is nearer to zero than this has no weight.
MIN_RATIO = 0.5

#: Ridge penalty on the weights.
RIDGE = 20.0

#: Characters of text whose words are hashed together.
RUN_CHARS = 1 << 20


def hashed_ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of each word between end marks: all of them in word order, and where each word's begin."""
    points = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    word = np.repeat(np.arange(len(words)), sizes)
    hashes, owners = [], []
    for n in NGRAMS:
        m = len(points) - n + 1
        if m <= 0:
            continue
        inside = np.flatnonzero(word[:m] == word[n - 1 :])
        h = np.full(len(inside), n, dtype=np.uint64)
        for k in range(n):
            h = (h ^ points[inside + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        hashes.append(((h >> np.uint64(7)) % np.uint64(FEATURES)).astype(np.int32))
        owners.append(word[inside])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    flat = np.concatenate(hashes)[order]
    return flat, np.searchsorted(owner[order], np.arange(len(words) + 1))


def features_of(texts: list[str]) -> Iterator[np.ndarray]:
    """Distinct hashed features of each text. Words are hashed once per run of texts."""
    place = np.zeros(FEATURES, dtype=np.int32)
    for run in _runs(texts):
        number: dict[str, int] = defaultdict(count().__next__)
        docs = []
        for text in run:
            words = set(text.lower().split())
            docs.append(np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words)))
        if not number:
            yield from (np.zeros(0, np.int32) for _ in run)
            continue
        flat, starts = hashed_ngrams(list(number))
        for ids in docs:
            sizes = starts[ids + 1] - starts[ids]
            ends = np.cumsum(sizes)
            at = np.arange(ends[-1] if len(ends) else 0)
            every = flat[np.repeat(starts[ids] - (ends - sizes), sizes) + at]
            place[every] = at  # the last place of a feature wins, which leaves each once
            yield every[place[every] == at]


def _runs(texts: list[str]) -> Iterator[list[str]]:
    run: list[str] = []
    size = 0
    for text in texts:
        run.append(text)
        size += len(text)
        if size >= RUN_CHARS:
            yield run
            run, size = [], 0
    if run:
        yield run


@dataclass(frozen=True)
class NaiveBayesLinear:
    """Weights per feature (already times the log-count ratio) and the intercept."""

    weights: np.ndarray
    intercept: float

    def score(self, features: np.ndarray) -> float:
        """Probability of label 1."""
        z = self.intercept + float(self.weights[features].sum())
        return 1.0 / (1.0 + np.exp(-min(700.0, max(-700.0, z))))


def fit_arrays(
    rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, smoothing: float = SMOOTHING, ridge: float = RIDGE, steps: int = 25
) -> NaiveBayesLinear:
    """Fit on feature lists; ``weight`` restores the class shares of the whole training set.

    With one class only, or none, the score is the smoothed share of label 1 for every text.
    """
    share = (weight[y == 1].sum() + 1) / (weight.sum() + 2)
    prior = float(np.log(share / (1 - share)))
    if len(set(y.tolist())) < 2:
        return NaiveBayesLinear(np.zeros(FEATURES, np.float32), prior)
    sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
    flat = np.concatenate(rows).astype(np.int64)
    doc = np.repeat(np.arange(len(rows)), sizes)
    held = np.repeat(y == 1, sizes)
    one, zero = int((y == 1).sum()), int((y == 0).sum())
    in_one = np.bincount(flat[held], minlength=FEATURES)
    in_zero = np.bincount(flat[~held], minlength=FEATURES)
    # features are presences, so the counts are of documents; pseudo-documents follow the class
    # sizes, so a feature without evidence has ratio zero
    pseudo = smoothing * np.array([zero, one]) / (zero + one)
    ratio = np.log((in_one + pseudo[1]) / (one + pseudo[1])) - np.log((in_zero + pseudo[0]) / (zero + pseudo[0]))
    ratio[(in_one + in_zero < MIN_DOCUMENTS) | (np.abs(ratio) < MIN_RATIO)] = 0.0
    kept = ratio[flat] != 0.0
    flat, doc = flat[kept], doc[kept]
    scaled = ratio[flat].astype(np.float32)
    # ridge logistic regression by conjugate gradients inside Newton steps
    w, b = np.zeros(FEATURES), prior
    target = y.astype(np.float64)
    for _ in range(10):
        z = np.bincount(doc, weights=scaled * w[flat], minlength=len(rows)) + b
        p = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
        slope, curve = weight * (p - target), weight * np.maximum(p * (1 - p), 1e-6)
        gw = np.bincount(flat, weights=scaled * slope[doc], minlength=FEATURES) + ridge * w
        gb = slope.sum()
        if np.sqrt((gw * gw).sum() + gb * gb) < 1e-3 * len(rows) ** 0.5:
            break
        x, xb = np.zeros(FEATURES), 0.0
        r, rb = -gw, -gb
        d, db = r.copy(), rb
        rr = (r * r).sum() + rb * rb
        start = rr
        for _ in range(steps):
            xd = np.bincount(doc, weights=scaled * d[flat], minlength=len(rows)) + db
            hd = np.bincount(flat, weights=scaled * (curve * xd)[doc], minlength=FEATURES) + ridge * d
            hb = (curve * xd).sum()
            a = rr / ((d * hd).sum() + db * hb)
            x += a * d
            xb += a * db
            r -= a * hd
            rb -= a * hb
            new = (r * r).sum() + rb * rb
            if new < 1e-2 * start:
                break
            d, db, rr = r + new / rr * d, rb + new / rr * db, new
        w += x
        b += xb
    return NaiveBayesLinear((w * ratio).astype(np.float32), float(b))


def features_column(text: Column) -> Column:
    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(features_of([t or "" for t in texts])), dtype=object)

    return run(text)


def toxicity_labels(labels: DataFrame) -> DataFrame:
    return labels_of(labels, "toxic")


def fit(docs: DataFrame, labels: DataFrame, sample_per_class: int = SAMPLE_PER_CLASS) -> NaiveBayesLinear:
    """Fit on a bounded sample of the labelled rows, balanced over the classes.

    ``labels(doc_id, label)`` has one row per id. Of each class the ids of ``docs`` with
    the smallest hashes are taken, ``sample_per_class`` at most; both classes weigh
    the same, so 0.5 is where a text speaks for either alike. Of rows that
    repeat an id the smallest text counts. The ids picked are at most
    ``2 * sample_per_class``, which bounds the broadcast, the one task that
    fits, and the model (``FEATURES`` weights).
    """
    # only labels of rows at hand take up places of the sample
    labels = labels.join(docs.select("doc_id"), "doc_id", "left_semi")
    ordered = [labels.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id") for c in (0, 1)]
    # an ordered limit takes the first ids of every partition and then of those: no task gets a whole class
    zero, one = (x.limit(sample_per_class).select("doc_id", "label") for x in ordered)
    picked = zero.union(one)
    texts = (
        docs.select("doc_id", whole_text().alias("text"))
        .join(F.broadcast(picked), "doc_id")
        .groupBy("doc_id", "label")
        .agg(F.min("text").alias("text"))
        .repartition(parallelism(docs.sparkSession), "doc_id")
    )
    rows = texts.select("label", features_column(F.col("text")).alias("features"))

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf["label"].to_numpy()
        sizes = {c: max(1, int((y == c).sum())) for c in (0, 1)}
        weight = np.array([len(y) / 2 / sizes[c] for c in y])
        model = fit_arrays([np.asarray(x, np.int32) for x in pdf["features"]], y, weight)
        used = np.flatnonzero(model.weights).astype("<i4")
        packed = used.tobytes(), model.weights[used].astype("<f4").tobytes()
        return pd.DataFrame([(model.intercept, *packed)], columns=["intercept", "used", "weights"])

    fitted = rows.groupBy(F.lit(0).alias("one")).applyInPandas(train, "intercept double, used binary, weights binary").first()
    if fitted is None:
        return NaiveBayesLinear(np.zeros(FEATURES, np.float32), 0.0)
    weights = np.zeros(FEATURES, np.float32)
    weights[np.frombuffer(bytes(fitted["used"]), "<i4")] = np.frombuffer(bytes(fitted["weights"]), "<f4")
    return NaiveBayesLinear(weights, float(fitted["intercept"]))


def score_column(spark: SparkSession, model: NaiveBayesLinear, text: Column) -> Column:
    """Scores of texts; the model is broadcast (``FEATURES`` weights of four bytes)."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        local = shared.value
        for texts in batches:
            found = (local.score(x) for x in features_of([t or "" for t in texts]))
            yield pd.Series(np.fromiter(found, dtype=np.float64, count=len(texts)))

    return run(text)


def toxicity(docs: DataFrame, labels: DataFrame, train: Column) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs``.

    ``labels`` has doc_id and toxic; ``train`` says of a label row whether it may
    be learned from. Defined cases: null texts count as empty, and a text
    without words scores by the intercept alone; rows that repeat an id are
    scored each; null labels and ids teach nothing; with one class or no labels
    every text scores the smoothed share of label 1; other columns are ignored.
    """
    model = fit(docs, toxicity_labels(labels).where(train))
    scored = docs.select("doc_id", score_column(docs.sparkSession, model, whole_text()).alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
