"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text gives a fixed vector of transformed statistics (logarithms of sizes,
arcsine roots of shares). Per class, Spark sums the moments over every labelled
training row; the class covariances are shrunk towards their pooled diagonal,
and their Cholesky factors are cached in the model. A score is the logistic of
the difference of the two Mahalanobis log densities plus the log prior odds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.llm.common import labels_of, whole_text
from labelforge.session import cut_lineage

#: Weight of the pooled diagonal in a class covariance.
SHRINKAGE = 0.1

#: Variance, in units of the pooled variance, that every direction has at least.
FLOOR = 0.02

_LOWER, _UPPER, _DIGIT, _BLANK, _BREAK, _POINT, _SYMBOL, _OTHER = range(8)
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[:128] = _SYMBOL
_CLASS[np.arange(97, 123)] = _LOWER
_CLASS[np.arange(65, 91)] = _UPPER
_CLASS[np.arange(48, 58)] = _DIGIT
_CLASS[[9, 32]] = _BLANK
_CLASS[[10, 11, 12, 13]] = _BREAK
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = _POINT

STATISTICS = (
    "log_bytes", "log_words", "log_lines", "log_word_length", "word_length_spread", "upper", "digits", "points",
    "symbols", "other", "breaks", "distinct_words", "distinct_lines", "short_words", "top_words",
)


def statistics(text: str) -> np.ndarray:
    """Transformed statistics of one text; every one is finite, also for the empty text."""
    raw = text.encode("utf-8", "replace")
    n = max(1, len(raw))
    count = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=8)
    words = raw.lower().split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    w = max(1, len(words))
    size = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    tally: dict[bytes, int] = {}
    for x in words:
        tally[x] = tally.get(x, 0) + 1
    letters = max(1, count[_LOWER] + count[_UPPER] + count[_OTHER])
    root = lambda k, of: np.arcsin(np.sqrt(min(1.0, k / of)))
    return np.array([
        np.log1p(len(raw)),
        np.log1p(len(words)),
        np.log1p(len(lines)),
        np.log1p(size.mean()),
        np.log1p(size.std()),
        root(count[_UPPER], letters),
        root(count[_DIGIT], n),
        root(count[_POINT], n),
        root(count[_SYMBOL], n),
        root(count[_OTHER], n),
        root(count[_BREAK], n),
        root(len(tally), w),
        root(len(set(lines)), max(1, len(lines))),
        root(float((size <= 3).sum()) if words else 0.0, w),
        root(max(tally.values(), default=0), w),
    ])


def statistics_column(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([statistics(t or "") for t in texts])

    return run(text)


@dataclass(frozen=True)
class QuadraticDiscriminant:
    """Class means, inverse Cholesky factors and log terms; ``score`` needs nothing else."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray  # 2 x d
    whiteners: np.ndarray  # 2 x d x d: inverses of the Cholesky factors
    offsets: np.ndarray  # log prior - half the log determinant
    prior: float  # share of label 1; all that counts when a class is missing

    @staticmethod
    def fit(
        moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float = SHRINKAGE, floor: float = FLOOR
    ) -> QuadraticDiscriminant:
        """From (rows, sums, sums of products) per label; classes of fewer than two rows count as missing."""
        have = {c: m for c, m in moments.items() if m[0] >= 2}
        total = sum(m[0] for m in moments.values())
        prior = (sum(m[0] for c, m in moments.items() if c == 1) + 1) / (total + 2)
        d = len(STATISTICS)
        zero = np.zeros((2, d))
        if len(have) < 2:
            eye = np.stack([np.eye(d)] * 2)
            odds = np.log([1 - prior, prior])
            return QuadraticDiscriminant(np.zeros(d), np.ones(d), zero, eye, odds, prior)
        rows = sum(m[0] for m in have.values())
        centre = sum(m[1] for m in have.values()) / rows
        within = sum(m[2] - np.outer(m[1], m[1]) / m[0] for m in have.values()) / rows
        scale = np.sqrt(np.maximum(np.diag(within), 1e-12))
        means, whiteners, offsets = [], [], []
        for c in (0, 1):
            k, s, ss = have[c]
            cov = (ss / k - np.outer(s / k, s / k)) / np.outer(scale, scale)
            cov = (1 - shrinkage) * cov + shrinkage * np.eye(d) + floor * np.eye(d)
            factor = np.linalg.cholesky(cov)
            means.append((s / k - centre) / scale)
            whiteners.append(np.linalg.inv(factor))
            offsets.append(np.log(k / rows) - np.log(np.diag(factor)).sum())
        return QuadraticDiscriminant(
            centre, scale, np.stack(means), np.stack(whiteners), np.array(offsets), prior
        )

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of statistics."""
        z = (x - self.centre) / self.scale
        away = [((z - m) @ w.T) for m, w in zip(self.means, self.whiteners)]
        density = [o - 0.5 * (a * a).sum(axis=1) for o, a in zip(self.offsets, away)]
        return 1.0 / (1.0 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit(stats: DataFrame, labels: DataFrame, **options) -> QuadraticDiscriminant:
    """Fit on every labelled row of ``stats(doc_id, stats)``; ``labels(doc_id, label)`` has one row per id.

    Moments are summed in Spark; the driver gets 2 * (d + 1) * (d + 2) / 2 numbers whatever the input.
    """
    d = len(STATISTICS)
    s = F.col("stats")
    first = [F.sum(s[i]).alias(f"s{i}") for i in range(d)]
    second = [F.sum(s[i] * s[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
    rows = stats.where(F.col("doc_id").isNotNull()).join(labels, "doc_id")
    moments = {}
    for row in rows.groupBy("label").agg(F.count("*").alias("n"), *first, *second).collect():
        products = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                products[i, j] = products[j, i] = row[f"p{i}_{j}"]
        moments[row["label"]] = (float(row["n"]), np.array([row[f"s{i}"] for i in range(d)]), products)
    return QuadraticDiscriminant.fit(moments, **options)


def score_column(model: QuadraticDiscriminant, stats: Column) -> Column:
    """Scores from the statistics (a model is a few kilobytes and travels with the function)."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            yield pd.Series(model.score(np.stack(column.to_numpy())) if len(column) else [], dtype="float64")

    return run(stats)


def quality_labels(labels: DataFrame) -> DataFrame:
    return labels_of(labels, "quality")


def quality(docs: DataFrame, labels: DataFrame, train: Column) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs``.

    ``labels`` has doc_id and quality; ``train`` says of a label row whether it
    may be learned from. The statistics are written once, so texts are read and
    measured once. Defined cases: null texts count as empty (all statistics are
    finite); rows that repeat an id are scored each, and count each in the
    moments if labelled; null labels and ids teach nothing; if a class has fewer
    than two rows every text scores the smoothed share of label 1; other columns
    are ignored.
    """
    stats = cut_lineage(docs.select("doc_id", statistics_column(whole_text()).alias("stats")), "statistics")
    model = fit(stats, quality_labels(labels).where(train))
    scored = stats.select("doc_id", score_column(model, F.col("stats")).alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
