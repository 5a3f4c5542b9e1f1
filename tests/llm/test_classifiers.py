import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelforge.llm import queries, quality, toxicity
from labelforge.llm.common import crc_fold
from tests.llm.data import ROWS, awkward, empty, labels

SMALL = "/root/testdata/sf0.01"


def test_fold_is_crc32_of_the_id_text(spark):
    df = spark.createDataFrame([(i,) for i in (0, 7, -3, 10**12, None)], "doc_id long")
    for r in df.select("doc_id", crc_fold(7).alias("f")).collect():
        assert r.f == zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7


@pytest.mark.parametrize(
    "query, label, fold, rest, least",
    [(queries.op3_quality, "quality", 3, 1, 0.97), (queries.op2_toxicity, "toxic", 5, 0, 0.93)],
)
def test_held_out_accuracy(spark, query, label, fold, rest, least):
    got = query(spark, SMALL).toPandas()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.5)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % fold == rest for i in got.doc_id]).all()
    truth = spark.read.parquet(f"{SMALL}/labels.parquet").toPandas().set_index("doc_id")[label]
    held = got[got.held_out & got.doc_id.isin(truth.index)]
    assert (held.predicted.to_numpy() == truth[held.doc_id].to_numpy()).mean() >= least


def test_moments_and_densities_against_numpy(spark):
    rng = np.random.default_rng(1)
    d = len(quality.STATISTICS)
    x = {0: rng.normal(0, 2, (300, d)), 1: rng.normal(0.7, 1, (500, d))}
    rows = [(i + 1000 * c, v.tolist()) for c in x for i, v in enumerate(x[c])]
    stats = spark.createDataFrame(rows, "doc_id long, stats array<double>")
    marks = spark.createDataFrame([(i, i // 1000) for i, _ in rows], "doc_id long, label int")
    model = quality.fit(stats, marks, shrinkage=0.2, floor=0.0)
    pooled = sum(np.cov(x[c].T, bias=True) * len(x[c]) for c in x) / 800
    diag = np.diag(np.diag(pooled))
    probe = rng.normal(0.3, 1.5, (50, d))
    logs = []
    for c in (0, 1):
        cov = 0.8 * np.cov(x[c].T, bias=True) + 0.2 * diag
        z = probe - x[c].mean(axis=0)
        logs.append(np.log(len(x[c]) / 800) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z))
    assert np.allclose(model.score(probe), 1 / (1 + np.exp(logs[0] - logs[1])))


def _plain_ngrams(text):
    out = set()
    for word in set(text.lower().split()):
        marked = "\x02" + word + "\x03"
        out |= {marked[i : i + n] for n in toxicity.NGRAMS for i in range(len(marked) - n + 1)}
    return out


def test_features_are_the_distinct_ngrams():
    texts = ["", "one", "Größe größe XY", "same same words words", "a\tbc\n漢字 text of several words"]
    found = list(toxicity.features_of(texts))
    for text, f in zip(texts, found):
        assert len(f) == len(set(f.tolist())) == len(_plain_ngrams(text))
    assert set(found[1]) == set(next(toxicity.features_of(["one one ONE"])))


def test_runs_do_not_change_features(monkeypatch):
    random.seed(2)
    texts = [" ".join(random.choice(["abc", "defgh", "ij", "klmnopq"]) + str(random.randrange(50)) for _ in range(30)) for _ in range(40)]
    whole = [sorted(f.tolist()) for f in toxicity.features_of(texts)]
    monkeypatch.setattr(toxicity, "RUN_CHARS", 100)
    assert [sorted(f.tolist()) for f in toxicity.features_of(texts)] == whole


MARKS = [(1, 1, 0), (2, 0, 1), (3, None, None), (4, 1, 1), (5, 0, 0), (None, 1, 1), (1, 1, 0), (99, 1, 1)]


@pytest.mark.parametrize("run, which", [(quality.quality, "quality"), (toxicity.toxicity, "toxic")])
def test_awkward_rows(spark, run, which):
    always = F.lit(True)
    for marks in (MARKS, [(1, 1, 1), (2, 1, 1)], []):
        got = run(awkward(spark), labels(spark, marks), always).collect()
        assert sorted((r.doc_id for r in got), key=str) == sorted((r[0] for r in ROWS), key=str)
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert run(empty(spark), labels(spark, MARKS), always).collect() == []


def test_one_class_gives_the_share(spark):
    got = quality.quality(awkward(spark), labels(spark, [(1, 1, 1), (2, 1, 1)]), F.lit(True)).collect()
    assert len({round(r.score, 9) for r in got}) == 1 and got[0].score > 0.5


def test_scores_ignore_other_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(200)
    marks = spark.read.parquet(f"{SMALL}/labels.parquet")
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    for run in (quality.quality, toxicity.toxicity):
        a, b = (sorted(map(tuple, run(x, marks, F.lit(True)).collect())) for x in (docs, other))
        assert a == b


def test_labels_of_absent_documents_take_no_places(spark):
    every = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, label int")
    kept = [r.doc_id for r in every.orderBy(F.xxhash64("doc_id").desc()).limit(40).collect()]  # the last to be picked
    docs = spark.createDataFrame([(i, "awful nasty words" if i % 2 else "kind pleasant words") for i in kept], "doc_id long, text string")
    got = toxicity.fit(docs, every, 20)
    exp = toxicity.fit(docs, every.where(F.col("doc_id").isin(kept)), 20)
    assert exp.weights.any() and (got.weights == exp.weights).all() and got.intercept == exp.intercept


def plain_features(text):
    """Hashed n-grams of a text, one at a time."""
    found = set()
    for word in text.lower().split():
        marked = f"\x02{word}\x03"
        for n in toxicity.NGRAMS:
            for i in range(len(marked) - n + 1):
                h = n
                for ch in marked[i : i + n]:
                    h = ((h ^ ord(ch)) * 0x9E3779B97F4A7C15) % 2**64
                    h ^= h >> 29
                found.add((h >> 7) % toxicity.FEATURES)
    return found


def test_toxicity_fit_and_score_against_dense_newton():
    rng = random.Random(12)
    words = [["awful", "hateful", "stupid", "Über", "x"], ["kindly", "garden", "weather", "漢字漢字漢字", "y"]]
    y = np.array([rng.random() < 0.4 for _ in range(90)]).astype(int)
    texts = [" ".join(rng.choice(words[rng.random() < (0.85 if c == 0 else 0.2)]) for _ in range(rng.randrange(1, 9))) for c in y]
    rows = list(toxicity.features_of(texts))
    plain = [plain_features(t) for t in texts]
    assert [set(r.tolist()) for r in rows] == plain and all(len(r) == len(set(r.tolist())) for r in rows)
    weight = np.array([len(y) / 2 / (y == c).sum() for c in y])
    model = toxicity.fit_arrays(rows, y, weight)

    one, zero = int(y.sum()), int((1 - y).sum())
    smooth = toxicity.SMOOTHING * zero / len(y), toxicity.SMOOTHING * one / len(y)
    ratio = {}
    for f in set().union(*plain):
        a, b = (sum(f in x for x, c in zip(plain, y) if c == k) for k in (1, 0))
        r = np.log((a + smooth[1]) / (one + smooth[1])) - np.log((b + smooth[0]) / (zero + smooth[0]))
        if a + b >= toxicity.MIN_DOCUMENTS and abs(r) >= toxicity.MIN_RATIO:
            ratio[f] = r
    names = sorted(ratio)
    x = np.array([[ratio[f] * (f in p) for f in names] + [1.0] for p in plain])
    ridge = np.diag([toxicity.RIDGE] * len(names) + [0.0])
    w = np.zeros(len(names) + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + ridge, x.T @ (weight * (p - y)) + ridge @ w)
    assert set(np.flatnonzero(model.weights).tolist()) <= set(names) and len(names) > 20
    got = np.array([model.score(r) for r in rows])
    assert np.abs(got - 1 / (1 + np.exp(-x @ w))).max() < 5e-3
