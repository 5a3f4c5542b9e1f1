import math
import zlib
from collections import Counter

import numpy as np
import pytest

from labelforge.llm import language_model as M
from tests.llm.data import LONG, PROSE, ROWS, awkward, empty, from_texts


def tokens(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    return [w for w in lowered.split(" ") if w] + [None]


def fold(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7


def brute(rows):
    """Counts, weights and scores straight from the definition."""
    train = [tokens(t) for d, t in rows if fold(d) != 2]
    held = [tokens(t) for d, t in rows if fold(d) == 3]
    uni = Counter(w for t in train for w in t)
    bi = Counter((v, w) for t in train for v, w in zip([None, *t], t))
    n, types = sum(uni.values()), len(uni)
    capped = [(min(c, M.LEAVE_ONE_CAP), c) for c in uni.values()]
    a = M.learn_weight(
        np.array([(c - 1) / max(1, n - 1) * (types + 1) for c, _ in capped]), np.array([float(k) for _, k in capped])
    ) if n else 0.0
    return uni, bi, n, types, a, held


def test_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in ROWS]
    uni, bi, n, types, a, _ = brute(rows)
    got = sorted((r for r in M.interpolated_scores(awkward(spark)).collect()), key=lambda r: (str(r.doc_id), r.n_tokens, r.score))
    exp = sorted(((d, tokens(t)) for d, t in rows), key=lambda r: (str(r[0]), len(r[1])))
    assert len(got) == len(exp)
    for r, (d, t) in zip(got, exp):
        assert (r.doc_id, r.n_tokens, r.train_tokens, r.held_out) == (d, len(t), n, fold(d) == 2)
        assert r.n_known == sum(uni[w] > 0 for w in t)
        assert r.base_score == pytest.approx(sum(math.log10((uni[w] + 1) / (n + types + 1)) for w in t))
        assert math.isfinite(r.score) and r.score <= 1e-9


def _corpus():
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(60)]
    return [" ".join(words[int(x)] for x in np.minimum(rng.geometric(0.08, rng.integers(1, 80)), 59)) for _ in range(120)]


@pytest.mark.parametrize("block_chars", [M.BLOCK_CHARS, 300])
def test_scores_match_the_definition(spark, block_chars):
    """Weights and scores from plain counts; each weight-fold block is deleted from the counts while held out."""
    texts = _corpus()
    rows = list(enumerate(texts))
    uni, bi, n, types, a, held = brute(rows)

    got = {r.doc_id: r for r in M.interpolated_scores(from_texts(spark, texts).coalesce(1), block_chars).collect()}
    # one partition: the weight-fold rows in order, cut where their characters reach the block size
    run, size, runs = [], 0, []
    for d, t in rows:
        if fold(d) == M.WEIGHT_FOLD:
            run.append(tokens(t))
            size += len(t)
            if size >= block_chars:
                runs.append(run)
                run, size = [], 0
    runs += [run] if run else []
    bins = Counter()
    for run in runs:
        own1 = Counter(w for t in run for w in t)
        own2 = Counter((v, w) for t in run for v, w in zip([None, *t], t))
        for t in run:
            for v, w in zip([None, *t], t):
                c = uni[v] - own1[v]
                if c <= 0:
                    continue
                p1 = a * (uni[w] - own1[w]) / max(1, n - sum(own1.values())) + (1 - a) / (types + 1)
                ratio = (bi[v, w] - own2[v, w]) / c / p1
                bins[min(int(math.log2(c)), 15), round(math.log(ratio) / M.RATIO_STEP) if ratio > 0 else None] += 1
    value = lambda q: 0.0 if q is None else math.exp(q * M.RATIO_STEP)
    arrays = lambda items: (np.array([value(q) for (_, q), _ in items]), np.array([float(k) for _, k in items]))
    pooled = M.learn_weight(*arrays(list(bins.items())))
    weight = {b: pooled for b in range(16)}
    for b in {b for b, _ in bins}:
        weight[b] = M.learn_weight(*arrays([x for x in bins.items() if x[0][0] == b]), pooled)
    for d, t in rows:
        exp = 0.0
        t = tokens(t)
        for v, w in zip([None, *t], t):
            p1 = a * uni[w] / n + (1 - a) / (types + 1)
            b = weight[min(int(math.log2(uni[v])), 15)] if uni[v] else 0.0
            exp += math.log10(b * bi[v, w] / max(1, uni[v]) + (1 - b) * p1)
        assert got[d].score == pytest.approx(exp, rel=1e-6)


def test_empty_table(spark):
    assert M.interpolated_scores(empty(spark)).collect() == []


def test_no_training_rows(spark):
    ids = [i for i in range(200) if fold(i) == 2][:3]
    df = spark.createDataFrame([(i, PROSE) for i in ids], "doc_id long, text string")
    for r in M.interpolated_scores(df).collect():
        assert (r.train_tokens, r.n_known, r.base_score, r.score) == (0, 0, 0.0, 0.0)


def test_weight_learning_finds_the_best_mixture():
    rng = np.random.default_rng(2)
    ratio, n = rng.lognormal(0, 2, 300), rng.integers(1, 50, 300).astype(float)
    w = M.learn_weight(ratio, n)
    like = lambda x: (n * np.log(x * ratio + 1 - x)).sum()
    assert like(w) >= max(like(x) for x in np.linspace(0.001, 0.999, 999)) - 1e-6


def test_packed_keys():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 1000, dtype=np.uint64))
    assert (M.unpack_sorted(M.pack_sorted(keys)) == keys).all()
    assert len(M.unpack_sorted(M.pack_sorted(keys[:0]))) == 0


def test_long_text_is_one_block(spark):
    got = {r.doc_id: r for r in M.interpolated_scores(from_texts(spark, [LONG, LONG + " x", PROSE], first=20)).collect()}
    assert got[20].n_tokens == 40_001
    assert all(math.isfinite(r.score) for r in got.values())


def test_held_out_texts_score_above_the_base(spark):
    got = M.interpolated_scores(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).toPandas()
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


def _exact_weight(counts):
    c = np.array(counts, dtype=float)
    return M.learn_weight((c - 1) / (c.sum() - 1) * (len(c) + 1), c)


def test_unigram_weight_of_frequent_words(spark):
    """Counts far above LEAVE_ONE_CAP; words unknown to training tell a apart: each is worth (1 - a) / (V + 1)."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(40) for _ in range(1500 + 400 * i)]
    rng.shuffle(words)
    rows = [(i, " ".join(words[s : s + 5000])) for i, s in zip((i for i in range(999) if fold(i) != 2), range(0, len(words), 5000))]
    rows += [(i, f"rare{i} rare{i}b") for i in range(1000, 1100) if fold(i) != 2]
    one, two = [i for i in range(2000, 2100) if fold(i) == 2][:2]
    rows += [(one, "new newer"), (two, "new newer newest")]
    uni = Counter(w for d, t in rows if fold(d) != 2 for w in tokens(t))
    assert sum(uni.values()) / len(uni) > M.LEAVE_ONE_CAP
    exact = _exact_weight(list(uni.values()))

    got = {r.doc_id: r.score for r in M.interpolated_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    a = 1 - 10 ** (got[two] - got[one]) * (len(uni) + 1)
    assert exact > 0.99 and 1 - a == pytest.approx(1 - exact, rel=1e-3)


def test_count_bins_do_not_clip():
    counts = np.unique(np.concatenate([np.arange(1, 5000), np.logspace(3, 15, 4000).astype(np.int64)]))
    bins = M.count_bins(counts)
    assert (np.diff(bins) >= 0).all() and bins[-1] < 10_000 and M.count_bins(np.array([2**63 - 1]))[0] < 10_000
    _, place, types = np.unique(bins, return_inverse=True, return_counts=True)
    mean = (np.bincount(place, weights=counts) / types)[place]
    assert np.abs(mean / counts - 1).max() < M.LEAVE_ONE_STEP * 1.01
    for scale in (1, 10, 1000):
        zipf = np.maximum(1, (scale * 50_000 / np.arange(1, 20_000)).astype(np.int64))
        _, place, types = np.unique(M.count_bins(zipf), return_inverse=True, return_counts=True)
        assert M.unigram_weight(types.astype(float), np.bincount(place, weights=zipf)) == pytest.approx(_exact_weight(zipf), rel=1e-4)
