import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelforge.llm import packing
from tests.llm.data import awkward, empty, from_texts, tokens


def check(rows, expected, lengths):
    """Every token once, bins within their length, no gap, no overlap, and no shorter permitted length would do."""
    spans, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        spans[(r.doc_id, r.copy)].append((r.first_token, r.n_tokens))
        bins[r.bin_id].append(r)
    assert sorted(((d, sum(n for _, n in s)) for (d, _), s in spans.items()), key=str) == sorted(expected, key=str)
    for s in spans.values():
        s.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and s[0][0] == 0
    for b in bins.values():
        b.sort(key=lambda r: r.bin_offset)
        at = 0
        for r in b:
            assert r.bin_offset == at
            at += r.n_tokens
        assert {r.bin_used for r in b} == {at}
        assert {r.bin_length for r in b} == {min(x for x in lengths if x >= at)}


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = packing.best_fit_packing(docs, lengths=(8, 16, 64)).collect()
    exp = [(r.doc_id, tokens(r.text)) for r in docs.collect() if r.text and tokens(r.text)]
    check(rows, exp, (8, 16, 64))


def test_empty_table(spark):
    assert packing.best_fit_packing(empty(spark)).collect() == []


@pytest.mark.parametrize("shard_pieces", [20_000, 40])
def test_random_texts(spark, shard_pieces):
    random.seed(9)
    texts = ["w " * random.choice([1, 3, 30, 90, 400]) for _ in range(300)]
    rows = packing.best_fit_packing(from_texts(spark, texts), lengths=(32, 64, 128), shard_pieces=shard_pieces).collect()
    check(rows, [(i, len(t.split())) for i, t in enumerate(texts)], (32, 64, 128))


def plain_best_fit(sizes, length):
    rooms = []
    for s in sizes:
        fits = [i for i, r in enumerate(rooms) if r >= s]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= s
        else:
            rooms.append(length - s)
    return len(rooms)


def test_one_length_is_plain_best_fit():
    rng = np.random.default_rng(3)
    for _ in range(20):
        sizes = np.sort(rng.integers(1, 101, 200))[::-1]
        bins, _, final = packing.pack(sizes, (100,))
        assert len(final) == plain_best_fit(sizes.tolist(), 100)


def test_several_lengths_waste_less_than_the_longest_alone():
    rng = np.random.default_rng(8)
    sizes = np.sort(np.minimum(rng.geometric(0.004, 3000), 2048))[::-1]
    _, _, several = packing.pack(sizes, (256, 512, 1024, 2048))
    _, _, one = packing.pack(sizes, (2048,))
    assert sizes.sum() / sum(several) > 0.97
    assert sum(several) <= sum(one)


def test_expected_fill_is_greedy():
    rest = packing._Expected(np.array([50, 30, 30, 20]), (100,))
    assert rest.filled(10, 100) == 10 + 50 + 30
    rest.take(50)
    assert rest.filled(10, 100) == 10 + 30 + 30 + 20


def test_unspaced_runs_count_by_characters(spark):
    texts = ["x" * 16, "x" * 17, "漢" * 40_000, "a " * 3, "\U0001f600" * 33, ""]
    got = {r.doc_id: r.n for r in from_texts(spark, texts).select("doc_id", packing.word_count(F.col("text")).alias("n")).collect()}
    assert got == {i: tokens(t) for i, t in enumerate(texts)} == {0: 1, 1: 2, 2: 2500, 3: 3, 4: 3, 5: 0}
