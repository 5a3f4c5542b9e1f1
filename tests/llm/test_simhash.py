import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelforge.llm import simhash
from tests.llm.data import ROWS, awkward, empty, from_texts


def plain(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, fps, radius):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [least.get(root(i)) for i in range(len(ids))]


def check(df, rows, radius=4):
    ids, fps = [r[0] for r in rows], [plain(r[1]) for r in rows]
    exp = sorted(zip(ids, [f"{f:016x}" for f in fps], components(ids, fps, radius)), key=str)
    assert sorted((tuple(r) for r in df.collect()), key=str) == exp


def test_awkward_rows_match_brute_force(spark):
    check(simhash.simhash_components(awkward(spark)), ROWS)


def test_empty_table(spark):
    assert simhash.simhash_components(empty(spark)).collect() == []


def _near_copies():
    random.seed(7)
    words = [f"w{i}" for i in range(300)]
    base = [[random.choice(words) for _ in range(120)] for _ in range(12)]
    texts = []
    for b in base:
        for _ in range(6):
            c = list(b)
            for _ in range(random.randint(0, 2)):
                c[random.randrange(len(c))] = random.choice(words)
            texts.append(" ".join(c))
    return texts


@pytest.mark.parametrize("shard_size", [4096, 2])
def test_near_copies_match_brute_force(spark, shard_size):
    """Parts of two fingerprints force every shard to be split into cells."""
    texts = _near_copies()
    got = simhash.simhash_components(from_texts(spark, texts), shard_size=shard_size)
    check(got, list(enumerate(texts)))


@given(st.text(alphabet="aB \t\n\x85é漢.", max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain(text)


@given(st.lists(st.integers(0, 255), max_size=40), st.integers(0, 255), st.integers(0, 8))
@settings(max_examples=100, deadline=None)
def test_tree_search(values, value, radius):
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    assert sorted(tree.search(value, radius)) == sorted({v for v in values if (v ^ value).bit_count() <= radius})


def test_links_of_dense_random_fingerprints(spark):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = []
    for c in centres:
        for _ in range(8):
            flips = rng.choice(64, rng.integers(0, 6), replace=False)
            fps.append(int(c) ^ sum(1 << int(b) for b in flips))
    fps = sorted(set(fps))
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    links = [(int(np.int64(r.u).view(np.uint64)), int(np.int64(r.v).view(np.uint64))) for r in simhash.fingerprint_links(df).collect()]
    assert all((u ^ v).bit_count() <= 4 for u, v in links)
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in links:
        parent[root(u)] = root(v)
    exp = components(list(range(len(fps))), fps, 4)
    got = [root(f) for f in fps]
    assert len(set(zip(got, exp))) == len(set(got)) == len(set(exp))


def test_keep_one_per_component(spark):
    docs = awkward(spark)
    kept = simhash.keep_one_per_component(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    named = [i for i in ids if i is not None]
    found = {r.doc_id: r.component_id for r in simhash.simhash_components(docs).where(F.col("doc_id").isNotNull()).collect()}
    assert sorted(named) == sorted({c for c in found.values()})
    assert ids.count(None) == 2
