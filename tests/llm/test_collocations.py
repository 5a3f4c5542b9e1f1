import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from labelforge.llm import collocations as C
from tests.llm.data import awkward, empty

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_count, max_words=5, top=2000, share=100):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    out = {}
    cand = {p: a for p, a in f.items() if a >= min_count and len(p[1]) > 1}
    around = Counter()
    for (lang, q), b in cand.items():
        for k in range(2, len(q)):
            for i in range(len(q) - k + 1):
                around[lang, q[i : i + k]] = max(around[lang, q[i : i + k]], b)
    for (lang, p), a in cand.items():
        if 100 * around[lang, p] >= share * a:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted(
        (lang, i, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0])
        for lang, found in out.items()
        for i, x in enumerate(sorted(found)[:top], 1)
    )


def texts(seed, n=60):
    rng = random.Random(seed)
    words = ["The", "of", "a", "Ünï", "漢字", "red", "fox", "x", "y"]
    fixed = ["New York City hall", "in the long run of things", "one Two"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randrange(60))]
        text = "".join(p + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", "\x0b"]) for p in parts)
        rows.append((rng.choice(["en", "en", "de", None, "und"]), text))
    return rows + [(None, None), ("en", ""), ("fr", "of a of a"), ("en", "the of " * 3000)] + rows[:3]


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize(
    "options", [{}, {"block_words": 50, "shard_phrases": 3}, {"top": 4, "contained_share": 60, "max_words": 2, "shard_phrases": 1}]
)
def test_matches_brute_force(spark, options):
    rows = texts(len(options))
    df = spark.createDataFrame([(lang, text, 1, 2) for lang, text in rows], "lang string, text string, n int, id int")
    got = found(C.collocations(df, min_count=5, **options))
    exp = brute(rows, 5, options.get("max_words", 5), options.get("top", 2000), options.get("contained_share", 100))
    assert got == exp and len(got) > 10


def test_production_parameters_on_small_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.lang, r.text) for r in df.select("lang", "text").collect()]
    out = C.collocations(df)
    assert [f"{n} {t}" for n, t in out.dtypes] == ["lang string", "rank bigint", "phrase string", "a bigint", "l bigint", "r bigint", "n bigint", "score bigint"]
    assert found(out) == brute(rows, 100) != []


def test_awkward_and_empty_tables(spark):
    docs = awkward(spark)
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert found(C.collocations(docs, min_count=2)) == brute(rows, 2)
    assert found(C.collocations(docs, min_count=10**6)) == []
    assert found(C.collocations(empty(spark))) == []


def test_scores_past_64_bits(spark):
    counts = spark.createDataFrame([("en", "a", 1, 3 * 10**9), ("en", "b", 1, 2 * 10**9), ("en", "a b", 2, 10**9)], "lang string, phrase string, n_words int, f long")
    sizes = spark.createDataFrame([("en", 7 * 10**12)], "lang string, n long")
    old, C.phrase_counts = C.phrase_counts, lambda *a, **k: (counts, sizes)
    try:
        got = found(C.collocations(None))
    finally:
        C.phrase_counts = old
    assert got == [("en", 1, "a b", 10**9, 3 * 10**9, 2 * 10**9, 7 * 10**12, 1000 * 10**9 * 7 * 10**12 // (6 * 10**18))]


def test_double_array_accepts_exactly_its_phrases():
    rng = random.Random(3)
    phrases = sorted({tuple(rng.randrange(10**12) if rng.random() < 0.1 else rng.randrange(40) for _ in range(rng.randint(2, 5))) for _ in range(800)})
    trie = C.double_array([np.array(p, np.int64) for p in phrases])
    ids = np.unique(np.concatenate([np.array(p) for p in phrases]))
    number = {x: i + 1 for i, x in enumerate(ids.tolist())}
    text = [number[x] for _ in range(300) for x in (*rng.choice(phrases), *rng.choice(phrases), -1) if x >= 0]
    codes = np.array(text, np.int32)
    seen = Counter()
    for _, states in C.advance(codes, ids, trie, 5):
        for k in trie[3][states]:
            if k >= 0:
                seen[phrases[k]] += 1
    words = [int(ids[c - 1]) for c in text]
    exp = Counter(p for k in range(2, 6) for i in range(len(words) - k + 1) if (p := tuple(words[i : i + k])) in set(phrases))
    assert seen == exp


def test_a_task_holds_few_possible_candidates():
    """Six million places in one task: what it gathers and sums at a time stays below 150 MB."""
    rng = np.random.default_rng(5)
    ids = np.arange(1 << 16)

    def blocks():
        for _ in range(24):
            codes = rng.integers(1, len(ids) + 1, 1 << 18).astype(np.int32)
            yield pd.DataFrame([(C._pack(codes), C._pack(ids), None)], columns=["codes", "ids", "marks"])

    tracemalloc.start()
    total = 0
    for message in C._extensions(1, 4)(blocks()):
        total += sum(int(C._unplanes(x).sum()) for x in message["counts"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == 24 * ((1 << 18) - 1)
    assert peak < 150e6


@pytest.mark.parametrize("most, messages", [(1 << 12, [0]), (3, [0, 3])])
def test_a_task_tells_the_counts_of_a_trie_in_few_messages(monkeypatch, most, messages):
    monkeypatch.setattr(C, "MESSAGE_PHRASES", most)
    phrases = [np.array(p, np.int64) for p in ((10, 20), (20, 30), (10, 20, 30), (30, 10), (30, 30))]
    ids = np.array([10, 20, 30])
    rows = pd.DataFrame([(C._pack(np.array(c, np.int32)), C._pack(ids), None) for c in ([1, 2, 3, 0, 1, 2], [2, 3, 1])], columns=["codes", "ids", "marks"])

    class Packed:
        value = [(7, *map(C._pack, (*C.double_array(phrases), np.arange(100, 105))))]

    told = pd.concat(C._count(Packed, 5)(iter([rows])))
    assert told["at"].tolist() == messages and set(told["shard"]) == {7}
    twice = pd.concat(C._added(iter([told, told])))
    out = pd.concat(C._by_phrase(iter([twice.assign(ids=[C._pack(np.arange(100, 105))] * len(twice))])))
    assert out.values.tolist() == [[100, 4], [101, 4], [102, 2], [103, 2], [104, 0]]
