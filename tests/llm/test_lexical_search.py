import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from labelforge.llm import lexical_search as S
from tests.llm.data import awkward, empty

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=20):
    docs = [(d, Counter(terms(t))) for d, t in docs]
    n = sum(1 for _, c in docs if c)
    total = sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item_id, text in items:
        asked, scored = Counter(terms(text)), []
        for doc_id, c in docs:
            score = 0
            for t, times in asked.items():
                if c[t]:
                    m = 100 - 25 + 25 * sum(c.values()) * n // total
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += times * w * (10**9 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        out += [(item_id, rank, d, -s) for rank, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("options, k", [({}, 20), ({"block_docs": 37}, 3)])
def test_matches_brute_force(spark, options, k):
    rng = random.Random(k)
    words = [f"W{i}" for i in range(60)] + ["Ünï", "漢字", "the-end", "a_b"]
    weight = [1 / (i + 1) for i in range(len(words))]
    texts = [" ".join(rng.choices(words, weight, k=rng.choice([0, 1, 5, 40, 200]))) for _ in range(250)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[7] + " w1") for i in range(40)] + [(3, texts[3]), (None, texts[9])]
    items = [(i, " ".join(rng.choices(words, weight, k=rng.choice([1, 3, 30])))) for i in range(25)] + [(90, ""), (91, None), (92, "absent"), (None, "w5 w6 w6")]
    left = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, score int, item_id int")
    right = spark.createDataFrame([(*r, 5) for r in [*items, (4, "zzz")]], "item_id long, text string, doc_id int")  # a repeated id: the smaller text counts
    got = found(S.lexical_search(left, right, k, **options))
    assert got == brute(docs, items, k) and len(got) > 50


def test_several_rounds_and_one_index(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    index = S.build_index(docs)
    whole = found(S.search(index, items))
    exp = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert whole == exp == found(S.search(index, items, round_bytes=4000))


def test_tasks_hold_a_few_blocks_at_a_time(spark, monkeypatch):
    """However many blocks a task has: it writes, reads and hands them to Python a few bytes at a time."""
    import pandas as pd
    import pyarrow.parquet as pq

    def lengths(batches):
        yield from (pd.DataFrame({"n": [len(batch)]}) for batch in batches)

    monkeypatch.setattr(S, "HELD_BYTES", 20_000, raising=False)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.createDataFrame([(i, " ".join(f"w{i * j % 997}" for j in range(60))) for i in range(600)], "doc_id long, text string").coalesce(1)
    index = S.build_index(docs, block_docs=10)
    groups = []
    for f in index.blocks.inputFiles():
        meta = pq.ParquetFile(f.removeprefix("file://")).metadata
        groups += [meta.row_group(i).num_rows for i in range(meta.num_row_groups)]
    assert sum(groups) == 60 and max(groups) <= 20
    seen = index.blocks.coalesce(1).select("terms", "masks", "maxima", "ids")
    rows = lambda: max(r.n for r in seen.mapInPandas(lengths, "n long").collect())
    whole = rows()
    with S._small_batches(spark):
        assert rows() < whole == 60
    assert spark.conf.get(key) == before
    items = [(i, f"w{i} w{2 * i}") for i in range(5)]
    got = found(S.search(index, spark.createDataFrame(items, "item_id long, text string")))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], items)


def test_awkward_and_empty_tables(spark):
    docs = awkward(spark)
    items = spark.createDataFrame([(1, "the old clock"), (2, "word5 and5 row without")], "item_id int, text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(S.lexical_search(docs, items)) == brute(rows, [(r.item_id, r.text) for r in items.collect()])
    assert found(S.lexical_search(empty(spark), items)) == [] == found(S.lexical_search(docs, items.limit(0)))


def test_treap_paths_lead_to_every_posting():
    rng = np.random.default_rng(5)
    for columns, rows in ((1, 1), (1, 9), (3, 40), (64, 10), (100, 500)):
        grid = (rng.random((rows, columns)) < 0.2) * rng.integers(1, 9, (rows, columns))
        grid[:, 0] = np.maximum(grid[:, 0], 1)
        row, column = np.nonzero(grid)
        m = rng.integers(75, 400, columns)
        treap = S.Treap.of(row, column, grid[row, column], m)
        for r in rng.integers(0, rows, 5):
            weight = np.array([7])
            best = S.search_block(treap, 1, np.array([0]), np.array([r]), weight, columns)
            c = np.flatnonzero(grid[r])
            exp = sorted(zip((-7 * S.impacts(grid[r, c], m[c])).tolist(), c.tolist()))
            assert list(zip((-best.score).tolist(), best.column.tolist())) == exp
