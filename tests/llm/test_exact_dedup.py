import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from labelforge.llm.exact_dedup import chunks, exact_dedup
from tests.llm.data import ROWS, awkward, empty, from_texts


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        kept = False
        for i in sorted(ids, key=lambda x: (x is None, x)):
            stays = i == keep and not kept
            kept |= stays
            out.append((i, keep, len(ids), stays, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_awkward_rows_match_brute_force(spark):
    assert rows_of(exact_dedup(awkward(spark))) == brute([(r[0], r[1]) for r in ROWS])


def test_empty_table(spark):
    assert exact_dedup(empty(spark)).collect() == []


def _texts(seed=3):
    random.seed(seed)
    words = ["alpha", "beta.", "gamma\n", "delta ", "épsilon!", "zeta"]
    base = [" ".join(random.choice(words) for _ in range(random.choice([3, 40, 400]))) for _ in range(30)]
    out = base + [b.replace(" ", " \t ") for b in base[:10]] + [b + " tail" for b in base[10:20]] + base[:5]
    random.shuffle(out)
    return out


@pytest.mark.parametrize("chunking", [{}, {"min_chunk": 8, "max_chunk": 32}, {"min_chunk": 1, "max_chunk": 1}])
def test_matches_brute_force_at_any_chunk_size(spark, chunking):
    texts = _texts()
    assert rows_of(exact_dedup(from_texts(spark, texts), **chunking)) == brute(list(enumerate(texts)))


def test_clashing_chunk_hashes_are_told_apart(spark):
    """With three hash values nearly all chunks clash; identifiers must still be verified."""
    texts = _texts(5)
    got = exact_dedup(from_texts(spark, texts), min_chunk=8, max_chunk=32, chunk_hash=lambda c: F.pmod(F.xxhash64(c), F.lit(3)))
    assert rows_of(got) == brute(list(enumerate(texts)))


def test_chunks_join_to_the_text_and_survive_an_edit(spark):
    text = " ".join(f"Sentence number {i} has its own words." for i in range(400))
    edited = text.replace("number 200 ", "number two hundred ")
    a, b = (r["c"] for r in from_texts(spark, [text, edited]).orderBy("doc_id").select(chunks(F.col("text")).alias("c")).collect())
    assert "".join(a) == text and "".join(b) == edited
    assert len(set(a) & set(b)) >= len(a) // 2
