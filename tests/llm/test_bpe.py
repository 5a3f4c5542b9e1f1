import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelforge.llm import bpe as bpe_module
from labelforge.llm.bpe import BytePairTokenizer, MergeReplay
from tests.llm.data import ROWS, awkward, empty

PATHS = [public_tokenizers.path(n) for n in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken")]


def library(path):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module", params=PATHS)
def pair(request):
    return MergeReplay(open(request.param, "rb").read()), library(request.param)


def ids_of(replay, text):
    return np.frombuffer(replay.encode([text], regex.compile(public_tokenizers.PATTERN))[0], "<u4").tolist()


@given(text=st.text(max_size=80))
@settings(max_examples=200, deadline=None)
def test_any_text_equals_the_library(pair, text):
    replay, exp = pair
    text = text.encode("utf-8", "ignore").decode()
    ids = ids_of(replay, text)
    assert ids == exp.encode_ordinary(text)
    assert replay.decode(np.array(ids, "<u4").tobytes()) == text.encode()


def test_joined_tokens_equal_the_library(pair):
    """Texts made of vocabulary entries are full of merges that compete."""
    replay, exp = pair
    random.seed(4)
    words = [t.decode("utf-8", "ignore") for t in random.sample(sorted(replay.ranks), 4000)]
    for n in (1, 2, 5):
        for _ in range(300):
            text = "".join(random.choice(words) for _ in range(n))
            assert ids_of(replay, text) == exp.encode_ordinary(text)
    text = "aaaaaaaaabababab" * 500 + " " * 999 + "\n" * 77 + "é" * 333
    assert ids_of(replay, text) == exp.encode_ordinary(text)


def test_lower_ranked_merges_that_open_late():
    """Ranks under which a merge opens one of lower rank: the piece is redone one merge at a time."""
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"ab", b"ca", b"abcab"]
    ranks = b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens))
    replay = MergeReplay(ranks)
    for text in (b"abcabc", b"cabcab", b"aabcbabc", b"abab"):
        assert replay.replay([text])[0] == replay.one_by_one(text)


def test_columns_on_awkward_rows(spark):
    bpe, exp = BytePairTokenizer(spark, PATHS[0], public_tokenizers.PATTERN), library(PATHS[0])
    coded = awkward(spark).select("doc_id", bpe.encode(F.col("text")).alias("ids"))
    rows = coded.select("doc_id", "ids", bpe.decode(F.col("ids")).alias("decoded")).collect()

    def digest(text):
        return None if text is None else hashlib.sha256(np.array(exp.encode_ordinary(text), "<u4").tobytes()).hexdigest()

    got = [
        (r.doc_id, None if r.ids is None else hashlib.sha256(r.ids).hexdigest(), None if r.decoded is None else bytes(r.decoded).decode())
        for r in rows
    ]
    assert sorted(got, key=str) == sorted(((r[0], digest(r[1]), r[1]) for r in ROWS), key=str)


def test_empty_table(spark):
    bpe = BytePairTokenizer(spark, PATHS[0], public_tokenizers.PATTERN)
    assert empty(spark).select(bpe.decode(bpe.encode(F.col("text"))).alias("x")).collect() == []


def test_one_step_over_several_runs(spark):
    """Texts beyond one run of characters in a batch: slices come back in order."""
    bpe, exp = BytePairTokenizer(spark, PATHS[0], public_tokenizers.PATTERN), library(PATHS[0])
    rows = [(i, None if i == 3 else f"row {i} é " * (90_000 if i % 2 else 3)) for i in range(8)]
    coded = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = coded.select("doc_id", bpe.encode_and_decode(F.col("text")).alias("c")).select("doc_id", "c.*").collect()
    for r in sorted(got):
        text = dict(rows)[r.doc_id]
        if text is None:
            assert r.ids is None and r.decoded is None
        else:
            assert bytes(r.decoded).decode() == text
            assert bytes(r.ids) == np.array(exp.encode_ordinary(text), "<u4").tobytes()


def test_tables_stay_within_their_bytes():
    replay = MergeReplay(open(PATHS[0], "rb").read())
    pattern = regex.compile(public_tokenizers.PATTERN)
    old, bpe_module.MEMORY_BYTES = bpe_module.MEMORY_BYTES, 100_000
    try:
        for i in range(40):
            text = " ".join(f"w{i}x{k}" for k in range(100))
            assert replay.decode(replay.encode([text], pattern)[0]) == text.encode()
            assert replay.held <= 100_000 + 400 * 230
    finally:
        bpe_module.MEMORY_BYTES = old
