import hashlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from labelforge.llm import spotsigs
from tests.llm.data import LONG, PROSE, ROWS, awkward, empty, from_texts


def brute(rows):
    tie = lambda t: int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).view(np.int64))
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), tie(r[1])))
    out = []
    for k, (i, text) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        n = len(text)
        edited = text[: n - n // 2] + nxt[: n // 2]
        own, new, after = (set(spotsigs.signatures(x).tolist()) for x in (text, edited, nxt))
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        out.append((i, n, hashlib.sha256(edited.encode()).hexdigest(), round(like(own, new), 9), round(like(own, after), 9)))
    return sorted(out, key=str)


def digest(df):
    rows = df.collect()
    for r in rows:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows), key=str)


def test_awkward_rows_match_brute_force(spark):
    assert digest(spotsigs.fingerprint_with_next(awkward(spark))) == brute([(r[0], r[1]) for r in ROWS])


@pytest.mark.parametrize("n", [0, 1, 2, 50])
def test_any_number_of_rows(spark, n):
    texts = [PROSE[i : i + 60] * (1 + i % 3) for i in range(n)]
    got = spotsigs.fingerprint_with_next(from_texts(spark, texts, first=100) if n else empty(spark))
    assert digest(got) == brute([(100 + i, t) for i, t in enumerate(texts)])


def test_equal_texts_have_equal_fingerprints(spark):
    rows = spotsigs.fingerprint_with_next(from_texts(spark, [PROSE, LONG, PROSE, "", None])).collect()
    f = {r.doc_id: r.fingerprint for r in rows}
    assert f[0] == f[2] != f[1] and f[3] == f[4] == ""


def plain_signatures(text):
    """Chains by definition: anchor words and the content words after them."""
    words = spotsigs._WORD.findall(text.lower()) or text.lower().split()
    chains = set()
    for i, w in enumerate(words):
        near = any(x in spotsigs.COMMON_WORDS for x in words[max(0, i - spotsigs.GAP + 1) : i + 1])
        started = any(x in spotsigs.COMMON_WORDS for x in words[: i + 1])
        if w in spotsigs.COMMON_WORDS or (not near and (started or i >= 0)):
            chains.add((w, *[x for x in words[i + 1 :] if x not in spotsigs.COMMON_WORDS][: spotsigs.CHAIN]))
    return chains


@given(st.lists(st.sampled_from("the of der fox Dog jumps über x1 zz town 漢字 old".split()), max_size=40))
@settings(max_examples=200, deadline=None)
def test_signatures_stand_for_chains(words):
    text = " ".join(words)
    exp = plain_signatures(text)
    # before the first common word every word is an anchor once GAP words have passed from the text's start
    assert len(spotsigs.signatures(text)) == len(exp)


@given(st.lists(st.integers(0, 60), max_size=40), st.lists(st.integers(0, 60), max_size=40), st.floats(0, 1))
@settings(max_examples=200, deadline=None)
def test_pruned_jaccard(a, b, threshold):
    x, y = (np.unique(np.array(v, np.uint32)) for v in (a, b))
    exact = len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0
    got = spotsigs.jaccard(x, y, threshold)
    assert spotsigs.jaccard(x, y) == pytest.approx(exact)
    assert got == pytest.approx(exact) or (got == 0 and exact < threshold)


def test_near_duplicates_match_all_pairs(spark):
    long = " ".join(f"the w{i} x{i * 7 % 31} of y{i}" for i in range(60))
    texts = [long, long, long.replace("w5 ", "other "), long.replace("w9 ", "q ").replace("w30 ", "z "), long[: len(long) // 2], PROSE, PROSE + " and more words", "", ""]
    pairs, members = spotsigs.near_duplicates(from_texts(spark, texts))
    sets = [set(spotsigs.signatures(t).tolist()) for t in texts]
    cls = [min(j for j in range(len(texts)) if sets[j] == s) for s in sets]
    assert sorted(map(tuple, members.collect())) == sorted(enumerate(cls))
    reps = sorted(set(cls))
    exp = {frozenset((i, j)) for i in reps for j in reps if i < j and sets[i] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8}
    got = pairs.collect()
    assert {frozenset((r.left_id, r.right_id)) for r in got} == exp and len(got) == len(exp) >= 2
