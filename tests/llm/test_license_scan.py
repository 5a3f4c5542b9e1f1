import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelforge.llm import license_scan as L
from tests.llm.data import ROWS, awkward, empty, from_texts

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(lowered)
    places = []
    for phrase, label in PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    at = [i for i, _ in places]
    labels = ",".join(sorted({x for _, x in places}))
    return len(words), len(at), min(at, default=None), max(at, default=None), labels


def digest(df):
    found = df.select("doc_id", L.license_scan(F.col("text")).alias("f"))
    return found.select("doc_id", *[c.alias(n) for n, c in L.license_labels(F.col("f")).items()]).collect()


def ungated(joined):
    """Every rule on the whole text, and the quadratic definition of suppression."""
    ordered = L.rules()
    found = [(m.start(), m.end(), n) for n, r in enumerate(ordered) for m in r.pattern.finditer(joined)]
    rank = lambda d: (-ordered[d[2]].priority, d[0] - d[1], d[0], d[2])
    kept = []
    for d in sorted(found, key=rank):
        if not any(k[0] <= d[0] and d[1] <= k[1] for k in kept):
            kept.append(d)
    return sorted(kept)


SAMPLES = [
    "Licensed under the Apache License, Version 2.0 (the \"License\"). http://www.apache.org/licenses/LICENSE-2.0",
    "SPDX-License-Identifier: MIT\nCopyright (c) 2020-2021 Someone. All rights reserved.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3",
    "GNU Lesser General Public License version 2.1, CC BY-NC-SA 4.0, CC-BY 3.0, cc by cc by, creativecommons.org/licenses/by/4.0/",
    "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "Released into the public domain. Released under the terms of the Mozilla Public License v2.0 or the GPLv2 or gpl",
    "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "provided on an as is basis without warranties or conditions of any kind",
    "nothing of the kind, mit organ orgel commons",
    "general public license general public license all rights reserved all rights reserved",
]


def test_hundreds_of_rules_each_with_its_keyword():
    assert len(L.rules()) > 250
    names = [r.name for r in L.rules()]
    assert len(set(names)) == len(names)


def test_every_rule_matches_its_own_words_and_only_with_its_keyword():
    """A text made from a rule's pattern (first alternative, options taken and left) matches and holds the keyword."""
    for rule in L.rules():
        hits = 0
        for text in _texts_of(rule.pattern.pattern):
            if rule.pattern.search(f" {text} "):
                hits += 1
                assert rule.keyword in f" {text} ", (rule, text)
        assert hits, rule


def _texts_of(pattern):
    body = pattern.removeprefix("(?<= )").removesuffix("(?= )")
    return _expand(re._parser.parse(body))


def _expand(parsed):
    out = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            options = [chr(arg)]
        elif name == "IN":
            first = arg[0]
            options = [chr(first[1] if str(first[0]) == "LITERAL" else first[1][0] if str(first[0]) == "RANGE" else ord("1"))]
        elif name == "BRANCH":
            options = [t for branch in arg[1] for t in _expand(branch)]
        elif name == "SUBPATTERN":
            options = _expand(arg[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, _, inner = arg
            once = _expand(inner)[:2]
            options = ([""] if low == 0 else []) + [t * max(1, low) for t in once]
        elif name == "ANY":
            options = ["x"]
        elif name == "CATEGORY":
            options = ["1"]
        else:
            raise AssertionError(name)
        out = [a + b for a in out for b in options][:64]
    return out


@pytest.mark.parametrize("text", SAMPLES)
def test_gates_and_runs_change_nothing(text):
    joined = " " + " ".join(w.decode() for w in L.words_of(text)) + " "
    assert L.detect(joined) == ungated(joined)


@given(st.lists(st.sampled_from(" ".join(SAMPLES).split()), max_size=40))
@settings(max_examples=150, deadline=None)
def test_mixed_words(words):
    text = " ".join(words)
    joined = " " + " ".join(w.decode() for w in L.words_of(text)) + " "
    assert L.detect(joined) == ungated(joined)
    found = L.scan(text)
    at = [p["word"] for p in found["places"]]
    assert (found["n_words"], len(at), min(at, default=None), max(at, default=None)) == base(text)[:4]
    plain = joined.split()
    for d in found["detections"]:
        rule = next(r for r in L.rules() if r.name == d["rule"])
        span = " " + " ".join(plain[d["first_word"] : d["last_word"] + 1]) + " "
        assert rule.pattern.search(span).span() == (1, len(span) - 1)


def test_base_columns_on_awkward_rows(spark):
    texts = [r[1] for r in ROWS] + SAMPLES
    rows = digest(from_texts(spark, texts))
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) | {""}
        assert 0.0 <= r.score <= 1.0
    labels = {texts[r.doc_id]: r.labels for r in rows}
    assert labels[SAMPLES[0]] == "apache-2.0"
    assert "mit" in labels[SAMPLES[1]] and "reserved" in labels[SAMPLES[1]]
    assert labels[SAMPLES[8]] == ""


def test_clashing_columns_and_empty_table(spark):
    assert len(digest(awkward(spark))) == len(ROWS)
    assert digest(empty(spark)) == []
