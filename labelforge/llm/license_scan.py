"""License scans by ordered signature rules.

Rules are regular expressions over the text's words (A-Z in lower case, one
space between words). Each rule names a keyword; one Aho-Corasick pass finds
the keywords of a text, and only the rules they open are run. Overlaps are
resolved by priority and containment: a detection inside an accepted one of
higher priority (or of the same priority and longer) is dropped.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the contract: the phrases whose places are counted, and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Bytes that separate words: ASCII other than digits and letters.
_SEPARATORS = bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122 or 65 <= b <= 90))
_TO_SPACE = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))

#: (label, keyword, name as it is written in words, SPDX identifier in words, address in words)
LICENSES: tuple[tuple[str, str, str, str, str], ...] = (
    ("apache-2.0", "apache", r"apache (?:software )?license(?: version)? 2(?: 0)?|apache 2 0", "apache 2 0", r"apache org licenses license 2 0"),
    ("apache-1.1", "apache", r"apache (?:software )?license(?: version)? 1 1", "apache 1 1", r"apache org licenses license 1 1"),
    ("apache-1.0", "apache", r"apache (?:software )?license(?: version)? 1 0", "apache 1 0", r"apache org licenses license 1 0"),
    ("mit", "license", r"(?:the )?mit license|mit x11 license", "mit", r"opensource org licenses mit(?: license)?"),
    ("mit-0", "no attribution", r"mit no attribution", "mit 0", r"opensource org licenses mit 0"),
    ("isc", "isc license", r"isc license", "isc", r"opensource org licenses isc"),
    ("bsd-2-clause", "bsd", r"(?:simplified|freebsd|2 clause|two clause) bsd license|bsd 2 clause(?: license)?", "bsd 2 clause", r"opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:new|revised|modified|3 clause|three clause) bsd license|bsd 3 clause(?: license)?", "bsd 3 clause", r"opensource org licenses bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:original|4 clause|four clause) bsd license|bsd 4 clause(?: license)?", "bsd 4 clause", r"spdx org licenses bsd 4 clause"),
    ("bsd", "bsd", r"bsd (?:style )?license", "0bsd", r"opensource org licenses bsd license"),
    ("gpl-1.0", "general public", r"gnu general public license(?: version| v)? ?1(?: 0)?", "gpl 1 0(?: only| or later)?", r"gnu org licenses (?:old licenses )?gpl 1 0"),
    ("gpl-2.0", "general public", r"gnu general public license(?: as published by the free software foundation)?(?: either)?(?: version| v) ?2(?: 0)?", "gpl 2 0(?: only| or later)?", r"gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3.0", "general public", r"gnu general public license(?: as published by the free software foundation)?(?: either)?(?: version| v) ?3(?: 0)?", "gpl 3 0(?: only| or later)?", r"gnu org licenses gpl(?: 3 0)?"),
    ("gpl", "general public", r"(?:gnu )?general public license", "gpl", r"gnu org copyleft gpl"),
    ("gpl-abbreviated", "gpl", r"(?:gnu )?gpl(?:(?: version)? ?v?[123])?", "gpl v?[123]", r"gnu org licenses gpl html"),
    ("lgpl-2.0", "general public", r"gnu library general public license(?: version 2(?: 0)?)?", "lgpl 2 0(?: only| or later)?", r"gnu org licenses (?:old licenses )?lgpl 2 0"),
    ("lgpl-2.1", "general public", r"gnu lesser general public license(?: version)? 2 1", "lgpl 2 1(?: only| or later)?", r"gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-3.0", "general public", r"gnu lesser general public license(?: version)? 3(?: 0)?", "lgpl 3 0(?: only| or later)?", r"gnu org licenses lgpl 3 0"),
    ("lgpl", "general public", r"(?:gnu )?lesser general public license", "lgpl", r"gnu org licenses lgpl"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public license(?: version)?(?: 3(?: 0)?)?", "agpl 3 0(?: only| or later)?", r"gnu org licenses agpl(?: 3 0)?"),
    ("gfdl-1.3", "documentation license", r"(?:gnu )?free documentation license(?: version)?(?: 1 [123])?", "gfdl 1 [123](?: only| or later)?", r"gnu org licenses fdl(?: 1 [123])?"),
    ("mpl-1.1", "mozilla", r"mozilla public license(?: version)? 1 1", "mpl 1 1", r"mozilla org mpl 1 1|mozilla org mpl mpl 1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public license(?: version)?(?: v)? ?2 0", "mpl 2 0", r"mozilla org (?:en us )?mpl 2 0"),
    ("mpl", "mozilla", r"mozilla public license", "mpl", r"mozilla org mpl"),
    ("epl-1.0", "eclipse", r"eclipse public license(?: version)?(?: v)? ?1 0", "epl 1 0", r"eclipse org legal epl v10"),
    ("epl-2.0", "eclipse", r"eclipse public license(?: version)?(?: v)? ?2 0", "epl 2 0", r"eclipse org legal epl (?:v20|2 0)"),
    ("edl-1.0", "eclipse", r"eclipse distribution license(?: version)?(?: v)? ?1 0", "edl 1 0", r"eclipse org org documents edl v10"),
    ("cddl-1.0", "common development", r"common development and distribution license(?: version)?(?: 1 0)?", "cddl 1 0", r"opensource org licenses cddl 1 0"),
    ("cddl-1.1", "common development", r"common development and distribution license(?: version)? 1 1", "cddl 1 1", r"spdx org licenses cddl 1 1"),
    ("cpl-1.0", "common public", r"common public license(?: version)?(?: 1 0)?", "cpl 1 0", r"opensource org licenses cpl"),
    ("cpal-1.0", "common public", r"common public attribution license(?: version)?(?: 1 0)?", "cpal 1 0", r"opensource org licenses cpal 1 0"),
    ("artistic-1.0", "artistic", r"artistic license(?: version)? 1 0", "artistic 1 0", r"opensource org licenses artistic 1 0|opensource org licenses artistic license 1 0"),
    ("artistic-2.0", "artistic", r"artistic license(?: version)? 2 0", "artistic 2 0", r"opensource org licenses artistic 2 0|opensource org licenses artistic license 2 0"),
    ("artistic", "artistic", r"(?:perl )?artistic license", "artistic", r"dev perl org licenses artistic"),
    ("zlib", "zlib", r"zlib(?: libpng)? license", "zlib", r"opensource org licenses zlib(?: license)?"),
    ("libpng", "libpng", r"libpng license", "libpng(?: 2 0)?", r"libpng org pub png src libpng license"),
    ("bsl-1.0", "boost", r"boost software license(?: version)?(?: 1 0)?", "bsl 1 0", r"boost org license 1 0"),
    ("busl-1.1", "business source", r"business source license(?: version)?(?: 1 1)?", "busl 1 1", r"mariadb com bsl11"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", "unlicense", r"unlicense org"),
    ("wtfpl", "public license", r"do what the fuck you want to public license", "wtfpl", r"wtfpl net"),
    ("python-2.0", "license", r"python software foundation license(?: version 2)?|psf license", "python 2 0|psf 2 0", r"python org psf license|docs python org 3 license"),
    ("ruby", "ruby", r"ruby(?: s)? license", "ruby", r"ruby lang org en about license"),
    ("php-3.01", "php", r"php license(?: version)?(?: 3 0?1)?", "php 3 0?1", r"php net license 3 01"),
    ("postgresql", "postgresql", r"postgresql license", "postgresql", r"opensource org licenses postgresql"),
    ("openssl", "openssl", r"openssl(?: ssleay)? license", "openssl", r"openssl org source license"),
    ("curl", "curl", r"curl license", "curl", r"curl (?:haxx )?se docs copyright"),
    ("ms-pl", "microsoft", r"microsoft public license", "ms pl", r"opensource org licenses ms pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal license", "ms rl", r"opensource org licenses ms rl"),
    ("eupl-1.1", "european union", r"european union public licen[cs]e(?: version)?(?: v)? ?1 1", "eupl 1 1", r"joinup ec europa eu software page eupl"),
    ("eupl-1.2", "european union", r"european union public licen[cs]e(?: version)?(?: v)?(?: ?1 2)?", "eupl 1 2", r"joinup ec europa eu collection eupl"),
    ("osl-3.0", "open software", r"open software license(?: version)?(?: v)?(?: ?3 0)?", "osl 3 0", r"opensource org licenses osl 3 0"),
    ("afl-3.0", "academic free", r"academic free license(?: version)?(?: v)?(?: ?3 0)?", "afl 3 0", r"opensource org licenses afl 3 0"),
    ("ncsa", "ncsa", r"university of illinois ncsa open source license|ncsa open source license", "ncsa", r"opensource org licenses ncsa"),
    ("ofl-1.1", "font license", r"(?:sil )?open font license(?: version)?(?: 1 1)?", "ofl 1 1", r"scripts sil org ofl"),
    ("odbl-1.0", "database license", r"open (?:data commons open )?database license(?: version)?(?: v)?(?: ?1 0)?", "odbl 1 0", r"opendatacommons org licenses odbl"),
    ("odc-by-1.0", "open data commons", r"open data commons attribution license(?: version)?(?: v)?(?: ?1 0)?", "odc by 1 0", r"opendatacommons org licenses by"),
    ("pddl-1.0", "public domain", r"public domain dedication and license(?: version)?(?: 1 0)?", "pddl 1 0", r"opendatacommons org licenses pddl"),
    ("public-domain", "public domain", r"(?:released|dedicated|placed) (?:in|in to|into|to) the public domain|public domain dedication", "public domain", r"creativecommons org publicdomain mark 1 0"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?", "cc0 1 0", r"creativecommons org publicdomain zero 1 0"),
    ("cc-by-4.0", "cc by", r"cc by 4 0", "cc by 4 0", r"creativecommons org licenses by 4 0"),
    ("cc-by-3.0", "cc by", r"cc by 3 0", "cc by 3 0", r"creativecommons org licenses by 3 0"),
    ("cc-by-sa-4.0", "cc by", r"cc by sa(?: 4 0)?", "cc by sa 4 0", r"creativecommons org licenses by sa 4 0"),
    ("cc-by-nc-4.0", "cc by", r"cc by nc(?: 4 0)?", "cc by nc 4 0", r"creativecommons org licenses by nc 4 0"),
    ("cc-by-nd-4.0", "cc by", r"cc by nd(?: 4 0)?", "cc by nd 4 0", r"creativecommons org licenses by nd 4 0"),
    ("cc-by-nc-sa-4.0", "cc by", r"cc by nc sa(?: 4 0)?", "cc by nc sa 4 0", r"creativecommons org licenses by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "cc by", r"cc by nc nd(?: 4 0)?", "cc by nc nd 4 0", r"creativecommons org licenses by nc nd 4 0"),
    ("cc-attribution", "creative commons", r"creative commons attribution(?: (?:non ?commercial|share ?alike|no ?deriv(?:ative)?s?(?: works)?))*(?: \d \d)?(?: (?:international|unported))?(?: license)?", "cc by", r"creativecommons org licenses"),
    ("creative-commons", "creative commons", r"creative commons(?: public)? licen[cs]e", "cc", r"creativecommons org"),
    ("elastic-2.0", "elastic", r"elastic license(?: version)?(?: 2 0)?", "elastic 2 0", r"elastic co licensing elastic license"),
    ("sspl-1.0", "server side", r"server side public license(?: version)?(?: 1)?", "sspl 1 0", r"mongodb com licensing server side public license"),
    ("proprietary", "proprietary", r"proprietary (?:and confidential|license|software)|confidential and proprietary", "licenseref proprietary", r"proprietary license agreement"),
)

#: How a license may be referred to: (form, priority, confidence, pattern with the name, which field it takes).
FORMS = (
    ("spdx", 100, 0.99, r"spdx license identifier (?:{})", 3),
    ("address", 90, 0.95, r"(?:https? )?(?:www )?(?:{})", 4),
    ("grant", 80, 0.9, r"(?:licen[cs]ed|released|distributed|redistributed|available|published|provided|covered|shared) under (?:an? |the )?(?:terms (?:and conditions )?of (?:an? |the )?)?(?:{})", 2),
    ("name", 60, 0.8, r"(?:{})", 2),
)

#: Sentences of licence texts and notices: (label, keyword, pattern, priority, confidence).
NOTICES = (
    ("mit", "permission is hereby", r"permission is hereby granted free of charge to any person obtaining a copy", 70, 0.95),
    ("isc", "permission to use copy", r"permission to use copy modify and or distribute this software for any purpose", 70, 0.95),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted", 70, 0.9),
    ("bsd-3-clause", "neither the name", r"neither the name of .{1,80}? may be used to endorse or promote products", 72, 0.95),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software", 74, 0.95),
    ("gpl", "free software", r"this program is free software you can redistribute it and or modify", 70, 0.9),
    ("unlicense", "unencumbered", r"free and unencumbered software released into the public domain", 70, 0.95),
    ("zlib", "as is without any express", r"this software is provided as is without any express or implied warranty", 65, 0.7),
    ("warranty", "without warrant", r"without warrant(?:y|ies) (?:or conditions )?of any kind", 30, 0.3),
    ("warranty", "provided", r"(?:is )?provided (?:on an )?as is(?: basis)?", 20, 0.2),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)*", 40, 0.4),
    ("reserved", "all rights reserved", r"all rights reserved", 50, 0.6),
    ("reserved", "no part of this", r"no part of this (?:publication|document|book|work) may be reproduced", 50, 0.7),
    ("confidential", "confidential", r"(?:strictly |company )?confidential", 10, 0.2),
)


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    keyword: str
    pattern: re.Pattern
    priority: int
    confidence: float


def _site(address: str) -> str:
    """The literal first words of an address, at most two."""
    return re.match(r"[a-z0-9]+(?: [a-z0-9]+)?", address)[0]


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules in order: every license in every form, then the notices."""
    out = [
        Rule(
            f"{lic[0]}/{form}",
            lic[0],
            "spdx license identifier" if form == "spdx" else _site(lic[4]) if form == "address" else lic[1],
            re.compile(r"(?<= )" + shape.format(lic[field]) + r"(?= )"),
            priority,
            confidence,
        )
        for lic in LICENSES
        for form, priority, confidence, shape, field in FORMS
    ]
    out += [
        Rule(f"{label}/notice-{n}", label, keyword, re.compile(rf"(?<= )(?:{pattern})(?= )"), priority, confidence)
        for n, (label, keyword, pattern, priority, confidence) in enumerate(NOTICES)
    ]
    return tuple(out)


@lru_cache(maxsize=1)
def _gates() -> tuple[ahocorasick.Automaton, dict[str, list[int]]]:
    opened: dict[str, list[int]] = {}
    for n, rule in enumerate(rules()):
        opened.setdefault(rule.keyword, []).append(n)
    found = ahocorasick.Automaton()
    for keyword in opened:
        found.add_word(keyword, keyword)
    found.make_automaton()
    return found, opened


def words_of(text: str) -> list[bytes]:
    """Words of the text with A-Z in lower case: runs of digits, letters and non-ASCII characters."""
    return text.encode("utf-8").lower().translate(_TO_SPACE).split()


def base_places(joined: bytes) -> list[tuple[str, int]]:
    """(label, index of the first word) wherever a base phrase stands; ``joined`` has a space around every word."""
    out = []
    for phrase, label in BASE_PHRASES.items():
        needle = b" " + phrase.encode() + b" "
        at = joined.find(needle)
        seen, word = 0, 0
        while at >= 0:
            word += joined.count(b" ", seen, at)
            seen = at
            out.append((label, word))
            at = joined.find(needle, at + 1)
    return sorted(out, key=lambda x: (x[1], x[0]))


def resolve(found: list[tuple[int, int, int]], ordered: tuple[Rule, ...]) -> list[tuple[int, int, int]]:
    """Keep (start, end, rule) unless it lies inside a kept one of higher rank: priority, then length, then order."""
    kept: list[tuple[int, int, int]] = []
    for start, end, n in sorted(found, key=lambda x: (-ordered[x[2]].priority, x[0] - x[1], x[0], x[2])):
        if not any(s <= start and end <= e for s, e, _ in kept):
            kept.append((start, end, n))
    return sorted(kept)


def detect(joined: str) -> list[tuple[int, int, int]]:
    """Resolved (start, end, rule number) in characters of the joined words."""
    gate, opened = _gates()
    keywords = {keyword for _, keyword in gate.iter(joined)}
    if not keywords:
        return []
    ordered = rules()
    found = [
        (m.start(), m.end(), n)
        for n in sorted(n for k in keywords for n in opened[k])
        for m in ordered[n].pattern.finditer(joined)
    ]
    # texts that repeat a notice give many detections: resolve runs of overlapping ones apart
    out: list[tuple[int, int, int]] = []
    run: list[tuple[int, int, int]] = []
    reach = -1
    for d in sorted(found):
        if run and d[0] >= reach:
            out += resolve(run, ordered)
            run = []
        run.append(d)
        reach = max(reach, d[1])
    return out + (resolve(run, ordered) if run else [])


def scan(text: str) -> dict:
    """Words, base places and resolved detections of one text."""
    words = words_of(text)
    joined = b" " + b" ".join(words) + b" "
    ordered = rules()
    plain = joined.decode("utf-8", "replace")
    found = detect(plain) if words else []
    if found:
        spaces = [i for i, c in enumerate(plain) if c == " "]
    detections = [
        {
            "label": ordered[n].label,
            "rule": ordered[n].name,
            "first_word": bisect_right(spaces, s) - 1,
            "last_word": bisect_right(spaces, e - 1) - 1,
            "priority": ordered[n].priority,
            "confidence": ordered[n].confidence,
        }
        for s, e, n in found
    ]
    places = [{"label": label, "word": word} for label, word in base_places(joined)] if words else []
    return {"n_words": len(words), "places": places, "detections": detections}


SCHEMA = (
    "n_words long, places array<struct<label string, word long>>, detections array<struct<label string, rule string, "
    "first_word long, last_word long, priority int, confidence double>>"
)


def license_scan(text: Column) -> Column:
    """Struct column per text: n_words, places (label, word), detections (label, rule, words, priority, confidence).

    Defined cases: a null or empty text has no words, places or detections;
    repeated phrases count at each place; rules never remove a base place.
    """

    @F.pandas_udf(SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([scan(t or "") for t in texts], columns=["n_words", "places", "detections"])

    return run(text)


def license_labels(found: Column) -> dict[str, Column]:
    """Columns of the digest: n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the chance that some reference is right if each detection
    errs by itself: 1 - product of (1 - confidence).
    """
    starts = F.transform(found["places"], lambda p: p["word"])
    base = F.transform(found["places"], lambda p: p["label"])
    own = F.transform(found["detections"], lambda d: d["label"])
    joined = lambda c: F.concat_ws(",", F.array_sort(F.array_distinct(c)))
    return {
        "n_words": found["n_words"],
        "n_base": F.size(starts).cast("long"),
        "first_word": F.array_min(starts),
        "last_word": F.array_max(starts),
        "base_labels": joined(base),
        "labels": joined(F.concat(base, own)),
        "score": F.aggregate(found["detections"], F.lit(1.0), lambda a, d: a * (F.lit(1.0) - d["confidence"]), lambda a: F.lit(1.0) - a),
    }
