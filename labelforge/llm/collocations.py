"""Phrase collocation mining with broadcast double-array tries.

Texts become blocks of word numbers. A block knows its distinct words, so words
are counted and numbered once a block, not once an occurrence. Words below the
minimum count turn into breaks: by the Apriori rule no candidate holds them. The
other words' ids reach the blocks by broadcasts of bounded size.

Candidates grow word by word. Where two candidates of k - 1 words overlap in
k - 2, the text holds a possible candidate of k words; a task sends its distinct
ones with their counts to ranges of their hashes, which add them up, so that only
phrases that can reach the minimum count enter a trie: the pairs that merely
occur are about as many as the text's words. Tries are built in tasks, each for a
bounded number of phrases, and broadcast a bounded number at a time; numpy
advances the states of all positions of a block together, one word a step. After
each length the blocks shrink to the words that some candidate covers.

A last pass over the shrunken blocks counts all lengths at once: positions
advance through every shard of the trie, accepting states are counted by
``bincount``. A task tells the counts of a shard's phrases in packed messages, and
those about the same phrases are added up one by one. These are the counts that the
scores use. Scores and the containment rule are DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelforge.llm.common import parallelism, store, whole_text

#: Least occurrences of a candidate phrase.
MIN_COUNT = 100

#: Words of the longest phrase.
MAX_WORDS = 5

#: Rows returned per language.
TOP = 2000

#: A candidate goes if a longer one around it has so many hundredths of its count.
CONTAINED_SHARE = 100

#: Words of text in one block, and phrases in one trie.
BLOCK_WORDS = 1 << 18
SHARD_PHRASES = 1 << 16

#: Tries that are broadcast together; each has at most MAX_WORDS * SHARD_PHRASES states.
ROUND_SHARDS = 8

#: Phrases of a trie whose counts travel in one message.
MESSAGE_PHRASES = 1 << 12

#: Frequent words that are broadcast together, about.
ROUND_WORDS = 1 << 19

#: Possible candidates that a task gathers before it sends them, and words of text for one range of them.
MESSAGE_KEYS = 1 << 19
RANGE_WORDS = 1 << 21

_ROWS = 1 << 17

# What ends a piece, and the language of rows that name none.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
NO_LANG = "und"

_BREAK = b"\xff"  # in no UTF-8 text
_MARKED = bytes.maketrans(PIECE_ENDS + b"\t", _BREAK * len(PIECE_ENDS) + b" ")


def words_of(text: str) -> list[bytes]:
    """The words of a text with A-Z lowered; ``_BREAK`` between pieces."""
    return text.encode("utf-8").lower().translate(_MARKED).replace(_BREAK, b" " + _BREAK + b" ").split()


def _pack(numbers: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(numbers).tobytes(), 1)


def _unpack(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), dtype=kind)


class _Numbers(dict):
    """Numbers the words of one language from a counter that all languages of a block share; breaks are 0."""

    def __init__(self, lang: str, words: list) -> None:
        super().__init__({_BREAK: 0})
        self.lang, self.words = lang, words

    def __missing__(self, word: bytes) -> int:
        self.words.append((self.lang, word))
        self[word] = number = len(self.words)
        return number


#: A block's codes count its words from 1; ``lang`` has the number in ``langs`` of each word's language.
_BLOCK = "codes binary, langs array<string>, lang binary, words binary, ids binary"


def _blocks(limit: int):
    """Blocks of a partition's texts; a break, code 0, stands between pieces and texts."""

    def closed(parts: list[np.ndarray], words: list) -> pd.DataFrame:
        langs = {lang: None for lang, _ in words}
        number = {lang: i for i, lang in enumerate(langs)}
        row = {
            "codes": _pack(np.concatenate(parts)),
            "langs": list(langs),
            "lang": _pack(np.array([number[lang] for lang, _ in words], dtype=np.int32)),
            "words": zstandard.compress(b"\n".join([word for _, word in words]), 1),
            "ids": None,
        }
        return pd.DataFrame([row])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, words, numbers, size = [], [], {}, 0
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                found = words_of(text)
                if not found:
                    continue
                if lang not in numbers:
                    numbers[lang] = _Numbers(lang, words)
                parts += [np.fromiter(map(numbers[lang].__getitem__, found), np.int32, len(found)), np.zeros(1, np.int32)]
                size += len(found)
                if size >= limit:
                    yield closed(parts, words)
                    parts, words, numbers, size = [], [], {}, 0
        if words:
            yield closed(parts, words)

    return run


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, word, n): each word of a block once."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            words = zstandard.decompress(row.words).decode("utf-8").split("\n")
            lang = np.array(list(row.langs), dtype=object)[_unpack(row.lang, "<i4")]
            n = np.bincount(_unpack(row.codes, "<i4"), minlength=len(words) + 1)[1:]
            for at in range(0, len(words), _ROWS):
                yield pd.DataFrame({"lang": lang[at : at + _ROWS], "word": words[at : at + _ROWS], "n": n[at : at + _ROWS]})


def _trimmed(codes: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Places that stay: the kept words, and one break wherever something went."""
    stay = keep.copy()
    stay[1:] |= keep[:-1]  # the place after a kept run becomes its break
    return np.flatnonzero(stay)


def _look_up(packed):
    """Corpus ids of a block's words, -1 for those of no round so far."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, dict[bytes, int]] = {}
        langs, words, numbers = packed.value
        for lang, word, number in zip(langs, words.split(b"\n"), _unpack(numbers, "<i8").tolist()):
            known.setdefault(lang, {})[word] = number
        for batch in batches:
            for i, row in enumerate(batch.itertuples(index=False)):
                words = zstandard.decompress(row.words).split(b"\n")
                ids = np.full(len(words), -1, np.int64) if row.ids is None else _unpack(row.ids, "<i8").copy()
                of_lang = [known.get(lang, {}) for lang in row.langs]
                found = [of_lang[k].get(word, -1) for k, word in zip(_unpack(row.lang, "<i4").tolist(), words)]
                batch.at[batch.index[i], "ids"] = _pack(np.maximum(ids, found))
            yield batch

    return run


def _numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A block's frequent words by their corpus ids; other words become breaks."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            codes, ids = _unpack(row.codes, "<i4"), _unpack(row.ids, "<i8")
            places = np.flatnonzero(ids >= 0)
            order = places[np.argsort(ids[places])]
            new = np.zeros(len(ids) + 1, dtype=np.int32)
            new[order + 1] = np.arange(1, len(order) + 1)
            codes = new[codes]
            codes = codes[_trimmed(codes, codes > 0)]
            yield pd.DataFrame([(_pack(codes), _pack(ids[order]), None)], columns=["codes", "ids", "marks"])


#: ``codes`` index ``ids`` from 1; ``marks`` holds at each place the id of the candidate that starts there, or -1.
#: Without marks the candidates are the words themselves.
_CODED = "codes binary, ids binary, marks binary"


def _planes(numbers: np.ndarray) -> bytes:
    """Compressed bytes, the first of all numbers before the second of all: high ones repeat."""
    return zstandard.compress(np.ascontiguousarray(np.ascontiguousarray(numbers, "<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unplanes(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(bytes(data)), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def _summed(phrase: np.ndarray, word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair once, in order, with its sum."""
    order = np.lexsort((word, phrase))
    phrase, word, n = phrase[order], word[order], n[order]
    del order
    first = np.flatnonzero(np.concatenate([[True], (phrase[1:] != phrase[:-1]) | (word[1:] != word[:-1])]))
    return phrase[first], word[first], np.add.reduceat(n, first)


def _block_extensions(row, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(phrases, words, counts): each possible candidate of a block once, with its occurrences there.

    The candidate at a place grows by the word after it if the candidate of the
    same length one place on, which ends with that word, stands there too.
    """
    codes, ids = _unpack(row.codes, "<i4"), _unpack(row.ids, "<i8")
    if len(codes) <= length:
        return None
    if row.marks is None:
        here = np.flatnonzero((codes[:-1] > 0) & (codes[1:] > 0))
        known, phrase = ids, codes[here].astype(np.int64) - 1
    else:
        marks = _unpack(row.marks, "<i8")
        here = np.flatnonzero((marks[:-length] >= 0) & (marks[1 : len(marks) - length + 1] >= 0) & (codes[length:] > 0))
        known, phrase = np.unique(marks[here], return_inverse=True)
    pairs, n = np.unique(phrase * (len(ids) + 1) + codes[here + length], return_counts=True)
    first, then = np.divmod(pairs, len(ids) + 1)
    return (known[first], ids[then - 1], n) if len(pairs) else None


def _extensions(length: int, ranges: int):
    """Messages of a task's possible candidates to ranges of their hashes."""

    def sent(held: list[tuple]) -> pd.DataFrame:
        phrase, word, n = _summed(*(np.concatenate(x) for x in zip(*held)))
        mixed = (phrase.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ word.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
        to = ((mixed >> np.uint64(33)) % np.uint64(ranges)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[order], np.arange(ranges + 1))
        rows = [
            (r, _planes(phrase[order[s:e]]), _planes(word[order[s:e]]), _planes(n[order[s:e]]))
            for r, (s, e) in enumerate(zip(cuts[:-1], cuts[1:]))
            if e > s
        ]
        return pd.DataFrame(rows, columns=["range", "phrases", "words", "counts"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                found = _block_extensions(row, length)
                if found is None:
                    continue
                held.append(found)
                size += len(found[0])
                if size >= MESSAGE_KEYS:
                    yield sent(held)
                    held, size = [], 0
        if held:
            yield sent(held)

    return run


def _support(min_count: int):
    """The candidates of one range that reach the minimum count."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        phrase, word, n = _summed(*(np.concatenate([_unplanes(x) for x in pdf[c]]) for c in ("phrases", "words", "counts")))
        kept = n >= min_count
        return pd.DataFrame({"phrase": phrase[kept], "word": word[kept]})

    return run


def double_array(phrases: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, base, check, accept) of the distinct phrases.

    The child of state s by symbol c (from 1, the place in the sorted
    ``symbols``) is base[s] + c if check there is s. State 0 is the root;
    ``accept`` holds the phrase's number at the states where one ends, else -1.
    """
    symbols = np.unique(np.concatenate(phrases)) if phrases else np.empty(0, np.int64)
    children: list[dict[int, int]] = [{}]
    ends: dict[int, int] = {}
    for number, phrase in enumerate(phrases):
        node = 0
        for c in (np.searchsorted(symbols, phrase) + 1).tolist():
            found = children[node].get(c)
            if found is None:
                found = children[node][c] = len(children)
                children.append({})
            node = found
        ends[node] = number
    width = len(symbols) + 1
    used = np.zeros(2 * (len(children) + width), bool)
    used[0] = True
    state, offsets = {0: 0}, {}
    free, filling = 1, False
    # nodes with many children first, each beyond the one before; single children then fill the gaps
    for node in sorted(range(len(children)), key=lambda k: (k != 0, -len(children[k]))):
        own = np.fromiter(children[node], np.int64, len(children[node]))
        if not len(own):
            break
        if len(own) == 1 and not filling:
            filling, free = True, 1
        offset = free - int(own.min()) if node else 0
        while True:
            if int(own.max()) + offset + width >= len(used):
                used = np.concatenate([used, np.zeros(len(used), bool)])
            if offset >= 0 and not used[own + offset].any():
                break
            offset += 1
        free = max(free, int(own.min()) + offset)
        used[own + offset] = True
        offsets[node] = offset
        for c, child in children[node].items():
            state[child] = c + offset
    top = max(state.values()) + 1
    base, check, accept = np.zeros(top, np.int32), np.full(top, -1, np.int32), np.full(top, -1, np.int64)
    for node, offset in offsets.items():
        base[state[node]] = offset
        for child in children[node].values():
            check[state[child]] = state[node]
    for node, number in ends.items():
        accept[state[node]] = number
    return symbols, base, check, accept


_TRIE = "shard long, symbols binary, base binary, check binary, accept binary, ids binary"


def _trie(pdf: pd.DataFrame) -> pd.DataFrame:
    symbols, base, check, accept = double_array([np.asarray(w, dtype=np.int64) for w in pdf["words"]])
    row = [int(pdf["shard"].iloc[0]), *map(_pack, (symbols, base, check, accept, pdf["id"].to_numpy()))]
    return pd.DataFrame([row], columns=["shard", "symbols", "base", "check", "accept", "ids"])


def advance(codes: np.ndarray, ids: np.ndarray, trie: tuple, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """After each of up to ``words`` steps: the places still inside the trie and their states."""
    symbols, base, check, _ = trie
    at = np.searchsorted(symbols, ids)
    known = at < len(symbols)
    known[known] = symbols[at[known]] == ids[known]
    symbol = np.concatenate([[0], np.where(known, at + 1, 0)]).astype(np.int32)[codes]
    places = np.flatnonzero(symbol).astype(np.int32)
    states = np.zeros(len(places), np.int32)
    for step in range(words):
        inside = places + step < len(codes)
        places, states = places[inside], states[inside]
        c = symbol[places + step]
        states_next = base[states] + c
        fits = (c > 0) & (states_next < len(check))
        fits[fits] = check[states_next[fits]] == states[fits]
        places, states = places[fits], states_next[fits]
        yield places, states


def _opened(packed: list[tuple]) -> list[tuple]:
    """(symbols, base, check, accept, ids) of the tries of a round."""
    kinds = ("<i8", "<i4", "<i4", "<i8", "<i8")
    return [tuple(_unpack(x, k) for x, k in zip(row, kinds)) for _, *row in packed]


def _mark(packed, words: int, last: bool):
    """Candidates of ``words`` words that start at each place; after the last round, blocks shrink to what they cover."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tries = _opened(packed.value)
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                codes, ids = _unpack(row.codes, "<i4"), _unpack(row.ids, "<i8")
                marks = _unpack(row.marks, "<i8").copy() if row.marks is not None else np.full(len(codes), -1, np.int64)
                for *trie, numbers in tries:
                    for places, states in advance(codes, ids, trie, words):
                        pass
                    found = trie[3][states]
                    marks[places[found >= 0]] = numbers[found[found >= 0]]
                if last:
                    covered = np.zeros(len(codes) + words, bool)
                    for step in range(words):
                        covered[np.flatnonzero(marks >= 0) + step] = True
                    covered = covered[: len(codes)]
                    stay = _trimmed(codes, covered)
                    codes, marks = np.where(covered, codes, 0)[stay].astype(np.int32), marks[stay]
                out.append((_pack(codes), row.ids, _pack(marks)))
            yield pd.DataFrame(out, columns=["codes", "ids", "marks"])

    return run


#: The counts of the phrases of a trie from the number ``at`` on.
_TOLD = "shard long, at int, counts binary"


def _count(packed, words: int):
    """Messages of the occurrences in a task's blocks of a trie's phrases, MESSAGE_PHRASES each, in the order of their numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tries = _opened(packed.value)
        counts = [np.zeros(len(base), np.int64) for _, base, *_ in tries]
        for batch in batches:
            for row in batch.itertuples(index=False):
                codes, ids = _unpack(row.codes, "<i4"), _unpack(row.ids, "<i8")
                for n, (*trie, _) in zip(counts, tries):
                    for _, states in advance(codes, ids, trie, words):
                        n += np.bincount(states, minlength=len(n))
        for (shard, *_), n, (*trie, numbers) in zip(packed.value, counts, tries):
            ends = np.flatnonzero((n > 0) & (trie[3] >= 0))
            if len(ends):
                of_phrase = np.zeros(len(numbers), np.int64)
                of_phrase[trie[3][ends]] = n[ends]
                parts = [(shard, at, of_phrase[at : at + MESSAGE_PHRASES]) for at in range(0, len(numbers), MESSAGE_PHRASES)]
                yield pd.DataFrame([(s, at, _planes(x)) for s, at, x in parts if x.any()], columns=["shard", "at", "counts"])

    return run


def _added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The messages about the same phrases added up, one after another."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for shard, at, counts in zip(batch["shard"].tolist(), batch["at"].tolist(), batch["counts"]):
            n = _unplanes(counts)
            sums[shard, at] = sums[shard, at] + n if (shard, at) in sums else n
    for (shard, at), n in sums.items():
        yield pd.DataFrame([(shard, at, _planes(n))], columns=["shard", "at", "counts"])


def _by_phrase(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, f) of the phrases of a summed message, from the ids of their trie."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            n = _unplanes(row.counts)
            yield pd.DataFrame({"id": _unpack(row.ids, "<i8")[row.at : row.at + len(n)], "f": n})


def _tries(phrases: DataFrame, shard_phrases: int) -> DataFrame:
    """One row per trie over ``phrases(id, words)``; a hash deals the phrases out."""
    shards = max(1, -(-phrases.count() // shard_phrases))
    dealt = phrases.select("id", "words", F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"))
    return store(dealt.groupBy("shard").applyInPandas(_trie, _TRIE), "tries")


def _vocabularies(words: DataFrame) -> Iterator[tuple]:
    """Broadcasts of about ROUND_WORDS words each, at least one, and whether it is the last one."""
    rounds = max(1, -(-words.count() // ROUND_WORDS))
    for number in range(rounds):
        rows = words.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == number).select("lang", "word", "id").toPandas()
        data = rows["lang"].tolist(), "\n".join(rows["word"]).encode("utf-8"), _pack(rows["id"].to_numpy(np.int64))
        yield words.sparkSession.sparkContext.broadcast(data), number + 1 == rounds


def _rounds(tries: DataFrame) -> Iterator[tuple]:
    """Broadcasts of at most ROUND_SHARDS tries each, and whether it is the last one."""
    numbers = sorted(r["shard"] for r in tries.select("shard").collect())
    for first in range(0, len(numbers), ROUND_SHARDS):
        group = numbers[first : first + ROUND_SHARDS]
        rows = tries.where(F.col("shard").isin(group)).collect()
        packed = [(r["shard"], *map(bytes, (r["symbols"], r["base"], r["check"], r["accept"], r["ids"]))) for r in rows]
        yield tries.sparkSession.sparkContext.broadcast(packed), first + ROUND_SHARDS >= len(numbers)


def phrase_counts(
    docs: DataFrame,
    min_count: int = MIN_COUNT,
    max_words: int = MAX_WORDS,
    block_words: int = BLOCK_WORDS,
    shard_phrases: int = SHARD_PHRASES,
) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, n_words, f) of words and candidates, (lang, n) of all word occurrences)."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), whole_text().alias("text"))
    blocks = store(rows.mapInPandas(_blocks(block_words), _BLOCK), "phrase-blocks")
    each = blocks.mapInPandas(_word_counts, "lang string, word string, n long")
    totals = store(each.groupBy("lang", "word").agg(F.sum("n").alias("f")), "phrase-words")
    sizes = totals.groupBy("lang").agg(F.sum("f").alias("n"))
    words = store(totals.where(F.col("f") >= min_count).select(F.monotonically_increasing_id().alias("id"), "lang", "word", "f"), "frequent-words")
    for packed, last in _vocabularies(words):
        known = blocks.mapInPandas(_look_up(packed), _BLOCK)
        if last:
            coded = store(known.select("codes", "ids").mapInPandas(_numbered, _CODED), "coded-blocks")
        else:
            blocks = store(known, "phrase-blocks")
        packed.destroy()

    grown = words.select("id", F.array("id").alias("words"), "lang", F.col("word").alias("phrase"))
    all_words = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    ranges = max(parallelism(docs.sparkSession), -(-all_words // RANGE_WORDS))
    levels, covered = [], None
    for length in range(1, max_words):
        sent = coded.mapInPandas(_extensions(length, ranges), "range long, phrases binary, words binary, counts binary")
        support = sent.groupBy("range").applyInPandas(_support(min_count), "phrase long, word long")
        last = words.select(F.col("id").alias("word"), F.col("word").alias("ending"))
        found = (
            support.join(grown.withColumnRenamed("phrase", "start").withColumnRenamed("id", "phrase"), "phrase")
            .join(last, "word")
            .select(
                (F.monotonically_increasing_id() * max_words + length).alias("id"),
                F.concat("words", F.array("word")).alias("words"),
                "lang",
                F.concat_ws(" ", "start", "ending").alias("phrase"),
            )
        )
        grown = store(found, "phrase-candidates")
        levels.append(grown.withColumn("n_words", F.lit(length + 1)))
        if length + 1 < max_words:
            coded = coded.withColumn("marks", F.lit(None).cast("binary"))
            unmarked = coded
            for packed, done in _rounds(_tries(grown, shard_phrases)):
                coded = store(coded.mapInPandas(_mark(packed, length + 1, done), _CODED), "marked-blocks")
                packed.destroy()
            if coded is unmarked:  # no candidates of this length
                break
            covered = coded if covered is None else covered
    candidates = reduce(DataFrame.union, levels) if levels else grown.where("false").withColumn("n_words", F.lit(0))
    unigrams = words.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("n_words"), "f")
    covered = coded if covered is None else covered
    counted = []
    tries = _tries(candidates, shard_phrases)
    for packed, _ in _rounds(tries):
        told = covered.mapInPandas(_count(packed, max_words), _TOLD).repartition("shard", "at")
        counted.append(store(told.mapInPandas(_added, _TOLD), "shard-counts"))
        packed.destroy()
    if not counted:
        return unigrams, sizes
    # a trie is in one round only
    sums = reduce(DataFrame.union, counted).join(tries.select("shard", "ids"), "shard").select("ids", "at", "counts")
    f = sums.mapInPandas(_by_phrase, "id long, f long").where(F.col("f") >= min_count)
    longer = candidates.join(f, "id").select("lang", "phrase", "n_words", "f")
    return store(unigrams.union(longer), "phrase-counts"), store(sizes, "phrase-sizes")


def _part(first: Column, last: Column) -> Column:
    """Words ``first`` to ``last`` (from 1) of the split phrase."""
    return F.concat_ws(" ", F.slice("w", first, last - first + 1))


def collocations(
    docs: DataFrame,
    min_count: int = MIN_COUNT,
    max_words: int = MAX_WORDS,
    top: int = TOP,
    contained_share: int = CONTAINED_SHARE,
    **options,
) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Defined cases: a null text is empty; a null language is ``und``, together
    with rows that say so; rows that repeat an id count each; a text of any
    length is one row of a block; ties in score and count are ordered by the
    phrase's bytes; languages without candidates, and an empty table, give no
    rows; other columns are ignored.
    """
    counts, sizes = phrase_counts(docs, min_count, max_words, **options)
    own = counts.where("n_words > 1").select("lang", "phrase", "n_words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    # a longer candidate around a shorter one has an extension of it by one word inside, with at least its count
    ends = F.explode(F.array(_part(F.lit(1), F.col("n_words") - 1), _part(F.lit(2), F.col("n_words"))))
    around = own.where("n_words > 2").select("lang", ends.alias("phrase"), F.col("a").alias("longer"))
    around = around.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = own.join(around, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < contained_share * F.col("a"))
    )
    cut = kept.select("lang", "phrase", "a", "n_words", "w", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("head"), _part(F.col("k") + 1, F.col("n_words")).alias("tail"))
    head = counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tail = counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    whole = cut.join(head, ["lang", "head"]).join(tail, ["lang", "tail"]).join(F.broadcast(sizes) if _few(sizes) else sizes, "lang")
    exact = [F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r")]
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * exact[0] * exact[1], exact[2] * exact[3])
    scored = whole.select("lang", "phrase", "a", "n", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min("cut").alias("cut"))
    out = best.select("lang", "phrase", "a", F.col("cut.l"), F.col("cut.r"), "n", F.col("cut.score"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = out.select("lang", place.cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    return ranked.where(F.col("rank") <= top)


#: Languages below this number are broadcast; beyond it the join shuffles.
BROADCAST_LANGS = 10_000


def _few(sizes: DataFrame) -> bool:
    return sizes.count() <= BROADCAST_LANGS
