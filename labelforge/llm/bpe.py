"""Byte-level BPE encoding and decoding by merge replay.

A text is cut into pieces by the tokenizer's pattern. The distinct pieces of a
run of documents are laid out as one linked row of byte symbols, with an
inverted index from token pair to the positions where it stands. The merges are
then replayed in rank order: each takes its positions from the index and
touches only the left and right neighbour of every merged pair. So a piece is
encoded once however often the corpus repeats it, and a merge costs its
occurrences, not a pass over the words. Runs are bounded by characters, and the
tables of encoded pieces and of known merges by bytes, so memory doesn't grow
with a partition. Encoding and decoding are one step, so a core keeps one worker
with one vocabulary.

The vocabulary is read once on the driver and broadcast: a rank file has a
fixed size, which is checked against ``MAX_VOCABULARY_BYTES``.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: A rank file above this size is refused rather than broadcast.
MAX_VOCABULARY_BYTES = 64 << 20

#: Characters of text whose pieces are replayed together.
RUN_CHARS = 1 << 21

#: Bytes of encoded pieces, and pairs with their merges, that a worker remembers; beyond it a table starts afresh.
MEMORY_BYTES = 128 << 20
MEMORY_PAIRS = 1 << 18

#: Bytes that an entry of the table of pieces takes besides its piece and ids, about.
_ENTRY_BYTES = 220


class MergeReplay:
    """Encodes distinct pieces by replaying merges over an inverted pair index."""

    def __init__(self, rank_file: bytes) -> None:
        lines = (line.split() for line in rank_file.splitlines() if line.strip())
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self._merge_of: dict[tuple[int, int], int] = {}
        self.pieces: dict[str, bytes] = {}
        self.held = 0

    def merge_of(self, pair: tuple[int, int]) -> int:
        """The id that a pair merges to, or -1."""
        found = self._merge_of.get(pair)
        if found is None:
            if len(self._merge_of) >= MEMORY_PAIRS:
                self._merge_of.clear()
            found = self._merge_of[pair] = self.ranks.get(self.tokens[pair[0]] + self.tokens[pair[1]], -1)
        return found

    def one_by_one(self, piece: bytes) -> list[int]:
        """Lowest rank first, leftmost first, on one piece."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        while len(ids) > 1:
            found = [(r, i) for i, pair in enumerate(zip(ids, ids[1:])) if (r := self.merge_of(pair)) >= 0]
            if not found:
                break
            rank, i = min(found)
            ids[i : i + 2] = [rank]
        return ids

    def replay(self, pieces: list[bytes]) -> list[list[int]]:
        """Token ids of each piece."""
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        data = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(data)
        symbol = data.tolist()
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
            if e > s:
                left[s] = right[e - 1] = -1
        index: dict[tuple[int, int], list[int]] = {}
        waiting: dict[int, list[tuple[int, int]]] = {}
        if n > 1:
            inside = np.ones(n - 1, dtype=bool)
            inside[starts[1:-1][(starts[1:-1] > 0) & (starts[1:-1] < n)] - 1] = False
            at = np.flatnonzero(inside)
            keys = (data[at] << 32) | data[at + 1]
            order = np.argsort(keys, kind="stable")
            keys, at = keys[order], at[order]
            cuts = np.flatnonzero(np.diff(keys)) + 1
            firsts = np.concatenate([[0], cuts]) if len(keys) else []
            for key, places in zip((int(keys[i]) for i in firsts), np.split(at, cuts) if len(keys) else []):
                pair = (key >> 32, key & 0xFFFFFFFF)
                if (rank := self.merge_of(pair)) >= 0:
                    index[pair] = places.tolist()
                    waiting.setdefault(rank, []).append(pair)
        heap = list(waiting)
        heapq.heapify(heap)
        odd: set[int] = set()  # pieces where a merge opened one of lower rank
        merge_of = self.merge_of
        while heap:
            rank = heapq.heappop(heap)
            pairs = waiting.pop(rank)
            places = sorted(p for pair in pairs for p in index.pop(pair))
            live = set(pairs)
            for i in places:
                j = right[i]
                if j < 0 or (symbol[i], symbol[j]) not in live:
                    continue
                after, before = right[j], left[i]
                symbol[i], symbol[j] = rank, -1
                right[i], right[j] = after, -1
                if after >= 0:
                    left[after] = i
                for at, pair in ((before, before >= 0 and (symbol[before], rank)), (i, after >= 0 and (rank, symbol[after]))):
                    if not pair:
                        continue
                    opened = merge_of(pair)
                    if opened < 0:
                        continue
                    if opened <= rank:
                        odd.add(bisect_right(starts, i) - 1)
                        continue
                    known = index.get(pair)
                    if known is None:
                        index[pair] = [at]
                        if opened in waiting:
                            waiting[opened].append(pair)
                        else:
                            waiting[opened] = [pair]
                            heapq.heappush(heap, opened)
                    else:
                        known.append(at)
        bounds = starts.tolist()
        out = [[x for x in symbol[s:e] if x >= 0] for s, e in zip(bounds, bounds[1:])]
        for k in odd:
            out[k] = self.one_by_one(pieces[k])
        return out

    def learn(self, pieces: Iterable[str]) -> None:
        """Encode the pieces that aren't known yet; a piece that is a token itself is that token."""
        fresh = [p for p in pieces if p not in self.pieces]
        coded = [p.encode("utf-8") for p in fresh]
        todo = [k for k, b in enumerate(coded) if b not in self.ranks]
        ids: list[list[int]] = [[self.ranks[b]] if b in self.ranks else [] for b in coded]
        for k, found in zip(todo, self.replay([coded[k] for k in todo])):
            ids[k] = found
        for piece, found in zip(fresh, ids):
            self.pieces[piece] = np.array(found, dtype="<u4").tobytes()
            self.held += _ENTRY_BYTES + len(piece) + 4 * len(found)

    def encode(self, texts: list[str], pattern: regex.Pattern) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [pattern.findall(t) for t in texts]
        if self.held > MEMORY_BYTES:
            self.pieces.clear()
            self.held = 0
        self.learn(dict.fromkeys(p for pieces in cut for p in pieces))
        known = self.pieces
        return [b"".join([known[p] for p in pieces]) for pieces in cut]

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


_LOADED: dict[bytes, MergeReplay] = {}


def _loaded(rank_file: bytes) -> MergeReplay:
    """One table per worker process and vocabulary; it lives on through the worker's tasks."""
    key = hashlib.sha256(rank_file).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = MergeReplay(rank_file)
    return _LOADED[key]


class BytePairTokenizer:
    """Column functions for one vocabulary.

    ``path`` names a rank file on the driver (base64 token and rank per line);
    ``pattern`` is the regular expression that cuts texts into pieces.
    """

    def __init__(self, spark: SparkSession, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            ranks = f.read(MAX_VOCABULARY_BYTES + 1)
        if len(ranks) > MAX_VOCABULARY_BYTES:
            raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
        self._ranks = spark.sparkContext.broadcast(ranks)
        self._pattern = pattern

    def _coded(self, texts: Iterator[pd.Series], decode: bool) -> Iterator[tuple[list, list]]:
        """(ids, decoded bytes) of runs of texts of about RUN_CHARS characters; they needn't match the batches."""
        replay, pattern = _loaded(self._ranks.value), regex.compile(self._pattern)
        for batch in texts:
            held: list[str | None] = []
            size = 0
            for place, text in enumerate(batch, 1):
                held.append(text)
                size += len(text or "")
                if size >= RUN_CHARS or place == len(batch):
                    found = replay.encode([t or "" for t in held], pattern)
                    ids = [None if t is None else x for t, x in zip(held, found)]
                    yield ids, [None if x is None else replay.decode(x) for x in ids] if decode else []
                    held, size = [], 0

    def encode(self, text: Column) -> Column:
        """Binary column: the ids as little-endian unsigned 32-bit integers. Null gives null, empty gives none."""
        coded = self._coded

        @F.pandas_udf("binary")
        def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for ids, _ in coded(texts, False):
                yield pd.Series(ids, dtype=object)

        return run(text)

    def encode_and_decode(self, text: Column) -> Column:
        """Struct column (ids, decoded): the ids as by ``encode``, and the bytes that they decode to (null for null)."""
        coded = self._coded

        @F.pandas_udf("ids binary, decoded binary")
        def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for ids, decoded in coded(texts, True):
                yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series(decoded, dtype=object)})

        return run(text)

    def decode(self, ids: Column) -> Column:
        """Binary column: the bytes that the ids stand for (null gives null)."""
        ranks = self._ranks

        @F.pandas_udf("binary")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            replay = _loaded(ranks.value)
            for column in batches:
                yield pd.Series([None if x is None else replay.decode(x) for x in column], dtype=object)

        return run(ids)
