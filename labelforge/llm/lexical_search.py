"""Ranked lexical search with K2-treaps over term-document grids.

Documents become blocks. A block's grid has a row per term, the most frequent
first, and a column per document, by ascending id. It is stored as a forest of
square quadtrees: a node is the four bits that say which of its quarters hold a
posting, and the greatest impact below it, rounded up to a byte. Leaves hold the
term's occurrences, from which the impact follows exactly. Children stand in
Morton order, so a running count of the bits finds them.

A search follows, for each item, the paths of all its terms' rows together: a
document range's bound is the weighted sum of its cells' maxima, ranges are opened
best first, and one whose bound is below the item's k-th score so far is left
closed. Numpy takes the cells of all items of a round at a step. Every block hands
on its best k per item, and a window merges them.

The index is written once to the shared checkpoint folder and doesn't depend on
the items, which are broadcast in rounds of bounded size.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelforge.llm.common import store, whole_text

# Fixed values of the ranking.
IMPACT_UNIT = 1_000_000_000
LENGTH_BASE = 75
LENGTH_SHARE = 25

#: Documents returned per item.
TOP = 20

#: A block's documents and characters, at most (one longer text is a block of its own).
BLOCK_DOCS = 4096
BLOCK_CHARS = 1 << 24

#: Bytes of item texts that are broadcast together, about.
ROUND_BYTES = 4 << 20

#: Bytes of stored blocks, or of texts, that a task reads or hands to Python at a time (one larger row alone).
HELD_BYTES = 8 << 20

#: Levels above the documents at which ranges are ordered, and ranges opened per item and step.
RANGE_LEVELS = 6
RANGES_AT_ONCE = 2

#: Items that are searched together in a block.
ITEMS_AT_ONCE = 256

#: Unit of the stored maxima; impacts stay below 256 of them.
MAXIMUM_UNIT = 4096

_SPACED = bytes.maketrans(
    bytes(b for b in range(128) if not chr(b).isalnum()), b" " * sum(not chr(b).isalnum() for b in range(128))
)


def terms_of(text: str) -> list[bytes]:
    """Maximal runs of digits, letters and characters beyond ASCII, with A-Z lowered."""
    return text.encode("utf-8").lower().translate(_SPACED).split()


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (IMPACT_UNIT * tf) // (1000 * tf + 12 * m)


def _pack(numbers: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(numbers).tobytes(), 1)


def _unpack(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(bytes(data)), dtype=kind)


def _spread(x: np.ndarray, height: int) -> np.ndarray:
    """Bit i moves to bit 2 i."""
    out = np.zeros_like(x)
    for i in range(height):
        out |= ((x >> i) & 1) << (2 * i)
    return out


_POPCOUNT = np.array([bin(i).count("1") for i in range(16)], dtype=np.int64)


def grid(row: np.ndarray, column: np.ndarray, tf: np.ndarray, columns: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The quadtrees' nodes by level, and the occurrences in Morton order."""
    height = max(1, int(columns - 1).bit_length())
    inside = (1 << height) - 1
    code = (row >> height) << (2 * height) | _spread(row & inside, height) << 1 | _spread(column, height)
    order = np.argsort(code)
    code, tf = code[order], tf[order]
    masks = []
    for _ in range(height):
        parent = code >> 2
        starts = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
        masks.append(np.bitwise_or.reduceat((1 << (code & 3)).astype(np.uint8), starts))
        code = parent[starts]
    return masks[::-1], tf


@dataclass
class Treap:
    """The grid of one block. Level 0 holds the roots, one for each 2**height rows; the last level the postings."""

    height: int
    masks: list[np.ndarray]
    maxima: list[np.ndarray]
    tf: np.ndarray
    m: np.ndarray

    @staticmethod
    def of(row: np.ndarray, column: np.ndarray, tf: np.ndarray, m: np.ndarray) -> Treap:
        """From the distinct cells (row, column) with their occurrences; every row up to the last has a cell."""
        masks, tf = grid(row, column, tf, len(m))
        return Treap.over(masks, tf, m)

    @staticmethod
    def over(masks: list[np.ndarray], tf: np.ndarray, m: np.ndarray) -> Treap:
        """The maxima over a grid's postings."""
        code = np.arange(len(masks[0]), dtype=np.int64)
        starts = []
        for mask in masks:
            has = (mask[:, None] >> np.arange(4, dtype=np.uint8)) & 1 > 0
            node, quarter = np.nonzero(has)
            starts.append(np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])))
            code = code[node] << 2 | quarter
        column = np.zeros(len(code), np.int64)
        for i in range(len(masks)):
            column |= ((code >> (2 * i)) & 1) << i
        best, maxima = impacts(tf, m[column]), []
        for first in starts[::-1]:
            best = np.maximum.reduceat(best, first)
            maxima.append((-(-best // MAXIMUM_UNIT)).astype(np.uint8))
        return Treap(len(masks), masks, maxima[::-1], tf, m)

    def __post_init__(self) -> None:
        self.first = [(np.cumsum(_POPCOUNT[x]) - _POPCOUNT[x]).astype(np.int32) for x in self.masks]

    def open(self, level: int, node: np.ndarray, row: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of the nodes have a child on the row's path in the left (0) or right (1) half of the columns, and which child."""
        bit = ((row >> (self.height - 1 - level)) & 1) * 2 + side
        mask = self.masks[level][node]
        has = (mask >> bit) & 1 > 0
        node, mask, bit = node[has], mask[has], bit[has]
        return has, self.first[level][node] + _POPCOUNT[mask & ((1 << bit) - 1)]

    def bound(self, level: int, node: np.ndarray, column: np.ndarray) -> np.ndarray:
        """Greatest impact below nodes of a level; exact for postings."""
        if level < self.height:
            return self.maxima[level][node].astype(np.int64) * MAXIMUM_UNIT
        return impacts(self.tf[node], self.m[column])


@dataclass
class _Frontier:
    """Document ranges of one level: item, first column / 2**(levels below), bound; and the cells in them."""

    level: int
    item: np.ndarray
    range: np.ndarray
    bound: np.ndarray
    entry: np.ndarray  # of each cell: its place among the ranges
    node: np.ndarray
    row: np.ndarray
    weight: np.ndarray

    def only(self, kept: np.ndarray) -> _Frontier:
        """The ranges at the given places, ascending."""
        new = np.full(len(self.item), -1, np.int64)
        new[kept] = np.arange(len(kept))
        entry = new[self.entry]
        cells = entry >= 0
        return _Frontier(
            self.level, self.item[kept], self.range[kept], self.bound[kept],
            entry[cells], self.node[cells], self.row[cells], self.weight[cells],
        )

    def opened(self, treap: Treap) -> _Frontier:
        """The halves of all ranges that hold a cell."""
        sides = [treap.open(self.level, self.node, self.row, side) for side in (0, 1)]
        entry = np.concatenate([2 * self.entry[has] + side for side, (has, _) in enumerate(sides)])
        row = np.concatenate([self.row[has] for has, _ in sides])
        weight = np.concatenate([self.weight[has] for has, _ in sides])
        node = np.concatenate([child for _, child in sides])
        columns = np.repeat(2 * self.range, 2)
        columns[1::2] += 1
        bound = np.zeros(len(columns), np.int64)
        np.add.at(bound, entry, weight * treap.bound(self.level + 1, node, columns[entry]))
        both = _Frontier(self.level + 1, np.repeat(self.item, 2), columns, bound, entry, node, row, weight)
        return both.only(np.flatnonzero(bound > 0))


class _Best:
    """The k best (item, column, score) so far; ties to the smaller column."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.least = k, np.zeros(items, np.int64)
        self.item, self.column, self.score = (np.empty(0, np.int64) for _ in range(3))

    def add(self, item: np.ndarray, column: np.ndarray, score: np.ndarray) -> None:
        item, column, score = (np.concatenate(x) for x in ((self.item, item), (self.column, column), (self.score, score)))
        order = np.lexsort((column, -score, item))
        item, column, score = item[order], column[order], score[order]
        starts = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]])) if len(item) else np.empty(0, np.int64)
        place = np.arange(len(item)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(item)]])))
        last = place == self.k - 1
        self.least[item[last]] = score[last]
        kept = place < self.k
        self.item, self.column, self.score = item[kept], column[kept], score[kept]


def search_block(treap: Treap, items: int, item: np.ndarray, row: np.ndarray, weight: np.ndarray, k: int) -> _Best:
    """The k best columns of every item, whose terms' rows and weights are given as parallel arrays."""
    best = _Best(items, k)
    if not len(item):
        return best
    asked, entry = np.unique(item, return_inverse=True)
    zeros = np.zeros(len(asked), np.int64)
    front = _Frontier(0, asked, zeros, zeros, entry, row >> treap.height, row, weight)
    for _ in range(max(0, treap.height - RANGE_LEVELS)):
        front = front.opened(treap)
    # an item's ranges by descending bound; a step opens the next ones of every item
    order = np.lexsort((front.range, -front.bound, front.item))
    sorted_item = front.item[order]
    starts = np.flatnonzero(np.concatenate([[True], sorted_item[1:] != sorted_item[:-1]]))
    turn = np.empty(len(order), np.int64)
    turn[order] = np.arange(len(order)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(order)]])))
    by_turn = np.argsort(turn // RANGES_AT_ONCE, kind="stable")
    cuts = np.searchsorted((turn // RANGES_AT_ONCE)[by_turn], np.arange(int(turn.max()) // RANGES_AT_ONCE + 2))
    cell_order = np.argsort(front.entry, kind="stable")
    cell_ends = np.searchsorted(front.entry[cell_order], np.arange(len(order) + 1))
    for s, e in zip(cuts[:-1], cuts[1:]):
        ranges = np.sort(by_turn[s:e])
        ranges = ranges[front.bound[ranges] >= best.least[front.item[ranges]]]
        if not len(ranges):
            continue
        sizes = cell_ends[ranges + 1] - cell_ends[ranges]
        cells = cell_order[np.repeat(cell_ends[ranges] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
        below = _Frontier(
            front.level, front.item[ranges], front.range[ranges], front.bound[ranges],
            np.repeat(np.arange(len(ranges)), sizes), front.node[cells], front.row[cells], front.weight[cells],
        )
        while below.level < treap.height and len(below.item):
            below = below.opened(treap)
            below = below.only(np.flatnonzero(below.bound >= best.least[below.item]))
        best.add(below.item, below.range, below.bound)
    return best


_GRID = "terms binary, df binary, masks array<binary>, tf binary, lengths binary, ids array<{}>"
_INDEX = "block string, " + _GRID + ", maxima array<binary>, m binary"


class _Block:
    """The documents of one block while it is read; a text is kept as the numbers of its terms."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = defaultdict(count().__next__)
        self.ids: list = []
        self.found: list[np.ndarray] = []
        self.chars = 0

    def add(self, doc_id, text: str) -> None:
        terms = terms_of(text)
        if terms:
            self.ids.append(None if pd.isna(doc_id) else doc_id)
            self.found.append(np.fromiter(map(self.numbers.__getitem__, terms), np.int32, len(terms)))
            self.chars += len(text)

    def row(self) -> dict:
        ids, found = self.ids, self.found
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))
        lengths = np.array([len(found[i]) for i in order], dtype=np.int64)
        term = np.concatenate([found[i] for i in order]).astype(np.int64)
        cell, tf = np.unique(term * len(ids) + np.repeat(np.arange(len(ids)), lengths), return_counts=True)
        term, column = cell // len(ids), cell % len(ids)
        df = np.bincount(term, minlength=len(self.numbers))
        rank = np.argsort(-df, kind="stable")
        row = np.empty(len(rank), np.int64)
        row[rank] = np.arange(len(rank))
        masks, tf = grid(row[term], column, tf, len(ids))
        names = list(self.numbers)
        return {
            "terms": zstandard.compress(b"\n".join([names[k] for k in rank]), 1),
            "df": _pack(df[rank].astype(np.int64)),
            "masks": [_pack(x) for x in masks],
            "tf": _pack(tf.astype(np.int64)),
            "lengths": _pack(lengths),
            "ids": [ids[i] for i in order],
        }


def _grids(block_docs: int, block_chars: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = _Block()
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].astype(object), batch["text"]):
                if block.ids and (len(block.ids) >= block_docs or block.chars + len(text) > block_chars):
                    yield pd.DataFrame([block.row()])
                    block = _Block()
                block.add(doc_id, text)
        if block.ids:
            yield pd.DataFrame([block.row()])

    return run


def _sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        lengths = [_unpack(x, "<i8") for x in batch["lengths"]]
        yield pd.DataFrame({"documents": [len(x) for x in lengths], "terms": [int(x.sum()) for x in lengths]})


def _with_maxima(documents: int, all_terms: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                lengths = _unpack(row["lengths"], "<i8").tolist()
                m = np.array([LENGTH_BASE + (LENGTH_SHARE * n * documents) // all_terms for n in lengths], dtype=np.int64)
                treap = Treap.over([_unpack(x, "u1") for x in row["masks"]], _unpack(row["tf"], "<i8"), m)
                whole = {"block": uuid.uuid4().hex, **row.to_dict(), "maxima": [_pack(x) for x in treap.maxima], "m": _pack(m)}
                yield pd.DataFrame([whole])

    return run


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows go to Python ``HELD_BYTES`` at a time: a block is megabytes, and a task may have any number."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(HELD_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@dataclass
class LexicalIndex:
    """Blocks of the grid, and what the ranking counts over all documents."""

    blocks: DataFrame
    documents: int
    id_type: str


def build_index(docs: DataFrame, block_docs: int = BLOCK_DOCS, block_chars: int = BLOCK_CHARS) -> LexicalIndex:
    """The index of ``docs(doc_id, text)``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", whole_text().alias("text"))
    with _small_batches(docs.sparkSession):
        grids = store(rows.mapInPandas(_grids(block_docs, block_chars), _GRID.format(kind)), "lexical-grids", group_bytes=HELD_BYTES)
        sizes = grids.select("lengths").mapInPandas(_sizes, "documents long, terms long")
        sizes = sizes.agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.sum("terms").alias("terms")).first()
        blocks = grids.mapInPandas(_with_maxima(sizes["documents"], sizes["terms"]), _INDEX.format(kind))
        return LexicalIndex(store(blocks, "lexical-index", group_bytes=HELD_BYTES), sizes["documents"], kind)


def _block_terms(data: bytes) -> list[bytes]:
    return zstandard.decompress(bytes(data)).split(b"\n")


def _document_counts(packed):
    """(term, df) of a block for the asked terms, by their place in the round."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = {t: i for i, t in enumerate(packed.value)}
        for batch in batches:
            for terms, df in zip(batch["terms"], batch["df"]):
                place = np.array([asked.get(t, -1) for t in _block_terms(terms)], dtype=np.int64)
                yield pd.DataFrame({"term": place[place >= 0], "df": _unpack(df, "<i8")[place >= 0]})

    return run


def _search(packed, items: int, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms, item, term, weight = packed.value
        asked = {t: i for i, t in enumerate(terms)}
        for batch in batches:
            for block in batch.itertuples(index=False):
                row_of = np.full(len(terms), -1, np.int64)
                for row, t in enumerate(_block_terms(block.terms)):
                    if (place := asked.get(t)) is not None:
                        row_of[place] = row
                masks, maxima = ([_unpack(x, "u1") for x in level] for level in (block.masks, block.maxima))
                treap = Treap(len(masks), masks, maxima, _unpack(block.tf, "<i8"), _unpack(block.m, "<i8"))
                ids = list(block.ids)
                for first in range(0, items, ITEMS_AT_ONCE):
                    here = (row_of[term] >= 0) & (item >= first) & (item < first + ITEMS_AT_ONCE)
                    best = search_block(treap, items, item[here], row_of[term[here]], weight[here], k)
                    yield pd.DataFrame(
                        {"block": block.block, "number": best.item, "doc_id": [ids[c] for c in best.column], "score": best.score}
                    )

    return run


def search(index: LexicalIndex, items: DataFrame, k: int = TOP, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """The k best documents of each of ``items(item_id, text)``: item_id, rank, doc_id, score.

    Defined cases: a null or empty item or document text has no terms and no
    rows; of rows that repeat an item id the one of the smallest text counts, and
    null ids are one item; document rows that repeat an id are ranked each; null
    document ids come last among equal scores; empty tables give no rows; other
    columns are ignored.
    """
    spark = items.sparkSession
    whole = items.groupBy("item_id").agg(F.min("text").alias("text")).where(F.length("text") > 0)
    whole = store(whole.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "search-items")
    size = whole.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    rounds = max(1, -(-size // round_bytes))
    found = []
    for number in range(rounds):
        # bounded: a round holds about ROUND_BYTES of text
        asked = whole.where(F.pmod(F.xxhash64("item"), F.lit(rounds)) == number).select("item", "text").collect()
        counted = [Counter(terms_of(r["text"])) for r in asked]
        terms = list({t: None for c in counted for t in c})
        place = {t: i for i, t in enumerate(terms)}
        packed = spark.sparkContext.broadcast(terms)
        rows = index.blocks.select("terms", "df").mapInPandas(_document_counts(packed), "term long, df long")
        with _small_batches(spark):
            df = {r["term"]: r["df"] for r in rows.groupBy("term").agg(F.sum("df").alias("df")).collect()}
        packed.destroy()
        weight = {t: math.floor(1000 * math.log((2 * index.documents + 2) / (2 * n + 1))) for t, n in df.items()}
        cells = [(i, place[t], n * weight[place[t]]) for i, c in enumerate(counted) for t, n in c.items() if weight.get(place[t])]
        arrays = [np.array(x, dtype=np.int64) for x in zip(*cells)] if cells else [np.empty(0, np.int64)] * 3
        packed = spark.sparkContext.broadcast((terms, *arrays))
        best = index.blocks.mapInPandas(_search(packed, len(asked), k), f"block string, number long, doc_id {index.id_type}, score long")
        names = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(asked)], "number long, item long")
        with _small_batches(spark):
            found.append(store(best.join(F.broadcast(names), "number").select("block", "item", "doc_id", "score"), "block-hits"))
        packed.destroy()
    hits = found[0]
    for more in found[1:]:
        hits = hits.union(more)
    order = (F.desc("score"), F.col("doc_id").asc_nulls_last())
    # every block has k rows of an item: they meet in parts first
    part = Window.partitionBy("item", F.pmod(F.xxhash64("block"), F.lit(64))).orderBy(*order)
    hits = hits.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k).drop("rank")
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.join(whole.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def lexical_search(docs: DataFrame, items: DataFrame, k: int = TOP, **options) -> DataFrame:
    """Index ``docs`` and search it for every item."""
    return search(build_index(docs, **options), items, k)
