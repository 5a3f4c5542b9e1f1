"""SimHash near-dedup: fingerprints linked through BK-trees.

Fingerprints within ``radius`` bits of each other agree on at least two of
``radius + 2`` blocks of bits. Each pair of blocks therefore names a shard: the
distinct fingerprints that share the pair's bits. A shard's fingerprints form a
BK-tree (children keyed by their integer Hamming distance to the parent), which
is searched along the edges within the radius only. A tree goes to the task that
holds the queries of its shard instead of to every task: it is sent exactly where
it can match, so no tree needs a broadcast and the work stays in proportion to
the input. Shards above ``shard_size`` are split, and every pair of parts is a
cell of its own (tree of one part, queries of the other), which bounds every
tree. A cell reports a spanning forest of its links, not all pairs; the links
are joined to components by grouped minima.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.llm.common import parallelism, whole_text
from labelforge.llm.components import connected_components
from labelforge.session import cut_lineage

# Fixed values of the contract.
SHINGLE = 4
RADIUS = 4
SEED = 42

#: Fingerprints in one BK-tree at most.
SHARD_SIZE = 4096

_CHUNK = 1 << 14


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles: a bit is set if over half the shingle hashes set it."""
    words = text.encode("utf-8").lower().split()  # bytes: lowers A-Z, splits at 0x20 and 0x09-0x0D
    if not words:
        return 0
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    joined = b" ".join(words)
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    n, digest = len(last), xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        spans = zip(starts[at : min(at + _CHUNK, n)].tolist(), last[at : at + _CHUNK].tolist())
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), dtype=np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    """Fingerprints as signed 64-bit integers (the same bits)."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return run(text)


class BKTree:
    """Integers under Hamming distance; children are keyed by the distance to their parent."""

    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        node = self.root
        while True:
            d = (node[0] ^ value).bit_count()
            if d == 0:
                return
            child = node[1].get(d)
            if child is None:
                node[1][d] = (value, {})
                return
            node = child

    def search(self, value: int, radius: int) -> list[int]:
        found, todo = [], [self.root] if self.root else []
        while todo:
            item, children = todo.pop()
            d = (item ^ value).bit_count()
            if d <= radius:
                found.append(item)
            todo += [child for k, child in children.items() if d - radius <= k <= d + radius]
        return found


def _forest(tree_part: list[int], query_part: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links inside one part, or between two parts."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    tree, out = BKTree(), []

    def link(value: int) -> None:
        for other in tree.search(value, radius):
            a, b = root(value), root(other)
            if a != b:
                parent[a] = b
                out.append((value, other))

    for value in tree_part:
        if query_part is None:
            link(value)
        tree.add(value)
    for value in query_part or ():
        link(value)
    return out


def _search_cells(radius: int):
    """Runs of equal (key, a, b) in key order; a run may continue in the next batch."""

    def cell(fps: np.ndarray, parts: np.ndarray, a: int, b: int) -> list[tuple[int, int]]:
        if a == b:
            return _forest(fps.tolist(), None, radius)
        return _forest(fps[parts == a].tolist(), fps[parts == b].tolist(), radius)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            ids = rest[["key", "a", "b"]].to_numpy()
            cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
            if len(cuts):
                yield from found(rest.iloc[: cuts[-1]], ids[: cuts[-1]], cuts)
                rest = rest.iloc[cuts[-1] :].reset_index(drop=True)
        if rest is not None and len(rest):
            yield from found(rest, rest[["key", "a", "b"]].to_numpy(), np.array([len(rest)]))

    def found(rows: pd.DataFrame, ids: np.ndarray, ends: np.ndarray) -> Iterator[pd.DataFrame]:
        starts = np.concatenate([[0], ends[:-1]])
        fps, parts = rows["fp"].to_numpy().view(np.uint64), rows["part"].to_numpy()
        out: list[tuple[int, int]] = []
        for s, e in zip(starts, ends):
            if e - s > 1:
                out += cell(fps[s:e], parts[s:e], int(ids[s, 1]), int(ids[s, 2]))
        if out:
            links = np.array(out, dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"u": links[:, 0], "v": links[:, 1]})

    return run


def shard_keys(fp: Column, radius: int = RADIUS) -> Column:
    """One key per pair of bit blocks; fingerprints within the radius share at least one."""
    blocks = radius + 2
    edges = [64 * i // blocks for i in range(blocks + 1)]
    part = [
        F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(edges, edges[1:])
    ]
    width = max(hi - lo for lo, hi in zip(edges, edges[1:]))
    return F.array(
        *[
            F.lit(n << (2 * width)).cast("long") + F.shiftleft(part[i], width) + part[j]
            for n, (i, j) in enumerate(combinations(range(blocks), 2))
        ]
    )


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, shard_size: int = SHARD_SIZE) -> DataFrame:
    """(u, v): links that connect exactly the components of the distinct fingerprints ``fps(fp)``."""
    spark = fps.sparkSession
    rows = fps.select(F.explode(shard_keys(F.col("fp"), radius)).alias("key"), "fp")
    large = (
        rows.groupBy("key")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > shard_size)
        .select("key", F.ceil(F.col("n") / shard_size).cast("int").alias("parts"))
    )
    parts = F.coalesce(F.col("parts"), F.lit(1))
    other = F.explode(F.sequence(F.lit(0), parts - 1))
    cells = (
        rows.join(large, "key", "left")
        .select("key", "fp", F.pmod(F.xxhash64("fp"), parts).cast("int").alias("part"), other.alias("other"))
        .select("key", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part", "fp")
    )
    dealt = cells.repartition(parallelism(spark), "key", "a", "b").sortWithinPartitions("key", "a", "b")
    return dealt.mapInPandas(_search_cells(radius), "u long, v long")


def simhash_components(
    docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, shard_size: int = SHARD_SIZE
) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Defined cases: null and empty texts have fingerprint zero, which links like
    any other; fewer words than a shingle make one shingle; rows that repeat an
    id stay separate rows of one component; a null id takes no part in the
    smallest id (a component of null ids has a null component_id); an empty
    table gives no rows; other columns are ignored.
    """
    marked = cut_lineage(
        docs.select("doc_id", fingerprint_column(whole_text(), shingle).alias("fp")), "fingerprints"
    )
    fps = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    nodes = connected_components(fingerprint_links(fps.select("fp"), radius, shard_size))
    # only linked fingerprints are in `nodes`; the others are components of their own
    linked = fps.join(nodes, fps["fp"] == nodes["node"]).select("fp", "first_id", "component")
    linked = cut_lineage(linked, "linked-fingerprints")
    least = linked.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_fp = fps.join(
        linked.join(least, "component").select("fp", "component_id"), "fp", "left"
    ).select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    return marked.join(of_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


#: Ids of removed documents below this number are broadcast; beyond it the join shuffles.
BROADCAST_IDS = 1_000_000


def keep_one_per_component(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose id is their component's smallest, one of each id, columns unchanged.

    Defined cases: of rows that repeat a kept id one stays; a row with a null id
    can't be named, so it stays; everything else as in ``simhash_components``.
    """
    found = simhash_components(docs, **options).where(F.col("doc_id").isNotNull())
    marked = found.groupBy("doc_id").agg(
        F.max(F.col("doc_id") != F.col("component_id")).alias("gone"), F.count("*").alias("rows")
    )
    marked = cut_lineage(marked.where("gone or rows > 1"), "simhash-decisions")
    gone = marked.where("gone").select(F.col("doc_id").alias("named"))
    repeated = marked.where("rows > 1 and not gone").select(F.col("doc_id").alias("named"))

    def small(ids: DataFrame) -> tuple[DataFrame, int]:
        n = ids.count()
        return (F.broadcast(ids) if n <= BROADCAST_IDS else ids), n

    lost, _ = small(gone)
    kept = docs.join(lost, docs["doc_id"] == lost["named"], "left_anti")
    again, n = small(repeated)
    if not n:
        return kept
    single = kept.join(again, kept["doc_id"] == again["named"], "left_anti")
    return single.union(kept.join(again, kept["doc_id"] == again["named"], "left_semi").dropDuplicates(["doc_id"]))
