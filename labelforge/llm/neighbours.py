"""Approximate nearest neighbours: a graph by NN-descent, searched greedily.

Equal vectors are one node. A first graph comes from a few orders of the nodes by
the signs of random projections: neighbours in an order, a leaf at a time, know
each other. NN-descent then joins neighbours of neighbours: every node meets the
nodes that name it and those it names, the vectors of these members come to it by
a join, and each pair with a member that is new since the last round is compared.
Pairs closer than what either holds are sent out, and every node keeps its best.
A node that very many others name is cut into parts by a hash, so no group grows
with the data. Rounds go on until hardly any edge is new.

A search starts at the best of a bounded sample of nodes and opens, hop by hop,
the neighbours of the best nodes found so far that aren't open yet; every hop is
a join with the graph and one with the vectors. It ends when nothing is left to
open. The nodes that remain are scored exactly on the original vectors.

Every vector is indexed; only the starting sample is bounded (``PIVOTS``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelforge.llm.common import parallelism, store

#: Neighbours found for each query.
NEAREST = 5

#: Edges that a node keeps, as many again may lead to it from nodes it doesn't name.
DEGREE = 24

#: Orders of the first graph, signs in each, and nodes of an order that are compared at a time.
ORDERS = 4
SIGNS = 20
LEAF = 256

#: Members of a node that meet in one group.
GROUP = 128

#: Rounds of NN-descent end when fewer than this share of the edges are new, or after so many.
SETTLED = 0.005
ROUNDS = 8

#: Starting nodes of all searches, those of one search, and the nodes that a search keeps.
PIVOTS = 1024
STARTS = 8
BEAM = 96


def usable(vector: Column) -> Column:
    """Not null or empty, every component finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring the largest component near 1: directions stay, squares don't overflow."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1))
    return np.ldexp(vectors, -exponent[:, None])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the same row of ``b``, in double precision."""
    a, b = _scaled(a), _scaled(b)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=np.float64) for x in column])


def _unit(vector: Column) -> Column:
    """A unit vector as a scale and a byte per component, for finding; what is found is scored on the originals."""

    @F.pandas_udf("binary")
    def run(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        rows = _scaled(_matrix(vectors))
        rows /= np.sqrt((rows * rows).sum(axis=1))[:, None]
        scale = (np.abs(rows).max(axis=1) / 127).astype(np.float32)
        codes = np.rint(rows / scale[:, None]).astype(np.int8)
        return pd.Series([s.tobytes() + c.tobytes() for s, c in zip(scale, codes)], dtype=object)

    return run(vector)


def _units(column) -> np.ndarray:
    if not len(column):
        return np.empty((0, 0), np.float32)
    data = np.frombuffer(b"".join(bytes(x) for x in column), np.uint8).reshape(len(column), -1)
    return np.ascontiguousarray(data[:, :4]).view(np.float32) * np.ascontiguousarray(data[:, 4:]).view(np.int8)


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): one usable vector per id, in double precision, of the most frequent length."""
    v = F.col("embedding").cast("array<double>").alias("v")
    rows = vectors.where(F.col("vec_id").isNotNull()).select("vec_id", v).where(usable(F.col("v")))
    rows = store(rows.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    length = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.where(F.size("v") == (length["d"] if length else 0))


def _projected(order: int, dimensions: int) -> Column:
    planes = np.random.default_rng(order).standard_normal((dimensions, SIGNS)).astype(np.float32)
    bits = 1 << np.arange(SIGNS, dtype=np.int64)

    @F.pandas_udf("long")
    def run(units: pd.Series) -> pd.Series:
        return pd.Series((_units(units) @ planes > 0) @ bits if len(units) else [], dtype="int64")

    return run(F.col("unit"))


def _leaves(degree: int):
    """The nearest in each leaf of a partition's nodes, in their order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            whole = len(rest) // LEAF * LEAF
            for at in range(0, whole, LEAF):
                yield nearest(rest.iloc[at : at + LEAF])
            rest = rest.iloc[whole:].reset_index(drop=True)
        if rest is not None and len(rest) > 1:
            yield nearest(rest)

    def nearest(rows: pd.DataFrame) -> pd.DataFrame:
        nodes, units = rows["node"].to_numpy(), _units(rows["unit"])
        near = units @ units.T
        np.fill_diagonal(near, -np.inf)
        k = min(degree, len(nodes) - 1)
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        u = np.repeat(np.arange(len(nodes)), k)
        return pd.DataFrame({"u": nodes[u], "v": nodes[best.ravel()], "near": near[u, best.ravel()]})

    return run


def _closest(edges: DataFrame, degree: int) -> DataFrame:
    """The best edges of every node; an edge that was known isn't fresh."""
    once = edges.groupBy("u", "v").agg(F.max("near").alias("near"), F.min("fresh").alias("fresh"))
    place = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("near"), "v"))
    return once.withColumn("place", place).where(F.col("place") <= degree).drop("place")


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of members of one group (rows in the groups' order) that are closer than what one of them holds."""

    def found(rows: pd.DataFrame, ends: np.ndarray) -> Iterator[pd.DataFrame]:
        nodes, fresh, least = rows["member"].to_numpy(), rows["fresh"].to_numpy(), rows["least"].to_numpy()
        units = _units(rows["unit"])
        out = []
        for s, e in zip(np.concatenate([[0], ends[:-1]]), ends):
            if e - s < 2 or not fresh[s:e].any():
                continue
            near = units[s:e] @ units[s:e].T
            good = (near > least[s:e, None]) & (fresh[s:e, None] | fresh[None, s:e])
            np.fill_diagonal(good, False)
            i, j = np.nonzero(good)
            out.append((nodes[s + i], nodes[s + j], near[i, j]))
        if out:
            u, v, near = (np.concatenate(x) for x in zip(*out))
            yield pd.DataFrame({"u": u, "v": v, "near": near})

    rest = None
    for batch in batches:
        rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        ids = rest[["centre", "part"]].to_numpy()
        cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
        if len(cuts):
            yield from found(rest.iloc[: cuts[-1]], cuts)
            rest = rest.iloc[cuts[-1] :].reset_index(drop=True)
    if rest is not None and len(rest):
        yield from found(rest, np.array([len(rest)]))


_EDGES = "u long, v long, near float"


def _round(nodes: DataFrame, edges: DataFrame, degree: int) -> DataFrame:
    """One round of neighbours of neighbours."""
    both = edges.select(F.col("u").alias("centre"), F.col("v").alias("member"), "fresh").union(edges.select("v", "u", "fresh"))
    both = both.groupBy("centre", "member").agg(F.max("fresh").alias("fresh"))
    crowded = both.groupBy("centre").agg(F.count("*").alias("n")).where(F.col("n") > GROUP)
    crowded = crowded.select("centre", F.ceil(F.col("n") / GROUP).cast("int").alias("parts"))
    least = edges.groupBy("u").agg(F.count("*").alias("n"), F.min("near").alias("least"))
    least = least.select(F.col("u").alias("member"), F.when(F.col("n") >= degree, F.col("least")).otherwise(F.lit(-2.0)).cast("float").alias("least"))
    known = nodes.select(F.col("node").alias("member"), "unit").join(least, "member", "left")
    part = F.pmod(F.xxhash64("member"), F.coalesce("parts", F.lit(1))).cast("int").alias("part")
    members = both.join(crowded, "centre", "left").select("centre", part, "member", "fresh")
    met = members.join(known, "member").select("centre", "part", "member", "fresh", "unit", F.coalesce("least", F.lit(-2.0).cast("float")).alias("least"))
    dealt = met.repartition(parallelism(nodes.sparkSession), "centre", "part").sortWithinPartitions("centre", "part")
    more = dealt.mapInPandas(_joined, _EDGES)
    return _closest(edges.withColumn("fresh", F.lit(False)).union(more.withColumn("fresh", F.lit(True))), degree)


@dataclass
class NeighbourGraph:
    """nodes(node, v, ids, unit), one per distinct vector with its smallest ids; links(node, around)."""

    nodes: DataFrame
    links: DataFrame


def build_graph(vectors: DataFrame, degree: int = DEGREE, copies: int = NEAREST + 1) -> NeighbourGraph:
    """The graph of ``vectors(vec_id, v)`` as ``usable_vectors`` gives them; a node keeps its ``copies`` smallest ids."""
    spark = vectors.sparkSession
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    least = vectors.withColumn("place", place).where(F.col("place") <= copies)
    distinct = least.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    nodes = store(distinct.select(F.monotonically_increasing_id().alias("node"), "v", "ids", _unit(F.col("v")).alias("unit")), "nodes")
    size = nodes.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    parts = max(1, min(parallelism(spark), size["n"] // (4 * LEAF)))
    edges = None
    for order in range(ORDERS):
        coded = nodes.select("node", "unit", _projected(order, size["d"] or 1).alias("code"))
        dealt = coded.repartitionByRange(parts, "code", "node").sortWithinPartitions("code", "node")
        found = dealt.select("node", "unit").mapInPandas(_leaves(degree), _EDGES)
        edges = found if edges is None else edges.union(found)
    edges = store(_closest(edges.withColumn("fresh", F.lit(True)), degree), "edges")
    for _ in range(ROUNDS):
        edges = store(_round(nodes, edges, degree), "edges")
        if edges.where("fresh").count() <= SETTLED * degree * size["n"]:
            break
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "near", F.lit(True).alias("fresh"))
    around = edges.select("u", "v").union(_closest(back, degree).select("u", "v")).distinct()
    links = around.groupBy(F.col("u").alias("node")).agg(F.collect_list("v").alias("around"))
    return NeighbourGraph(nodes, store(links, "links"))


_STATE = "query long, unit binary, found array<long>, near array<float>, open array<boolean>"


def _kept(query: int, unit: bytes, nodes: np.ndarray, near: np.ndarray, opened: np.ndarray, beam: int) -> tuple:
    """The best distinct nodes of one search; those that were opened before stay so."""
    order = np.lexsort((~opened, nodes))
    nodes, near, opened = nodes[order], near[order], opened[order]
    first = np.concatenate([[True], nodes[1:] != nodes[:-1]])
    nodes, near, opened = nodes[first], near[first], opened[first]
    best = np.lexsort((nodes, -near))[:beam]
    return query, unit, nodes[best].tolist(), near[best].tolist(), (~opened[best]).tolist()


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["query", "unit", "found", "near", "open"])


def _started(packed, starts: int, beam: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nodes, units = packed.value
        for batch in batches:
            if not len(batch):
                continue
            near = _units(batch["unit"]) @ units.T
            k = len(nodes) if len(nodes) < PIVOTS else starts  # a table that is all pivots is compared whole
            best = np.argsort(-near, axis=1, kind="stable")[:, :k]
            yield _frame(
                [
                    _kept(q, u, nodes[b], n[b], np.zeros(len(b), bool), beam)
                    for q, u, n, b in zip(batch["query"], batch["unit"], near, best)
                ]
            )

    return run


def _hop(beam: int):
    def run(state: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        row = state.iloc[0]
        near = _units(met["other"]) @ _units([row["unit"]])[0] if len(met) else np.empty(0, np.float32)
        nodes = np.concatenate([np.asarray(row["found"], np.int64), met["node"].to_numpy(np.int64)])
        near = np.concatenate([np.asarray(row["near"], np.float32), near])
        opened = np.zeros(len(nodes), bool)
        opened[: len(row["found"])] = True  # every kept node was opened for this hop or before
        return _frame([_kept(int(row["query"]), row["unit"], nodes, near, opened, beam)])

    return run


def greedy_search(graph: NeighbourGraph, queries: DataFrame, beam: int = BEAM) -> DataFrame:
    """(query, node): the nodes that a search from each of ``queries(query, v)`` keeps."""
    spark = queries.sparkSession
    sample = graph.nodes.select("node", "unit").orderBy(F.xxhash64("node"), "node").limit(PIVOTS).collect()
    pivots = (np.array([r["node"] for r in sample], dtype=np.int64), _units([r["unit"] for r in sample]))
    packed = spark.sparkContext.broadcast(pivots)
    asked = queries.select("query", _unit(F.col("v")).alias("unit"))
    if not sample:
        return asked.where("false").select("query", F.lit(0).cast("long").alias("node"))
    state = store(asked.mapInPandas(_started(packed, STARTS, beam), _STATE), "search")
    vectors = graph.nodes.select("node", F.col("unit").alias("other"))
    while state.where(F.exists("open", lambda x: x)).limit(1).count():
        pairs = state.select("query", F.explode(F.arrays_zip("found", "open")).alias("f"))
        frontier = pairs.where("f.open").select("query", F.col("f.found").alias("node"))
        near = frontier.join(graph.links, "node").select("query", F.explode("around").alias("node")).distinct()
        held = pairs.select("query", F.col("f.found").alias("node"))
        met = near.join(held, ["query", "node"], "left_anti").join(vectors, "node").select(F.col("query").alias("by"), "node", "other")
        state = store(state.groupBy("query").cogroup(met.groupBy("by")).applyInPandas(_hop(beam), _STATE), "search")
    packed.destroy()
    return state.select("query", F.explode("found").alias("node"))


def _scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            yield pd.DataFrame({"query": batch["query"], "node": batch["node"], "score": cosines(_matrix(batch["q"]), _matrix(batch["v"]))})


def nearest_neighbours(vectors: DataFrame, queries: Column, k: int = NEAREST, degree: int = DEGREE, beam: int = BEAM) -> DataFrame:
    """For each row of ``vectors(vec_id, embedding)`` where ``queries``, a condition on vec_id, holds: query_id, rank, vec_id, score.

    The k others of largest cosine that the search finds, nearest first, equal
    scores by ascending vec_id. Defined cases: rows without an id, and vectors
    that are null, empty, zero, hold null or non-finite components or have another
    length than most, take no part; of rows that repeat an id the one with the
    smallest vector counts; equal vectors are candidates each; with fewer
    candidates all are returned; an empty table gives no rows; other columns are
    ignored.
    """
    rows = usable_vectors(vectors)
    graph = build_graph(rows, degree, k + 1)
    asked = rows.where(queries)
    # copies of a query are searched for once
    named = store(asked.select("v").distinct().select(F.monotonically_increasing_id().alias("query"), "v"), "queries")
    found = greedy_search(graph, named, beam).join(named.withColumnRenamed("v", "q"), "query").join(graph.nodes.select("node", "v"), "node")
    scored = found.select("query", "node", "q", "v").mapInPandas(_scored, "query long, node long, score double")
    each = scored.join(graph.nodes.select("node", "ids"), "node").select("query", "score", F.explode("ids").alias("vec_id"))
    order = (F.desc("score"), F.col("vec_id"))
    few = each.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("place") <= k + 1)
    per_query = asked.select(F.col("vec_id").alias("query_id"), "v").join(named, "v").select("query_id", "query")
    others = per_query.join(few.drop("place"), "query").where(F.col("query_id") != F.col("vec_id"))
    ranked = others.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
