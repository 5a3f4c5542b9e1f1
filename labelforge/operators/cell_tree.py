"""IVF cells in two levels: branches, and leaves fitted branch by branch in tasks.

The driver and every broadcast hold the branch centres only, ``BRANCHES`` at
most whatever the corpus. A branch fits its leaf centres in a task, on at most
``TRAIN_ROWS`` of its vectors; the centres stay a DataFrame. Vectors meet the
centres of their branches by cogroups, cut into parts of bounded size; queries meet
all leaf centres (four roots of the corpus) in the tasks that search.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from labelforge.operators.dense import passing_topk
from labelforge.operators.ivf import ROUTE_VALUES
from labelforge.session import cut_lineage

#: Branch centres, at most.
BRANCHES = 256

#: Vectors that fit the branch centres, and those that fit the leaves of one branch, at most.
TRAIN_ROWS = 16_384

#: Vectors or queries of one part of a branch, about.
PART = 16_384


@dataclass
class CellTree:
    branches: np.ndarray  # (branches, dim), unit rows
    leaves: DataFrame  # cell, branch, centre
    vectors: DataFrame  # doc_id, first_ord, embedding, cell


def _units(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def spherical_kmeans(rows: np.ndarray, k: int, rounds: int = 12, seed: int = 42) -> np.ndarray:
    """Unit centres of at most ``k`` groups by inner product; starts are distinct rows."""
    rows = _units(rows)
    distinct = np.unique(rows, axis=0)
    rng = np.random.default_rng(seed)
    centres = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        nearest = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, rows)
        moved = np.where(np.bincount(nearest, minlength=len(centres))[:, None] > 0, _units(sums), centres)
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def _nearest_branches(centres, vector: Column, p: int) -> Column:
    """The ``p`` best branches of a vector by inner product, best first."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(vecs: pd.Series) -> pd.Series:
        if not len(vecs):
            return pd.Series([], dtype=object)
        scores = np.stack(vecs.to_numpy()).astype(np.float64) @ centres.value.T
        return pd.Series(list(np.argsort(-scores, axis=1, kind="stable")[:, :p].astype(np.int32)), dtype=object)

    return run(vector)


def _cells_of(probes: int):
    """The best ``probes`` cells of each row among its branch's leaves."""

    def run(rows: pd.DataFrame, leaves: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or leaves.empty:
            return pd.DataFrame({"ord": np.zeros(0, np.int64), "cell": np.zeros(0, np.int64), "near": np.zeros(0)})
        leaves = leaves.sort_values("cell")
        near = np.stack(rows["vec"].to_numpy()).astype(np.float64) @ np.stack(leaves["centre"].to_numpy()).T
        p = min(probes, near.shape[1])
        best = np.argsort(-near, axis=1, kind="stable")[:, :p]
        at = np.repeat(np.arange(len(rows)), p)
        return pd.DataFrame({"ord": rows["ord"].to_numpy()[at], "cell": leaves["cell"].to_numpy()[best.ravel()], "near": near[at, best.ravel()]})

    return run


def _meet_leaves(rows: DataFrame, leaves: DataFrame, probes: int) -> DataFrame:
    """(ord, cell, near) of ``rows(ord, branch, vec)``: their best leaves in that branch."""
    parts = rows.groupBy("branch").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    left = rows.join(parts, "branch").select("branch", F.pmod(F.xxhash64("ord"), "parts").cast("int").alias("part"), "ord", "vec")
    right = leaves.join(parts, "branch").select(
        F.col("branch").alias("of"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("in"), "cell", "centre"
    )
    return left.groupBy("branch", "part").cogroup(right.groupBy("of", "in")).applyInPandas(_cells_of(probes), "ord long, cell long, near double")


def build(doc_vecs: DataFrame, cells: int | None = None, seed: int = 42) -> CellTree:
    """Fit the tree on ``doc_vecs(doc_id, first_ord, embedding)`` and give every vector its cell.

    ``cells``: leaves over all branches, about (four a root of the corpus if None).
    """
    vecs = cut_lineage(doc_vecs.select("doc_id", "first_ord", "embedding"), "tree-vectors")
    n = vecs.count()
    cells = max(1, cells or min(4 * isqrt(n), n // 40))
    wanted = max(1, min(BRANCHES, isqrt(cells)))
    train = vecs.orderBy(F.xxhash64("doc_id"), "first_ord").limit(TRAIN_ROWS)
    if wanted == 1:
        dim = vecs.select(F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()[0]
        branches = np.zeros((1, dim))
    else:
        kmeans = KMeans(k=wanted, seed=seed, initMode="random", distanceMeasure="cosine", featuresCol="features")
        model = kmeans.fit(cut_lineage(train, "tree-sample").withColumn("features", array_to_vector("embedding")))
        branches = _units(np.asarray([np.asarray(c, dtype=np.float64) for c in model.clusterCenters()]))
    shared = vecs.sparkSession.sparkContext.broadcast(branches)
    routed = vecs.withColumn("branch", F.get(_nearest_branches(shared, F.col("embedding"), 1), F.lit(0)))
    routed = cut_lineage(routed, "tree-routed")
    sizes = routed.groupBy("branch").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("branch").orderBy(F.xxhash64("doc_id"), "first_ord"))
    sample = routed.withColumn("place", place).where(F.col("place") <= TRAIN_ROWS).join(sizes, "branch")
    share = F.greatest(F.lit(1), F.round(F.col("n") * F.lit(cells) / F.lit(max(1, n)))).cast("int")
    sample = sample.select("branch", share.alias("leaves"), "embedding")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        branch = int(pdf["branch"].iloc[0])
        centres = spherical_kmeans(np.stack(pdf["embedding"].to_numpy()).astype(np.float64), int(pdf["leaves"].iloc[0]))
        cell = (np.int64(branch) << 40) + np.arange(len(centres))
        return pd.DataFrame({"cell": cell, "branch": branch, "centre": list(centres)})

    leaves = cut_lineage(sample.groupBy("branch").applyInPandas(fit, "cell long, branch int, centre array<double>"), "tree-leaves")
    mine = _meet_leaves(routed.select(F.col("first_ord").alias("ord"), "branch", F.col("embedding").alias("vec")), leaves, 1)
    vectors = routed.drop("branch").join(mine.select(F.col("ord").alias("first_ord"), "cell"), "first_ord")
    return CellTree(branches, leaves, cut_lineage(vectors.select("doc_id", "first_ord", "embedding", "cell"), "tree-cells"))


def _looks(vectors: np.ndarray, branches: np.ndarray, cells: np.ndarray, centres: np.ndarray, probes: int, p: int) -> np.ndarray:
    """(vectors, cells) matrix: a vector's best ``probes`` cells among those of its best ``p`` branches."""
    looks = np.zeros((len(vectors), len(cells)), bool)
    step = max(1, ROUTE_VALUES // max(1, len(cells)))
    for at in range(0, len(vectors), step):
        some = vectors[at : at + step]
        near = some @ centres.T
        if p < len(branches):
            mine = np.argsort(-(some @ branches.T), axis=1, kind="stable")[:, :p]
            open_ = np.zeros((len(some), len(branches)), bool)
            np.put_along_axis(open_, mine, True, axis=1)
            near[~open_[:, cells >> 40]] = -np.inf
        best = np.argsort(-near, axis=1, kind="stable")[:, : min(probes, len(cells))]
        np.put_along_axis(looks[at : at + step], best, np.take_along_axis(near, best, axis=1) > -np.inf, axis=1)
    return looks


def search(
    tree: CellTree, queries: DataFrame, top_k: int, probes: int, branches: int, query_block: int | None = None,
    n_queries: int | None = None, n_docs: int | None = None, doc_block: int | None = None,
) -> DataFrame:
    """Top-k of ``queries(query_ord, embedding)`` among the probed cells; may return fewer than k documents.

    The leaf centres go to every task as rows, ahead of the documents, and the task
    routes its queries: no row per query and cell is made.
    """
    shared = queries.sparkSession.sparkContext.broadcast(tree.branches)
    p = min(branches, len(tree.branches))

    def probe(vectors: np.ndarray, cells: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(cells)
        cells, centres = cells[order], centres[order]
        return cells, _looks(vectors, shared.value, cells, centres, probes, p)

    n_queries = queries.count() if n_queries is None else n_queries
    n_docs = tree.vectors.count() if n_docs is None else n_docs
    return passing_topk(queries, tree.vectors, top_k, n_queries, n_docs, tree.branches.shape[1], query_block, probe, tree.leaves.select("cell", "centre"))
