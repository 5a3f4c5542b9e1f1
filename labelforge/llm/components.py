"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, so the links stay distributed; each
round is written to the shared checkpoint folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelforge.session import cut_lineage


def _large_star(links: DataFrame) -> DataFrame:
    """Connect every larger neighbour of a node to the node's smallest neighbour."""
    both = links.union(links.select(F.col("v"), F.col("u"))).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Connect the smaller neighbours of a node, and the node, to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links(u, v)``; component is the smallest node.

    Links are undirected; loops and repeats do no harm, and no links give no rows.
    """
    links = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    links = cut_lineage(links.distinct(), "links")
    state = _fingerprint(links)
    while state[0]:
        links = cut_lineage(_small_star(_large_star(links)), "links")
        before, state = state, _fingerprint(links)
        if state == before:
            break
    centres = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(centres)


def _fingerprint(links: DataFrame) -> tuple:
    """Row count and an order-free checksum; two rounds agree when nothing moved any more."""
    x = F.xxhash64("u", "v").cast("decimal(38,0)")
    row = links.agg(F.count("*").alias("n"), F.sum(x).alias("s")).first()
    return row["n"], row["s"]
