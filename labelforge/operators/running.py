"""Skew-safe running sums per key (cumulative totals in a given order).

A plain ``sum(...) over (partition by key order by ...)`` puts every row of a
key into one task; one contributor holding a third of all submissions would
then be summed by one task. Here each key is cut into buckets by a monotone
function of the order (for submissions: the hour of ``submitted_at``). The
window runs per (key, bucket), the per-(key, bucket) totals -- one row per
bucket -- give each bucket its offset through a second small window, and
``running = local + offset``. Everything stays deterministic and lazy: no
sampling, nothing written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sums(
    df: DataFrame, keys: list[str], order: list[Column], values: dict[str, Column], bucket: Column
) -> DataFrame:
    """Add one column per ``values`` item: the running sum up to and including the row.

    ``bucket`` must not decrease along ``order`` (e.g. the hour of the first
    order column); ``order`` must be a total order within a key.
    """
    vcols = {name: f"_v_{name}" for name in values}
    base = df.select("*", bucket.alias("_bucket"), *[expr.alias(vcols[name]) for name, expr in values.items()])
    w_local = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = base.select("*", *[F.sum(vcols[name]).over(w_local).alias(f"_l_{name}") for name in values])
    totals = base.groupBy(*keys, "_bucket").agg(*[F.sum(vcols[name]).alias(f"_t_{name}") for name in values])
    w_off = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_bucket", *[F.coalesce(F.sum(f"_t_{name}").over(w_off), F.lit(0)).alias(f"_o_{name}") for name in values]
    )
    out = local.join(offsets, [*keys, "_bucket"])
    for name in values:
        out = out.withColumn(name, F.col(f"_l_{name}") + F.col(f"_o_{name}"))
    drop = ["_bucket", *vcols.values(), *[f"_l_{n}" for n in values], *[f"_o_{n}" for n in values]]
    return out.drop(*drop)
