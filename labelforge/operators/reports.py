"""Progress reports: stats row, leaderboard, profile lookup, contributor totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.functions.time import ts_ntz

PROFILE_FIELDS = (
    "id",
    "github_username",
    "github_avatar_url",
    "reputation_score",
    "total_annotations",
    "total_input_tokens",
    "total_output_tokens",
    "created_at",
    "last_seen_at",
)


def _ts(as_of) -> Column:
    return ts_ntz(as_of)


def contributor_totals(contributors: DataFrame, annotations: DataFrame) -> DataFrame:
    """Add accepted-annotation roll-ups to contributors (zero when none)."""
    agg = annotations.groupBy(F.col("contributor_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o")
    )
    base = contributors
    for c, default in (("total_annotations", 0), ("total_input_tokens", 0), ("total_output_tokens", 0)):
        if c not in base.columns:
            base = base.withColumn(c, F.lit(default).cast("long"))
    return (
        base.join(agg, "id", "left")
        .withColumn("total_annotations", (F.col("total_annotations") + F.coalesce("n", F.lit(0))).cast("int"))
        .withColumn("total_input_tokens", (F.col("total_input_tokens") + F.coalesce("i", F.lit(0))).cast("long"))
        .withColumn("total_output_tokens", (F.col("total_output_tokens") + F.coalesce("o", F.lit(0))).cast("long"))
        .drop("n", "i", "o")
    )


def stats(pairs: DataFrame, contributors: DataFrame, annotations: DataFrame, as_of, window_hours: int = 24) -> DataFrame:
    """One-row progress report.

    Pair counts by status, contributors total/active (``last_seen_at > as_of -
    window``), token totals (null-safe), distinct pairs annotated in the window
    (honeypots included). Each part is a global aggregate with partial
    aggregation; the three one-row results are joined on a constant key.
    """
    now = _ts(as_of)
    since = now - F.expr(f"INTERVAL {int(window_hours)} HOURS")
    c = contributors.agg(
        F.count(F.lit(1)).alias("total_contributors"),
        F.count_if(F.col("last_seen_at") > since).alias("active_contributors_24h"),
        F.coalesce(F.sum("total_input_tokens"), F.lit(0)).cast("long").alias("total_input_tokens"),
        F.coalesce(F.sum("total_output_tokens"), F.lit(0)).cast("long").alias("total_output_tokens"),
    )
    a = annotations.where(F.col("created_at") > since).agg(F.count_distinct("pair_id").alias("pairs_per_day"))
    p = pairs.agg(
        F.count(F.lit(1)).alias("total_pairs"),
        F.count_if(F.col("status") == "unlabeled").alias("unlabeled_pairs"),
        F.count_if(F.col("status") == "verified").alias("verified_pairs"),
        F.count_if(F.col("status") == "rejected").alias("rejected_pairs"),
    )
    # three one-row aggregates (each with map-side partial aggregation) joined
    # on a constant key; every side is exactly one row, so it is broadcast
    one = F.lit(1).alias("_k")
    row = p.select("*", one).join(F.broadcast(c.select("*", one)), "_k").join(F.broadcast(a.select("*", one)), "_k")
    return row.select(
        "total_pairs",
        "unlabeled_pairs",
        "verified_pairs",
        "rejected_pairs",
        "active_contributors_24h",
        "total_contributors",
        "pairs_per_day",
        "total_input_tokens",
        "total_output_tokens",
    )


def clamp_limit(limit: int | None, default: int = 20, max_limit: int = 50) -> int:
    return max(1, min(default if limit is None else int(limit), max_limit))


def leaderboard(contributors: DataFrame, limit: int | None = 20, max_limit: int = 50) -> DataFrame:
    """Top contributors by ``total_annotations`` (> 0), limit clamped to 1..50.

    Ties are broken by username, then id (a total order; distributed top-n).
    """
    n = clamp_limit(limit, 20, max_limit)
    return (
        contributors.where(F.col("total_annotations") > 0)
        .orderBy(F.col("total_annotations").desc(), F.col("github_username").asc(), F.col("id").asc())
        .limit(n)
        .select("github_username", "github_avatar_url", "total_annotations")
    )


def profile(contributors: DataFrame, ids: DataFrame) -> DataFrame:
    """Profile lookup for the ``id`` values in ``ids`` (semi join, 9 fields)."""
    return contributors.join(ids.select("id"), "id", "left_semi").select(*PROFILE_FIELDS)
