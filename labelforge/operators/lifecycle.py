"""Batch lifecycle: early release and expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelforge.functions.time import ts_ntz


def _ts(as_of) -> Column:
    return ts_ntz(as_of)


def expire(batches: DataFrame, as_of) -> DataFrame:
    """New ``batches``: assigned and ``expires_at < as_of`` (strict) -> expired.

    Adds ``expired_now`` so the affected count is ``count_if(expired_now)``.
    """
    now = _ts(as_of)
    hit = (F.col("status") == "assigned") & (F.col("expires_at") < now)
    return batches.withColumn("expired_now", hit).withColumn(
        "status", F.when(hit, F.lit("expired")).otherwise(F.col("status"))
    )


def expired_count(batches: DataFrame, as_of) -> DataFrame:
    return expire(batches, as_of).agg(F.count_if("expired_now").alias("expired"))


def release(batches: DataFrame, releases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Early release of batches by their owners.

    ``releases(batch_id, contributor_id, requested_at)``. Outcome per request:
    ``not_found``, ``forbidden`` (other owner), ``noop`` (already expired or
    completed) or ``released`` (assigned -> expired). Returns ``(outcomes,
    new_batches)``. The owner's first request, by ``requested_at``, releases a
    batch; the owner's later ones find it expired (``noop``).
    """
    b = batches.select(
        F.col("id").alias("batch_id"), F.col("contributor_id").alias("owner_id"), F.col("status").alias("batch_status")
    )
    turn = F.row_number().over(Window.partitionBy("batch_id", "contributor_id").orderBy("requested_at"))
    outcomes = (
        releases.join(b, "batch_id", "left")
        .withColumn("turn", turn)
        .withColumn(
            "outcome",
            F.when(F.col("owner_id").isNull(), "not_found")
            .when(F.col("owner_id") != F.col("contributor_id"), "forbidden")
            .when((F.col("batch_status") != "assigned") | (F.col("turn") > 1), "noop")
            .otherwise("released"),
        )
    )
    released = outcomes.where(F.col("outcome") == "released").select(F.col("batch_id").alias("id")).distinct()
    new_batches = (
        batches.join(released.withColumn("rel", F.lit(True)), "id", "left")
        .withColumn("status", F.when(F.col("rel"), F.lit("expired")).otherwise(F.col("status")))
        .drop("rel")
    )
    return outcomes.drop("owner_id", "batch_status", "turn"), new_batches
