"""Honeypot checks and pair settlement by binary majority vote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def honeypot_check(labels: DataFrame, honeypots: DataFrame) -> DataFrame:
    """Add ``passed``: true for non-honeypots, else ``known_label = label``.

    ``labels`` needs ``pair_id`` and ``label``. The honeypot table is one row
    per pair; Catalyst picks broadcast or shuffle join by its size.
    """
    hp = honeypots.select("pair_id", "known_label")
    return labels.join(hp, "pair_id", "left").withColumn(
        "passed", F.coalesce(F.col("known_label").cast("int") == F.col("label").cast("int"), F.lit(True))
    )


def vote(n: Column, relevant: Column) -> Column:
    """Labels 2-3 are relevant, 0-1 not; majority wins, an exact tie rejects."""
    return F.when(F.lit(2) * relevant == n, F.lit("rejected")).otherwise(F.lit("verified"))


def settle(
    pairs: DataFrame,
    annotations: DataFrame,
    honeypots: DataFrame,
    touched: DataFrame | None = None,
) -> DataFrame:
    """Settlement decisions ``(pair_id, n_annotations, relevant_votes, new_status)``.

    A pair settles when it is no honeypot and has at least
    ``required_annotations`` annotations; the current status is not checked,
    so a settled pair is re-voted when it gains annotations. ``touched``
    (optional ``pair_id`` frame) limits the work to pairs that changed.
    """
    ann = annotations.select("pair_id", "label")
    if touched is not None:
        ann = ann.join(touched.select("pair_id").distinct(), "pair_id", "left_semi")
    counts = ann.groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("n_annotations"), F.count_if(F.col("label") >= 2).alias("relevant_votes")
    )
    eligible = (
        pairs.select(F.col("id").alias("pair_id"), "required_annotations")
        .join(counts, "pair_id")
        .join(honeypots.select("pair_id"), "pair_id", "left_anti")
        .where(F.col("n_annotations") >= F.col("required_annotations"))
    )
    return eligible.select(
        "pair_id",
        "n_annotations",
        "relevant_votes",
        vote(F.col("n_annotations"), F.col("relevant_votes")).alias("new_status"),
    )


def apply_status(pairs: DataFrame, decisions: DataFrame) -> DataFrame:
    """New version of ``pairs`` with settled statuses applied."""
    d = decisions.select(F.col("pair_id").alias("id"), "new_status")
    return (
        pairs.join(d, "id", "left")
        .withColumn("status", F.coalesce(F.col("new_status"), F.col("status")))
        .drop("new_status")
    )
