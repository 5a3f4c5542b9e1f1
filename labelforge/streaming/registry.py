"""Streaming queries registered next to the batch ones.

Each one derives an input stream from the driver tables: time slices, written by
Spark into a fresh folder under the shared checkpoint folder. After each slice
the Structured Streaming operator runs over what is new (``availableNow`` with
one checkpoint, so a slice is one micro-batch however many files it has), and
the sink table is returned as a DataFrame. The batch rule over the same rows is
the oracle of each.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.operators import reports
from labelforge.session import checkpoint_dir, cut_lineage
from labelforge.sources import driver
from labelforge.sources.corpus import build_corpus
from labelforge.streaming import activity, expiry, mining
from labelforge.streaming import submissions as sub_stream


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex[:12]}"


def _slices(df: DataFrame, ts_col: str, n: int = 3) -> Iterator[DataFrame]:
    """``n`` consecutive time slices of ``df``; rows without a time come first."""
    bounds = df.select(F.percentile_approx(ts_col, [i / n for i in range(1, n)]).alias("b")).first()["b"] or []
    lo = None
    for hi in [*bounds, None]:
        part = df
        if lo is not None:
            part = part.where(F.col(ts_col) > F.lit(lo))
        if hi is not None:
            inside = F.col(ts_col) <= F.lit(hi)
            part = part.where(inside | F.col(ts_col).isNull() if lo is None else inside)
        yield part
        lo = hi


def _replay(df: DataFrame, ts_col: str, root: str, run: Callable[[DataFrame], object]) -> None:
    """Append slice after slice to the stream's input folder and let ``run(stream)`` take each."""
    spark = df.sparkSession
    for part in _slices(df, ts_col):
        part.write.mode("append").parquet(f"{root}/in")
        run(spark.readStream.schema(df.schema).parquet(f"{root}/in")).awaitTermination()


def q_stream_activity(spark: SparkSession, sf: str) -> DataFrame:
    root = _scratch(spark, "activity")
    ev = driver.table(spark, sf, "events")
    # slices follow each other in time, in any order inside themselves: nothing is later than the watermark
    run = lambda s: activity.start(activity.pane_counts(s, "ts", "user_id", watermark="2 hours"), f"{root}/log", f"{root}/ck")
    _replay(ev, "ts", root, run)
    return activity.report(spark, f"{root}/log")


def _lifecycle_events(spark: SparkSession, sf: str) -> DataFrame:
    b = driver.batches(spark, sf)
    assigned = b.select(F.col("id").alias("batch_id"), F.lit("assigned").alias("event"), F.col("assigned_at").alias("ts"), "expires_at")
    closed = b.where(F.col("status") != "assigned").select(
        F.col("id").alias("batch_id"),
        F.when(F.col("status") == "completed", "completed").otherwise("released").alias("event"),
        (F.col("assigned_at") + F.expr("INTERVAL 1 HOUR")).alias("ts"),
        "expires_at",
    )
    return assigned.unionByName(closed)


def q_stream_expiry(spark: SparkSession, sf: str) -> DataFrame:
    root = _scratch(spark, "expiry")

    timers = expiry.ExpiryTimers(root)
    _replay(_lifecycle_events(spark, sf), "ts", root, lambda stream: expiry.start(stream, timers, f"{root}/ck"))
    out = timers.outcomes(spark)
    return out.select("batch_id", "status", F.col("expires_at").cast("timestamp_ntz").alias("expires_at"))


def q_stream_submissions(spark: SparkSession, sf: str) -> DataFrame:
    root = _scratch(spark, "submissions")
    # every slice and the slices' bounds read the submissions: their window runs once
    subs = cut_lineage(driver.run_submissions(spark, sf), "submissions")
    # the stored tables the stream runs against, derived once
    ann = cut_lineage(driver.annotations(spark, sf), "annotations")
    sink = sub_stream.SubmissionSink(
        f"{root}/tables",
        cut_lineage(driver.pairs(spark, sf), "pairs"),
        cut_lineage(driver.batches(spark, sf), "batches"),
        cut_lineage(driver.batch_pairs(spark, sf), "batch_pairs"),
        cut_lineage(driver.honeypots(spark, sf), "honeypots"),
        ann,
        cut_lineage(reports.contributor_totals(driver.contributors_base(spark, sf), ann), "contributors"),
    )
    _replay(subs, "submitted_at", root, lambda stream: sub_stream.start(stream, sink, f"{root}/ck"))
    return sink.results(spark).select(
        "submission_id", "batch_id", "contributor_id", "outcome", "accepted", "rejected", "honeypot_accuracy",
        "pairs_verified", "input_tokens", "output_tokens",
    )


def q_stream_mining(spark: SparkSession, sf: str) -> DataFrame:
    root = _scratch(spark, "mining")
    corpus = build_corpus(driver.conversation_rows(spark, sf))
    qs = corpus.queries
    # arrival order = query ordinal (conversation id, turn)
    from labelforge.plans.registry import CONV_CFG, ENCODER

    miner = mining.MiningStream(corpus.docs, f"{root}/pairs", CONV_CFG, ENCODER)
    arrivals = qs.withColumn("arrival", F.col("query_ord").cast("double"))
    _replay(arrivals, "arrival", root, lambda stream: mining.start(stream, miner, f"{root}/ck"))
    return spark.read.parquet(f"{root}/pairs").select(
        F.col("pair_id").alias("id"), "query_text", "doc_id", "doc_text", "source_dataset", "retrieval_method", "source_rank", "status"
    )


STREAM_QUERIES = {
    "stream_submissions": q_stream_submissions,
    "stream_activity": q_stream_activity,
    "stream_expiry": q_stream_expiry,
    "stream_mining": q_stream_mining,
}
