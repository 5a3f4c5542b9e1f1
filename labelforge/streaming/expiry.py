"""Batch expiry timers over a stream (T3).

Input: batch lifecycle events ``(batch_id, event, ts, expires_at)`` with
``event`` in assigned / completed / released. The state is one row per open
assignment, its deadline; an ``expired`` row goes out when the watermark (the
latest ``ts`` seen, less a delay) passes ``expires_at`` (strict: watermark >
deadline). Completion or release clears the timer. This replaces the hourly sweep;
the batch form is ``operators.lifecycle.expire``.

Every micro-batch is one window over its events and the open deadlines of the epoch
before, so no batch costs a call of its own. State and output are logs partitioned
by epoch and written with dynamic partition overwrite; a replayed micro-batch reads
the state that it read the first time and replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelforge.session import cut_lineage
from labelforge.sources.sink import read_table
from labelforge.streaming.submissions import _read, _write

OUTPUT_SCHEMA = "batch_id long, status string, expires_at timestamp"
STATE_SCHEMA = "batch_id long, expires_at timestamp"


class ExpiryTimers:
    """Open deadlines, the watermark and the outcomes as logs under ``root``."""

    def __init__(self, root: str, watermark: str = "0 seconds"):
        self.root, self.delay = root.rstrip("/"), F.expr(f"INTERVAL {watermark}")

    def process_batch(self, events: DataFrame, epoch_id: int) -> None:
        spark = events.sparkSession
        seen = _read(spark, f"{self.root}/seen", "latest timestamp", epoch_id).agg(F.max("latest")).first()[0]
        before = self.open(spark, epoch_id - 1)
        ev = events.select(
            F.col("batch_id").cast("long").alias("batch_id"), "event", F.col("ts").cast("timestamp").alias("ts"),
            F.col("expires_at").cast("timestamp").alias("expires_at"),
        )
        if seen is not None:  # later than the watermark: dropped
            ev = ev.where(~F.coalesce(F.col("ts") <= F.lit(seen) - self.delay, F.lit(False)))
        held = before.select("batch_id", F.lit("assigned").alias("event"), F.lit(None).cast("timestamp").alias("ts"), "expires_at")
        rows = held.withColumn("new", F.lit(False)).unionByName(ev.withColumn("new", F.lit(True)))
        w = Window.partitionBy("batch_id").orderBy("new", F.col("ts").asc_nulls_last(), "event")
        rows = rows.withColumn("prior", F.lag("event").over(w)).withColumn("next", F.lead("event").over(w))
        # an event other than an assignment closes one that is open; the last row tells what stays open
        rows = rows.withColumn("closes", (F.col("event") != "assigned") & F.coalesce(F.col("prior") == "assigned", F.lit(False)))
        rows = rows.withColumn("stays", (F.col("event") == "assigned") & F.col("next").isNull())
        rows = cut_lineage(rows.where("closes or stays or new"), "expiry-rows")
        latest = rows.where("new").agg(F.max("ts")).first()[0]
        latest = max((x for x in (seen, latest) if x is not None), default=None)
        due = F.lit(False) if latest is None else F.coalesce(F.col("expires_at") < F.lit(latest) - self.delay, F.lit(False))
        status = F.when(F.col("stays"), "expired").when(F.col("event") == "completed", "completed").otherwise("released")
        out = rows.where(F.col("closes") | (F.col("stays") & due)).select("batch_id", status.alias("status"), "expires_at")
        _write(out, f"{self.root}/out", epoch_id)
        _write(rows.where(F.col("stays") & ~due).select("batch_id", "expires_at"), f"{self.root}/open", epoch_id)
        _write(spark.range(1).select(F.lit(latest).cast("timestamp").alias("latest")), f"{self.root}/seen", epoch_id)

    def open(self, spark: SparkSession, epoch: int) -> DataFrame:
        """The assignments that were open after ``epoch``."""
        rows = read_table(spark, f"{self.root}/open", STATE_SCHEMA + ", epoch long")
        if rows is None:
            rows = spark.createDataFrame([], STATE_SCHEMA + ", epoch long")
        return rows.where(F.col("epoch") == epoch).drop("epoch")

    def outcomes(self, spark: SparkSession) -> DataFrame:
        return _read(spark, f"{self.root}/out", OUTPUT_SCHEMA)


def start(events: DataFrame, timers: ExpiryTimers, checkpoint: str):
    w = events.writeStream.foreachBatch(timers.process_batch).option("checkpointLocation", checkpoint)
    return w.trigger(availableNow=True).start()
