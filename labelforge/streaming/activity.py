"""Rolling activity over an event stream (T2).

The stream counts events per (hour, key): one row of state per event, not one for
each of the 24 windows that an event is in, and an hour's state goes as soon as
the watermark has passed it. State is spread over keys, so a popular hour is no
hot group. After every micro-batch the changed counters go to a log partitioned
by epoch. ``report`` makes the 24-hour windows, advanced hourly, of the latest
counter per (hour, key): exact distinct counts at any time, for windows that are
still open as well. An event later than the watermark is dropped (a rule the
batch report does not have).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelforge.sources.sink import read_table

#: Length of a pane, and of the advance of a window, in seconds.
PANE = 3600

LOG_SCHEMA = "pane long, key string, events long, epoch long"


def pane_counts(events: DataFrame, ts_col: str, key_col: str, watermark: str = "1 hour") -> DataFrame:
    """``(pane, key, events)`` per hour and key; ``pane`` is the hour's first second, null keys are counted as a key."""
    ev = events.withColumn("_et", F.col(ts_col).cast("timestamp"))
    if events.isStreaming:
        ev = ev.withWatermark("_et", watermark)
    agg = ev.groupBy(F.window("_et", f"{PANE} seconds").alias("w"), F.col(key_col).cast("string").alias("key")).agg(
        F.count(F.lit(1)).alias("events")
    )
    return agg.select(F.unix_timestamp("w.start").alias("pane"), "key", "events")


def start(counts: DataFrame, log_path: str, checkpoint: str):
    """Write the changed counters of every micro-batch to its epoch of the log."""

    def write(changed: DataFrame, epoch_id: int) -> None:
        (
            changed.withColumn("epoch", F.lit(int(epoch_id)).cast("long"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("epoch")
            .parquet(log_path)
        )

    w = counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return w.trigger(availableNow=True).start()


def report(spark: SparkSession, log_path: str, panes: int = 24) -> DataFrame:
    """``(window_start, window_end, active, events)``: exact counts per window of ``panes`` hours from the log."""
    log = read_table(spark, log_path, LOG_SCHEMA)
    if log is None:
        log = spark.createDataFrame([], LOG_SCHEMA)
    return rolling(log.groupBy("pane", "key").agg(F.max_by("events", "epoch").alias("events")), panes)


def rolling(counts: DataFrame, panes: int = 24) -> DataFrame:
    """Windows of ``panes`` hours over ``counts(pane, key, events)``.

    A key is counted once a window: a pane stands for the windows that it is in
    and the key's pane before isn't.
    """
    reach = (panes - 1) * PANE
    before = F.lag("pane").over(Window.partitionBy("key").orderBy("pane"))
    # null keys are events of nobody
    named = counts.where(F.col("key").isNotNull()).select("pane", before.alias("before"))
    first = F.greatest(F.col("pane") - reach, F.coalesce(F.col("before") + PANE, F.col("pane") - reach))
    each = F.explode(F.sequence(first, F.col("pane"), F.lit(PANE).cast("long"))).alias("at")
    active = named.select(each, F.lit(1).alias("active"), F.lit(0).alias("events"))
    sums = counts.groupBy("pane").agg(F.sum("events").alias("events"))
    events = sums.select(F.explode(F.sequence(F.col("pane") - reach, F.col("pane"), F.lit(PANE).cast("long"))).alias("at"), F.lit(0).alias("active"), "events")
    windows = active.union(events).groupBy("at").agg(F.sum("active").alias("active"), F.sum("events").alias("events"))
    time = lambda seconds: F.timestamp_seconds(seconds).cast("timestamp_ntz")
    return windows.select(time(F.col("at")).alias("window_start"), time(F.col("at") + panes * PANE).alias("window_end"), "active", "events")
