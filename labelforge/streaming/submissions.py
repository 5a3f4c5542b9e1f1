"""Continuous submission processing (T1) with ``foreachBatch``.

Every micro-batch runs the set-based ``operators.submissions.process`` against
the stored tables and appends its effects to append-only logs in a table
folder: ``annotations`` (accepted rows), ``batch_done`` (completions),
``contrib_delta`` (totals), ``pair_status`` (settlements) and ``results``.
Current state = base table + logs of earlier epochs. Every log is partitioned
by epoch and written with dynamic partition overwrite, and a micro-batch reads
only epochs below its own: a replayed micro-batch sees exactly the state it
saw the first time and replaces its own partial output (exactly-once effects).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.operators import submissions as sub_ops
from labelforge.operators.votes import apply_status
from labelforge.session import cut_lineage
from labelforge.sources.sink import read_table


def _read(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    schema = schema + ", epoch long"
    df = read_table(spark, path, schema)
    if df is None:
        df = spark.createDataFrame([], schema)
    if before is not None:
        df = df.where(F.col("epoch") < before)
    return df.drop("epoch")


def _write(df: DataFrame, path: str, epoch: int) -> None:
    (
        df.withColumn("epoch", F.lit(int(epoch)).cast("long"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("epoch")
        .parquet(path)
    )


ANN_SCHEMA = (
    "pair_id long, contributor_id long, batch_id long, label short, model_id string, quantization string, "
    "input_tokens int, output_tokens int, raw_response_hash string, is_honeypot boolean, created_at timestamp_ntz"
)


class SubmissionSink:
    """State of the annotation tables as base frames + append-only logs under ``root``."""

    def __init__(self, root: str, pairs: DataFrame, batches: DataFrame, batch_pairs: DataFrame,
                 honeypots: DataFrame, annotations: DataFrame, contributors: DataFrame):
        self.root = root
        self.base = dict(pairs=pairs, batches=batches, batch_pairs=batch_pairs, honeypots=honeypots,
                         annotations=annotations, contributors=contributors)

    def _p(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def current(self, spark: SparkSession, before: int | None = None) -> dict[str, DataFrame]:
        b = self.base
        ann = b["annotations"].unionByName(
            _read(spark, self._p("annotations"), ANN_SCHEMA, before), allowMissingColumns=True
        )
        done = _read(spark, self._p("batch_done"), "id long, done_at timestamp_ntz", before).groupBy("id").agg(
            F.min("done_at").alias("done_at")
        )
        batches = (
            b["batches"].join(done, "id", "left")
            .withColumn("status", F.when(F.col("done_at").isNotNull(), F.lit("completed")).otherwise(F.col("status")))
            .drop("done_at")
        )
        delta = _read(spark, self._p("contrib_delta"), "id long, d_n long, d_in long, d_out long", before).groupBy("id").agg(
            F.sum("d_n").alias("d_n"), F.sum("d_in").alias("d_in"), F.sum("d_out").alias("d_out")
        )
        contrib = (
            b["contributors"].join(delta, "id", "left")
            .withColumn("total_annotations", (F.col("total_annotations") + F.coalesce("d_n", F.lit(0))).cast("int"))
            .withColumn("total_input_tokens", (F.col("total_input_tokens") + F.coalesce("d_in", F.lit(0))).cast("long"))
            .withColumn("total_output_tokens", (F.col("total_output_tokens") + F.coalesce("d_out", F.lit(0))).cast("long"))
            .drop("d_n", "d_in", "d_out")
        )
        st = _read(spark, self._p("pair_status"), "pair_id long, new_status string, seq long", before)
        latest = st.groupBy("pair_id").agg(F.max_by("new_status", "seq").alias("new_status"))
        pairs = apply_status(b["pairs"], latest)
        return dict(pairs=pairs, batches=batches, batch_pairs=b["batch_pairs"], honeypots=b["honeypots"],
                    annotations=ann, contributors=contrib)

    def touched(self, t: dict[str, DataFrame], micro: DataFrame) -> dict[str, DataFrame]:
        """The state that a micro-batch can meet: its pairs' and its batches' annotations, nothing else of the history.

        Of an annotation only what decisions are made of moves, and it is written
        once a micro-batch: every step of the run reads it.
        """
        state = t["annotations"].select("pair_id", "contributor_id", "batch_id", "label", "input_tokens", "output_tokens")
        pairs = micro.select("pair_id").distinct().withColumn("by_pair", F.lit(True))
        batches = micro.select("batch_id").distinct().withColumn("by_batch", F.lit(True))
        met = state.join(batches, "batch_id", "left").join(pairs, "pair_id", "left").where(F.col("by_pair") | F.col("by_batch"))
        return t | {"annotations": cut_lineage(met.select(*state.columns), "touched-annotations")}

    def process_batch(self, micro: DataFrame, epoch_id: int) -> None:
        spark = micro.sparkSession
        t = self.touched(self.current(spark, before=epoch_id), micro)
        # five outputs share the decisions: materialise them once per micro-batch
        run = sub_ops.process(micro, t["batches"], t["batch_pairs"], t["honeypots"], t["annotations"],
                              t["contributors"], t["pairs"], materialize=True)
        accepted = run.rows.where("accepted").select("submission_id", "pos")
        new_ann = (
            micro.join(accepted, ["submission_id", "pos"], "left_semi")
            .join(t["honeypots"].select("pair_id").withColumn("hp", F.lit(True)), "pair_id", "left")
            .select("pair_id", "contributor_id", "batch_id", F.col("label").cast("short").alias("label"), "model_id",
                    "quantization", "input_tokens", "output_tokens", "raw_response_hash",
                    F.coalesce("hp", F.lit(False)).alias("is_honeypot"), F.col("submitted_at").alias("created_at"))
        ).persist()
        _write(new_ann, self._p("annotations"), epoch_id)
        _write(run.results, self._p("results"), epoch_id)
        _write(
            new_ann.groupBy(F.col("contributor_id").alias("id")).agg(
                F.count(F.lit(1)).alias("d_n"), F.sum("input_tokens").cast("long").alias("d_in"),
                F.sum("output_tokens").cast("long").alias("d_out"),
            ),
            self._p("contrib_delta"),
            epoch_id,
        )
        done = run.batches.join(t["batches"].select("id", F.col("status").alias("old")), "id").where(
            (F.col("status") == "completed") & (F.col("old") != "completed")
        )
        _write(done.select("id", F.col("completed_at").alias("done_at")), self._p("batch_done"), epoch_id)
        _write(
            run.settlements.select("pair_id", "new_status", F.lit(int(epoch_id)).cast("long").alias("seq")),
            self._p("pair_status"),
            epoch_id,
        )
        new_ann.unpersist()

    def results(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self._p("results")).drop("epoch")


def start(stream: DataFrame, sink: SubmissionSink, checkpoint: str, trigger_once: bool = True):
    w = stream.writeStream.foreachBatch(sink.process_batch).option("checkpointLocation", checkpoint)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
