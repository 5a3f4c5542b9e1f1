"""Batch == streaming equality for the stateful streams."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from labelforge.operators import lifecycle
from labelforge.plans import registry
from labelforge.sources import driver
from labelforge.sources import sink as sink_tables
from labelforge.streaming import activity, mining
from labelforge.streaming import registry as streams
from labelforge.streaming import submissions as sub_stream
from tests.conftest import SF_SMALL

COLS = ["submission_id", "outcome", "accepted", "rejected", "pairs_verified", "input_tokens", "output_tokens"]


def test_stream_submissions_equal_batch_run(spark):
    s = streams.q_stream_submissions(spark, SF_SMALL).select(*COLS).toPandas()
    b = registry.q_submission_results(spark, SF_SMALL).select(*COLS).toPandas()
    key = ["submission_id"]
    assert s.sort_values(key).reset_index(drop=True).equals(b.sort_values(key).reset_index(drop=True))


def test_stream_expiry_matches_batch_expire(spark):
    out = streams.q_stream_expiry(spark, SF_SMALL)
    expired = {r.batch_id for r in out.where(F.col("status") == "expired").collect()}
    b = driver.batches(spark, SF_SMALL)
    # the stream's watermark ends at the last event; batch form with the same "now"
    last = streams._lifecycle_events(spark, SF_SMALL).agg(F.max("ts")).first()[0]
    want = {r.id for r in lifecycle.expire(b, last).where("expired_now").collect()}
    assert expired == want


def test_stream_mining_equals_batch(spark):
    s = streams.q_stream_mining(spark, SF_SMALL).select("id", "source_rank").toPandas()
    b = registry.q_insert_ignore(spark, SF_SMALL).select("id", "source_rank").toPandas()
    assert sorted(map(tuple, s.values.tolist())) == sorted(map(tuple, b.values.tolist()))


def test_stream_activity_windows(spark):
    out = streams.q_stream_activity(spark, SF_SMALL).toPandas()
    assert len(out) > 0 and (out.active > 0).all() and not out.duplicated("window_start").any()


def test_rolling_windows_match_brute_force(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(80) * 3600, rng.choice(["a", "b", "c", None]), rng.randrange(1, 5)) for _ in range(60)]
    rows = sorted({(p, k): (p, k, n) for p, k, n in rows}.values(), key=str)
    got = activity.rolling(spark.createDataFrame(rows, "pane long, key string, events long")).collect()
    exp = {}
    for at in range(-23 * 3600, 81 * 3600, 3600):
        inside = [r for r in rows if at <= r[0] < at + 24 * 3600]
        if inside:
            exp[at] = (len({k for _, k, _ in inside if k is not None}), sum(n for *_, n in inside))
    start = datetime(1970, 1, 1)
    assert {int((r.window_start - start).total_seconds()): (r.active, r.events) for r in got} == exp
    assert all(r.window_end - r.window_start == timedelta(hours=24) for r in got)


def test_activity_drops_events_later_than_the_watermark(spark, tmp_path):
    hour = lambda h, n: [(datetime(2024, 1, 1) + timedelta(hours=h, minutes=m), f"k{m}") for m in range(n)]
    for rows in (hour(0, 3) + hour(10, 2), hour(11, 1), hour(1, 5) + hour(9, 4) + hour(10, 3)):
        spark.createDataFrame(rows, "ts timestamp_ntz, key string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("ts timestamp_ntz, key string").parquet(f"{tmp_path}/in")
        activity.start(activity.pane_counts(stream, "ts", "key", "2 hours"), f"{tmp_path}/log", f"{tmp_path}/ck").awaitTermination()
    got = {r.window_start.hour: r.events for r in activity.report(spark, f"{tmp_path}/log", panes=1).collect()}
    assert got == {0: 3, 9: 4, 10: 5, 11: 1}  # hour 1 ended over two hours before 11:00


def _uri_sink(spark, tmp_path):
    pairs = spark.createDataFrame([(1, "unlabeled", 2)], "id long, status string, required_annotations int")
    batches = spark.createDataFrame([(7, 5, "assigned")], "id long, contributor_id long, status string").withColumn(
        "completed_at", F.lit(None).cast("timestamp_ntz")
    )
    links = spark.createDataFrame([(7, 1)], "batch_id long, pair_id long")
    honeypots = spark.createDataFrame([], "pair_id long, known_label short")
    annotations = spark.createDataFrame([], sub_stream.ANN_SCHEMA)
    contributors = spark.createDataFrame(
        [(5, 0, 0, 0)], "id long, total_annotations int, total_input_tokens long, total_output_tokens long"
    )
    return sub_stream.SubmissionSink(f"file:{tmp_path}/tables", pairs, batches, links, honeypots, annotations, contributors)


def test_submission_state_outlives_an_epoch_on_a_uri_path(spark, tmp_path):
    """The second epoch must see the first one's completion: replay, no second annotation."""
    sink = _uri_sink(spark, tmp_path)
    micro = spark.createDataFrame(
        [(1, 0, 7, 5, 1, 2, "m", "q", 10, 1, "h")],
        "submission_id long, pos int, batch_id long, contributor_id long, pair_id long, label int, model_id string, "
        "quantization string, input_tokens int, output_tokens int, raw_response_hash string",
    ).withColumn("submitted_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    sink.process_batch(micro, 0)
    sink.process_batch(micro.withColumn("submission_id", F.lit(2).cast("long")), 1)
    got = {r.submission_id: r.outcome for r in sink.results(spark).collect()}
    assert got == {1: "ok", 2: "replay"}
    assert sink.current(spark)["annotations"].count() == 1


def test_mined_pairs_outlive_an_epoch_on_a_uri_path(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", i, f"text {i} of a document") for i in range(4)], "doc_id string, first_ord long, doc_text string")
    miner = mining.MiningStream(docs, f"file:{tmp_path}/pairs", registry.CONV_CFG, registry.ENCODER)
    q = spark.createDataFrame([(0, "text 1", None)], "query_ord long, query_text string, positive_doc_id string")
    for epoch in (0, 1):
        miner.process_batch(q.withColumn("query_ord", F.lit(epoch).cast("long")), epoch)
    stored = spark.read.parquet(f"file:{tmp_path}/pairs")
    assert stored.count() == stored.select("pair_id").distinct().count() == 4


def test_missing_table_reads_as_none_on_any_path(spark, tmp_path):
    assert sink_tables.read_table(spark, f"file:{tmp_path}/nothing") is None
    assert sink_tables.read_table(spark, f"{tmp_path}/nothing") is None
    sink_tables.append_table(spark.range(3), f"file:{tmp_path}/t")
    assert sink_tables.read_table(spark, f"file:{tmp_path}/t").count() == 3
