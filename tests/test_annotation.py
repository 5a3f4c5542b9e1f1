import datetime as dt

import pytest
from pyspark.sql import functions as F

from labelforge import schemas
from labelforge.operators import lifecycle, planning, reports, submissions, votes
from labelforge.sources import sink

NOW = dt.datetime(2026, 3, 28, 12, 0, 0)
PAIRS_SCHEMA = (
    "id string, query_text string, doc_id string, doc_text string, source_dataset string, retrieval_method string, "
    "source_rank int, status string, required_annotations int, created_at timestamp_ntz"
)
ANN_SCHEMA = (
    "pair_id string, contributor_id string, batch_id string, label short, model_id string, quantization string, "
    "input_tokens int, output_tokens int, raw_response_hash string, is_honeypot boolean, created_at timestamp_ntz"
)
BATCH_SCHEMA = "id string, contributor_id string, size int, status string, assigned_at timestamp_ntz, expires_at timestamp_ntz, completed_at timestamp_ntz"
SUB_SCHEMA = (
    "submission_id string, pos int, batch_id string, contributor_id string, pair_id string, label int, model_id string, "
    "quantization string, input_tokens int, output_tokens int, raw_response_hash string, submitted_at timestamp_ntz"
)
CONTRIB_SCHEMA = (
    "id string, github_id long, github_username string, github_avatar_url string, reputation_score double, "
    "total_annotations int, total_input_tokens long, total_output_tokens long, created_at timestamp_ntz, last_seen_at timestamp_ntz"
)


def pairs_df(spark, n=50, status="unlabeled", required=2):
    rows = [
        (f"p{i:03d}", f"query {i}", f"d{i}", f"doc {i}", "msmarco", "bm25", i + 1, status, required, NOW + dt.timedelta(minutes=i))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, PAIRS_SCHEMA)


def empty(spark, schema):
    return spark.createDataFrame([], schema)


def ann_row(pair, contributor, label=2, model="Qwen/Qwen2.5-7B-Instruct-AWQ", batch="b0"):
    return (pair, contributor, batch, label, model, "awq", 100, 10, "sha256:x", False, NOW)


# ------------------------------------------------------------------ planning


def test_quotas():
    assert planning.quotas(1) == (1, 1, 0)
    assert planning.quotas(100) == (100, 5, 95)
    assert planning.quotas(None) == (100, 5, 95)
    assert planning.quotas(600) == (500, 25, 475)
    with pytest.raises(ValueError):
        planning.quotas(0)


def _plan(spark, pairs, ann=None, bp=None, batches=None, hp=None, contributor="c1", size=10, model=None):
    return planning.plan_batch(
        pairs,
        ann if ann is not None else empty(spark, ANN_SCHEMA),
        bp if bp is not None else empty(spark, "batch_id string, pair_id string"),
        batches if batches is not None else empty(spark, BATCH_SCHEMA),
        hp if hp is not None else empty(spark, "pair_id string, known_label short, created_at timestamp_ntz"),
        contributor,
        size,
        model,
        batch_id="B",
    )


def test_claim_oldest_first_and_blind(spark):
    got = _plan(spark, pairs_df(spark)).collect()
    assert sorted(r.pair_id for r in got) == [f"p{i:03d}" for i in range(10)]
    assert not any(r.is_honeypot for r in got)
    assert sorted(r.position for r in got) == list(range(1, 11))


def test_claim_excludes_assigned_and_own(spark):
    p = pairs_df(spark)
    batches = spark.createDataFrame([("bA", "c2", 3, "assigned", NOW, NOW, None), ("bX", "c2", 1, "expired", NOW, NOW, None)], BATCH_SCHEMA)
    bp = spark.createDataFrame([("bA", "p000"), ("bA", "p001"), ("bX", "p002")], "batch_id string, pair_id string")
    ann = spark.createDataFrame([ann_row("p003", "c1")], ANN_SCHEMA)
    got = {r.pair_id for r in _plan(spark, p, ann=ann, bp=bp, batches=batches, size=3).collect()}
    assert got == {"p002", "p004", "p005"}


def test_claim_honeypots_and_deficit(spark):
    p = pairs_df(spark, 30)
    hp = spark.createDataFrame([("p020", 1, NOW)], "pair_id string, known_label short, created_at timestamp_ntz")
    got = _plan(spark, p, hp=hp, size=40).collect()
    pools = [r.pool for r in got]
    assert pools.count("honeypot") == 1 and len(got) == 30  # deficit filled with regular pairs


def test_claim_steering_prefers_other_families(spark):
    p = pairs_df(spark, 6)
    ann = spark.createDataFrame(
        [ann_row("p000", "x1", model="Qwen/Qwen2.5-7B"), ann_row("p001", "x2", model="meta-llama/Llama-3.1-8B")], ANN_SCHEMA
    )
    got = [r.pair_id for r in _plan(spark, p, ann=ann, size=5, model="mlx-community/Qwen2.5-7B-4bit").orderBy("pair_id").collect()]
    assert "p000" not in got and "p001" in got
    full = {r.pair_id for r in _plan(spark, p, ann=ann, size=6, model="Qwen/Qwen2.5").collect()}
    assert "p000" in full  # same-family pairs fill the shortfall, last


def test_claim_unknown_family_unsteered(spark):
    p = pairs_df(spark, 3)
    ann = spark.createDataFrame([ann_row("p000", "x1", model="Qwen/Qwen2.5-7B")], ANN_SCHEMA)
    got = {r.pair_id for r in _plan(spark, p, ann=ann, size=1, model="some-org/UnknownNet-7B").collect()}
    assert got == {"p000"}


def test_claim_empty_pool(spark):
    assert _plan(spark, pairs_df(spark, 3, status="verified")).count() == 0


# ------------------------------------------------------------------ votes


@pytest.mark.parametrize(
    "labels,status", [([2, 2], "verified"), ([2, 3], "verified"), ([0, 1], "verified"), ([1, 2], "rejected"), ([3], None)]
)
def test_vote_truth_table(spark, labels, status):
    p = pairs_df(spark, 1)
    ann = spark.createDataFrame([ann_row("p000", f"c{i}", label=l) for i, l in enumerate(labels)], ANN_SCHEMA)
    hp = empty(spark, "pair_id string, known_label short, created_at timestamp_ntz")
    d = votes.settle(p, ann, hp).collect()
    assert (d[0].new_status if d else None) == status


def test_honeypots_never_settle(spark):
    p = pairs_df(spark, 1)
    ann = spark.createDataFrame([ann_row("p000", "c1"), ann_row("p000", "c2")], ANN_SCHEMA)
    hp = spark.createDataFrame([("p000", 2, NOW)], "pair_id string, known_label short, created_at timestamp_ntz")
    assert votes.settle(p, ann, hp).count() == 0
    chk = votes.honeypot_check(spark.createDataFrame([("p000", 2), ("p000", 1), ("p999", 0)], "pair_id string, label int"), hp)
    assert sorted((r.label, r.passed) for r in chk.collect()) == [(0, True), (1, False), (2, True)]


# ------------------------------------------------------------------ submissions


def _world(spark, batch_status="assigned", owner="c1", n=5):
    p = pairs_df(spark, n)
    batches = spark.createDataFrame([("b1", owner, n, batch_status, NOW, NOW + dt.timedelta(hours=24), None)], BATCH_SCHEMA)
    bp = spark.createDataFrame([("b1", f"p{i:03d}") for i in range(n)], "batch_id string, pair_id string")
    hp = spark.createDataFrame([("p004", 2, NOW)], "pair_id string, known_label short, created_at timestamp_ntz")
    contrib = spark.createDataFrame(
        [("c1", 12345, "testuser", None, 0.5, 0, 0, 0, NOW, NOW), ("c2", 99999, "testuser2", None, 0.5, 0, 0, 0, NOW, NOW)], CONTRIB_SCHEMA
    )
    return p, batches, bp, hp, contrib


def _subs(spark, items, sid="s1", batch="b1", contributor="c1", ts=NOW):
    rows = [(sid, i, batch, contributor, pid, lab, "qwen2.5", "awq", 100, 10, "sha256:" + pid) for i, (pid, lab) in enumerate(items)]
    return spark.createDataFrame([r + (ts,) for r in rows], SUB_SCHEMA)


def _process(spark, subs, world, ann=None):
    p, batches, bp, hp, contrib = world
    return submissions.process(subs, batches, bp, hp, ann if ann is not None else empty(spark, ANN_SCHEMA), contrib, p)


def test_submission_accepts_and_counts(spark):
    w = _world(spark)
    run = _process(spark, _subs(spark, [("p000", 2), ("p001", 2), ("p002", 2), ("p004", 2)]), w)
    r = run.results.first()
    assert (r.outcome, r.accepted, r.rejected, r.input_tokens, r.output_tokens) == ("ok", 4, 0, 400, 40)
    assert r.honeypot_accuracy == 1.0
    c = {x.id: x for x in run.contributors.collect()}
    assert c["c1"].total_annotations == 4 and c["c1"].total_input_tokens == 400
    assert run.batches.first().status == "completed"


def test_submission_duplicate_rejected(spark):
    w = _world(spark)
    run = _process(spark, _subs(spark, [("p000", 2), ("p001", 2), ("p002", 2), ("p000", 3)]), w)
    r = run.results.first()
    assert (r.accepted, r.rejected) == (3, 1)
    reasons = sorted(x.reason for x in run.rows.collect() if x.reason)
    assert reasons == ["duplicate"]


def test_submission_gates(spark):
    assert _process(spark, _subs(spark, [("p000", 2)]), _world(spark, owner="c2")).results.first().outcome == "forbidden"
    assert _process(spark, _subs(spark, [("p000", 2)], batch="nope"), _world(spark)).results.first().outcome == "not_found"
    assert _process(spark, _subs(spark, [("p000", 2)]), _world(spark, "expired")).results.first().outcome == "invalid_status"
    assert _process(spark, _subs(spark, [("p000", 7)]), _world(spark)).results.first().outcome == "invalid_label"


def test_submission_not_in_batch_and_conflict(spark):
    w = _world(spark)
    stored = spark.createDataFrame([ann_row("p001", "c1", batch="b0")], ANN_SCHEMA)
    run = _process(spark, _subs(spark, [("p000", 2), ("p001", 2), ("zzz", 1)]), w, ann=stored)
    r = run.results.first()
    assert (r.accepted, r.rejected) == (1, 2)
    assert sorted(x.reason for x in run.rows.collect() if x.reason) == ["conflict", "not_in_batch"]


def test_replay_after_completion_and_pairs_verified(spark):
    w = _world(spark)
    stored = spark.createDataFrame([ann_row("p000", "c2", batch="bz")], ANN_SCHEMA)
    s1 = _subs(spark, [("p000", 2), ("p001", 3)], sid="s1")
    s2 = _subs(spark, [("p002", 2)], sid="s2", ts=NOW + dt.timedelta(minutes=5))
    run = _process(spark, s1.unionByName(s2), w, ann=stored)
    res = {r.submission_id: r for r in run.results.collect()}
    assert res["s1"].outcome == "ok" and res["s1"].pairs_verified == 1  # p000 reaches 2 annotations
    assert res["s2"].outcome == "replay" and res["s2"].accepted == 2 and res["s2"].rejected == 0
    assert {r.id: r.status for r in run.pairs.collect()}["p000"] == "verified"


def test_zero_accept_submission_does_not_complete(spark):
    w = _world(spark)
    run = _process(spark, _subs(spark, [("zzz", 2)]), w)
    assert run.results.first().accepted == 0 and run.batches.first().status == "assigned"


def test_null_label_rejects_the_submission(spark):
    r = _process(spark, _subs(spark, [("p000", 2), ("p001", None)]), _world(spark)).results.first()
    assert r.outcome == "invalid_label"


def test_submission_that_loses_every_row_completes_nothing(spark):
    """b1 wins both shared pairs; b2's first submission gets none, so its second one is not a replay."""
    p, _, _, hp, contrib = _world(spark)
    end = NOW + dt.timedelta(hours=24)
    batches = spark.createDataFrame([(b, "c1", 3, "assigned", NOW, end, None) for b in ("b1", "b2")], BATCH_SCHEMA)
    bp = spark.createDataFrame([(b, f"p{i:03d}") for b in ("b1", "b2") for i in range(4)], "batch_id string, pair_id string")
    later = [NOW + dt.timedelta(minutes=m) for m in range(4)]
    subs = (
        _subs(spark, [("p000", 2), ("p001", 2)], sid="s1", batch="b1", ts=later[0])
        .unionByName(_subs(spark, [("p000", 1), ("p001", 1)], sid="s2", batch="b2", ts=later[1]))
        .unionByName(_subs(spark, [("p001", 1), ("p002", 1)], sid="s3", batch="b2", ts=later[2]))
        .unionByName(_subs(spark, [("p003", 1)], sid="s4", batch="b2", ts=later[3]))
    )
    run = _process(spark, subs, (p, batches, bp, hp, contrib))
    res = {r.submission_id: (r.outcome, r.accepted) for r in run.results.collect()}
    assert res == {"s1": ("ok", 2), "s2": ("ok", 0), "s3": ("ok", 1), "s4": ("replay", 1)}
    assert {r.id: r.status for r in run.batches.collect()} == {"b1": "completed", "b2": "completed"}


def test_claims_of_one_contributor_have_their_own_ids(spark):
    args = (pairs_df(spark), empty(spark, ANN_SCHEMA), empty(spark, "batch_id string, pair_id string"), empty(spark, BATCH_SCHEMA),
            empty(spark, "pair_id string, known_label short, created_at timestamp_ntz"), "c1", 2)
    ids = [planning.plan_batch(*args, request_id=r).first().batch_id for r in ("r1", "r1", "r2")]
    assert ids[0] == ids[1] != ids[2]
    with pytest.raises(ValueError):
        planning.plan_batch(*args)


# ------------------------------------------------------------------ lifecycle


def test_expire_is_strict(spark):
    b = spark.createDataFrame(
        [("b1", "c1", 5, "assigned", NOW, NOW - dt.timedelta(hours=1), None), ("b2", "c1", 5, "assigned", NOW, NOW, None),
         ("b3", "c1", 5, "completed", NOW, NOW - dt.timedelta(hours=1), None)],
        BATCH_SCHEMA,
    )
    assert lifecycle.expired_count(b, NOW).first()[0] == 1
    assert {r.id: r.status for r in lifecycle.expire(b, NOW).collect()} == {"b1": "expired", "b2": "assigned", "b3": "completed"}


def test_release_outcomes(spark):
    b = spark.createDataFrame(
        [("b1", "c1", 5, "assigned", NOW, NOW, None), ("b2", "c1", 5, "completed", NOW, NOW, None)], BATCH_SCHEMA
    )
    reqs = spark.createDataFrame(
        [("b1", "c2", 1), ("b1", "c1", 3), ("b1", "c1", 2), ("b2", "c1", 1), ("b9", "c1", 1)],
        "batch_id string, contributor_id string, requested_at int",
    )
    out, nb = lifecycle.release(b, reqs)
    got = sorted((r.batch_id, r.contributor_id, r.requested_at, r.outcome) for r in out.collect())
    assert got == [
        ("b1", "c1", 2, "released"), ("b1", "c1", 3, "noop"), ("b1", "c2", 1, "forbidden"), ("b2", "c1", 1, "noop"), ("b9", "c1", 1, "not_found")
    ]
    assert {r.id: r.status for r in nb.collect()} == {"b1": "expired", "b2": "completed"}


# ------------------------------------------------------------------ reports


def test_stats_counts_and_tokens(spark):
    rows = [(f"p{i}", "q", "d", "t", "s", "m", 1, st, 2, NOW) for i, st in enumerate(["unlabeled"] * 7 + ["verified"] * 2 + ["rejected"])]
    p = spark.createDataFrame(rows, PAIRS_SCHEMA)
    c = spark.createDataFrame(
        [(f"c{i}", i, f"u{i}", None, 0.5, 1, 5000 * (i + 1), 500 * (i + 1), NOW, NOW - dt.timedelta(days=3 * i)) for i in range(2)],
        CONTRIB_SCHEMA,
    )
    ann = spark.createDataFrame([ann_row("p0", "c0"), ann_row("p0", "c1"), ann_row("p1", "c0")], ANN_SCHEMA)
    s = reports.stats(p, c, ann, NOW + dt.timedelta(hours=1)).first()
    assert (s.total_pairs, s.unlabeled_pairs, s.verified_pairs, s.rejected_pairs) == (10, 7, 2, 1)
    assert (s.total_input_tokens, s.total_output_tokens) == (15000, 1500)
    assert (s.active_contributors_24h, s.total_contributors, s.pairs_per_day) == (1, 2, 2)


def test_leaderboard_order_and_clamp(spark):
    c = spark.createDataFrame(
        [(f"c{i}", i, f"u{i:02d}", None, 0.5, t, 0, 0, NOW, NOW) for i, t in enumerate([100, 500, 250, 0])], CONTRIB_SCHEMA
    )
    assert [r.total_annotations for r in reports.leaderboard(c).collect()] == [500, 250, 100]
    many = spark.createDataFrame([(f"c{i}", i, f"u{i:02d}", None, 0.5, i + 1, 0, 0, NOW, NOW) for i in range(55)], CONTRIB_SCHEMA)
    assert reports.leaderboard(many, 100).count() == 50
    assert reports.leaderboard(many, -1).count() == 1 and reports.leaderboard(many, 0).count() == 1


# ------------------------------------------------------------------ sinks / schemas


def test_insert_ignore_existing_wins_first_dup_wins(spark):
    new = spark.createDataFrame([("id1", "a", 2), ("id1", "b", 1), ("id2", "c", 3)], "id string, v string, query_ord long")
    existing = spark.createDataFrame([("id2", "old", 0)], "id string, v string, query_ord long")
    res = sink.insert_ignore(new, existing, "id", "query_ord", forced={"status": "unlabeled"})
    rows = res.rows.collect()
    assert [(r.id, r.v, r.status) for r in rows] == [("id1", "b", "unlabeled")]
    one = new.select(F.lit(1))
    assert one.select(res.attempted, res.inserted).first() == (3, 1)
    again = sink.insert_ignore(new, existing.unionByName(res.rows.drop("status")), "id", "query_ord")
    assert again.rows.count() == 0


def test_profile_upsert(spark):
    c = spark.createDataFrame([("c1", 11111, "user_v1", None, 0.5, 7, 10, 1, NOW, NOW)], CONTRIB_SCHEMA)
    logins = spark.createDataFrame(
        [(11111, "user_v2", "http://a", NOW + dt.timedelta(days=1)), (22222, "new", None, NOW)],
        "github_id long, github_username string, github_avatar_url string, login_at timestamp_ntz",
    )
    out = {r.github_id: r for r in sink.upsert_profiles(c, logins).collect()}
    assert out[11111].github_username == "user_v2" and out[11111].total_annotations == 7
    assert out[11111].created_at == NOW and out[11111].last_seen_at == NOW + dt.timedelta(days=1)
    assert out[22222].reputation_score == 0.5 and out[22222].total_annotations == 0


def test_defaults_and_validation(spark):
    df = spark.createDataFrame([("p1", "q", "d", "t", "s", "m", None, None, None), ("p2", "q", "d", "t", "s", "m", 1, "bogus", 3)],
                               "id string, query_text string, doc_id string, doc_text string, source_dataset string, "
                               "retrieval_method string, source_rank int, status string, required_annotations int")
    full = schemas.with_defaults(df, "pairs", as_of=NOW)
    first = full.where("id = 'p1'").first()
    assert (first.status, first.required_annotations, first.created_at) == ("unlabeled", 2, NOW)
    valid, bad = schemas.validate(full, schemas.rules("pairs"))
    assert valid.count() == 1 and bad.first().failed == ["status_domain"]
