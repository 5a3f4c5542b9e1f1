"""Annotation submissions processed as sets.

Input: flat submissions ``(submission_id, pos, batch_id, contributor_id,
pair_id, label, model_id, quantization, input_tokens, output_tokens,
raw_response_hash, submitted_at)``; ``flatten`` turns the nested form (header +
``annotations array<struct>``) into it with ``posexplode``.

Per submission, in this order:

1. a null label or one outside 0..3 rejects the whole submission (``invalid_label``);
2. batch gate: ``not_found`` -> ``forbidden`` (other owner) -> ``replay``
   (batch completed: the result is rebuilt from stored annotations) ->
   ``invalid_status`` (not assigned) -> ``ok``; overdue but unswept assigned
   batches are accepted;
3. rows: a repeated pair inside one submission is rejected after its first
   position (even if the first was rejected); a pair outside the batch is
   rejected; an existing (pair, contributor) annotation wins (insert-ignore);
4. a batch is completed by its first submission with at least one accepted
   row; later submissions of that batch in the same run are replays.

Run order is ``(submitted_at, submission_id)``. A (pair, contributor) key may
stand in several batches: the first in run order wins it, and a submission that
loses all its rows that way accepts nothing and completes nothing, so the next
submission of its batch gets its turn (``_losers``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelforge.operators.running import running_sums
from labelforge.session import cut_lineage

ROW_FIELDS = (
    "pair_id",
    "label",
    "input_tokens",
    "output_tokens",
    "raw_response_hash",
)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key by ``order``.

    ``row_number() = 1`` is planned as a partial ``WindowGroupLimit`` before the
    shuffle and a final one after it, so a key holding a third of all rows is
    cut to one row per map task before it moves (like a map-side combine).
    """
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).asc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def flatten(nested: DataFrame) -> DataFrame:
    """Header + ``annotations`` array -> one row per annotation with its position."""
    header = [c for c in nested.columns if c != "annotations"]
    exploded = nested.select(*header, F.posexplode("annotations").alias("pos", "a"))
    return exploded.select(*header, "pos", *[F.col(f"a.{c}").alias(c) for c in ROW_FIELDS])


@dataclass
class SubmissionRun:
    rows: DataFrame  # every submitted row with accepted / reason
    results: DataFrame  # one row per submission
    annotations: DataFrame  # new annotations table
    contributors: DataFrame  # new contributors table
    batches: DataFrame  # new batches table
    pairs: DataFrame  # new pairs table
    settlements: DataFrame  # pair decisions of this run


def _order_cols() -> list[Column]:
    return [F.col("submitted_at").asc(), F.col("submission_id").asc()]


def _hour() -> Column:
    """Bucket of the run order for skew-safe running sums (monotone in the order)."""
    return F.date_trunc("hour", F.col("submitted_at"))


def gate(subs: DataFrame, batches: DataFrame) -> DataFrame:
    """One row per submission with ``outcome`` (A1 + label domain check)."""
    header = subs.groupBy("submission_id").agg(
        F.max("batch_id").alias("batch_id"),
        F.max("contributor_id").alias("contributor_id"),
        F.max("submitted_at").alias("submitted_at"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~F.coalesce(F.col("label").between(0, 3), F.lit(False))).alias("bad_labels"),
    )
    b = batches.select(
        F.col("id").alias("batch_id"), F.col("contributor_id").alias("owner_id"), F.col("status").alias("batch_status")
    )
    return header.join(b, "batch_id", "left").select(
        "submission_id",
        "batch_id",
        "contributor_id",
        "submitted_at",
        "n_rows",
        F.when(F.col("bad_labels") > 0, "invalid_label")
        .when(F.col("owner_id").isNull(), "not_found")
        .when(F.col("owner_id") != F.col("contributor_id"), "forbidden")
        .when(F.col("batch_status") == "completed", "replay")
        .when(F.col("batch_status") != "assigned", "invalid_status")
        .otherwise("ok")
        .alias("gate"),
    )


def _losers(rows: DataFrame) -> DataFrame:
    """``submission_id`` of submissions whose every candidate row is won by earlier submissions.

    ``rows``: candidate rows (submission_id, batch_id, submitted_at, pair_id,
    contributor_id, pos). Only completing submissions win keys, and a batch's
    first one that wins any completes it. Each round lets the first submission
    of every batch that hasn't lost yet compete and marks those that win
    nothing. A loser held no key, so striking it out takes no key from anybody;
    the submission that takes its place only adds competition: a loser stays one,
    and rounds end after at most as many as a batch has submissions.

    Only submissions all of whose rows are contested can lose; the rest of a
    round's rows matter as rivals. Without contested keys there is no round.
    """
    key = ["pair_id", "contributor_id"]
    firsts = rows.groupBy(*key).agg(F.min("submission_id").alias("least"), F.max("submission_id").alias("most"))
    # the batches at risk and every batch that shares a key with them, rows of contested keys only
    contested = cut_lineage(rows.join(firsts.where("least <> most").select(*key), key, "left_semi"), "contested-rows")
    if contested.isEmpty():
        return contested.select("submission_id")
    sizes = rows.join(contested.select("submission_id").distinct(), "submission_id", "left_semi").groupBy("submission_id").agg(F.count("*").alias("n"))
    held = contested.groupBy("submission_id", "batch_id").agg(F.count("*").alias("contested"))
    risky = cut_lineage(held.join(sizes, "submission_id").where("contested = n").select("submission_id", "batch_id"), "submissions-at-risk")
    if risky.isEmpty():
        return risky.select("submission_id")
    order = [F.col("submitted_at"), F.col("submission_id")]
    turns = rows.select("submission_id", "batch_id", "submitted_at").distinct()
    turns = cut_lineage(turns.join(contested.select("batch_id").distinct(), "batch_id", "left_semi"), "contested-turns")
    lost = risky.limit(0).select("submission_id")
    while True:
        left = turns.join(lost, "submission_id", "left_anti")
        first = left.withColumn("turn", F.row_number().over(Window.partitionBy("batch_id").orderBy(*order))).where("turn = 1")
        run = contested.join(first.select("submission_id"), "submission_id", "left_semi")
        place = F.row_number().over(Window.partitionBy(*key).orderBy(*order, F.col("pos")))
        winners = run.withColumn("place", place).where("place = 1").select("submission_id").distinct()
        struck = first.join(risky, "submission_id", "left_semi").join(winners, "submission_id", "left_anti")
        struck = cut_lineage(struck.select("submission_id"), "losing-submissions")
        if struck.isEmpty():
            return lost
        lost = cut_lineage(lost.union(struck), "lost-submissions")


def process(
    subs: DataFrame,
    batches: DataFrame,
    batch_pairs: DataFrame,
    honeypots: DataFrame,
    annotations: DataFrame,
    contributors: DataFrame,
    pairs: DataFrame,
    materialize: bool = False,
) -> SubmissionRun:
    """Run every submission of ``subs`` against the stored tables.

    The run has five outputs that share the row decisions; with
    ``materialize`` the per-row and per-submission decisions are written once
    to the shared checkpoint folder and every output reads them (use it when
    several outputs are written; a single output is cheaper lazily). The gate
    is always written: the rows and the results read it, and it saves them a
    pass over all submissions.
    """
    g = cut_lineage(gate(subs, batches), "sub-gate")
    ok_subs = g.where(F.col("gate") == "ok").select("submission_id")
    rows = subs.join(ok_subs, "submission_id", "left_semi")

    # A2: first position per pair inside a submission
    w_dup = Window.partitionBy("submission_id", "pair_id").orderBy("pos")
    rows = rows.withColumn("dup", F.row_number().over(w_dup) > 1)
    # A3: the pair must belong to the batch
    bp = batch_pairs.select("batch_id", "pair_id").distinct().withColumn("in_batch", F.lit(True))
    rows = rows.join(bp, ["batch_id", "pair_id"], "left")
    # A5: stored annotation of the same contributor wins
    stored = annotations.select("pair_id", "contributor_id").distinct().withColumn("exists", F.lit(True))
    rows = rows.join(stored, ["pair_id", "contributor_id"], "left")
    rows = rows.withColumn(
        "reason",
        F.when(F.col("dup"), "duplicate")
        .when(F.col("in_batch").isNull(), "not_in_batch")
        .when(F.col("exists").isNotNull(), "conflict"),
    ).drop("dup", "in_batch", "exists")
    # the rounds below and every output read the rows: the window and the joins run once
    rows = cut_lineage(rows, "candidate-rows")

    # step 4: the first submission that wins a row completes the batch
    lost = _losers(
        rows.where(F.col("reason").isNull()).select(
            "submission_id", "batch_id", "submitted_at", "pair_id", "contributor_id", "pos"
        )
    )
    cand = rows.join(lost, "submission_id", "left_anti").groupBy("submission_id").agg(F.count_if(F.col("reason").isNull()).alias("n_cand"))
    per_sub = g.join(cand, "submission_id", "left").withColumn("n_cand", F.coalesce("n_cand", F.lit(0)))
    key = F.struct("submitted_at", "submission_id")
    per_sub = per_sub.withColumn(
        "completer",
        F.min(F.when((F.col("gate") == "ok") & (F.col("n_cand") > 0), key)).over(
            Window.partitionBy("batch_id")
        ),
    )
    per_sub = per_sub.withColumn(
        "outcome",
        F.when(
            (F.col("gate") == "ok") & F.col("completer").isNotNull() & (key > F.col("completer")), F.lit("replay")
        ).otherwise(F.col("gate")),
    ).withColumn("completes", (F.col("gate") == "ok") & F.col("completer").isNotNull() & (key == F.col("completer")))

    if materialize:
        per_sub = cut_lineage(per_sub, "sub-outcome")
    rows = rows.join(per_sub.select("submission_id", "outcome", "completes"), "submission_id")
    rows = rows.withColumn(
        "reason", F.when(F.col("outcome") == "replay", F.lit("replay")).otherwise(F.col("reason"))
    )
    # cross-batch repeats of a (pair, contributor) key: first in run order wins
    w_key = Window.partitionBy("pair_id", "contributor_id").orderBy(*_order_cols(), F.col("pos").asc())
    if materialize:
        rows = cut_lineage(rows, "sub-rows")
    cand_rows = rows.where(F.col("reason").isNull() & F.col("completes"))
    cand_rows = cand_rows.withColumn("krn", F.row_number().over(w_key))
    hp = honeypots.select("pair_id", "known_label")
    accepted = (
        cand_rows.where(F.col("krn") == 1)
        .drop("krn")
        .join(hp, "pair_id", "left")
        .withColumn("is_honeypot", F.col("known_label").isNotNull())
    )

    # running annotation count per pair -> pairs_verified per submission
    stored_n = annotations.groupBy("pair_id").agg(F.count(F.lit(1)).alias("stored_n"))
    req = pairs.select(F.col("id").alias("pair_id"), "required_annotations")
    # running count per pair in run order, for non-honeypot pairs only: those
    # stop being offered once they reach their requirement, so a group is
    # bounded; honeypots (claimed by everyone, hot) never settle and skip it
    w_pair = Window.partitionBy("pair_id").orderBy(*_order_cols()).rowsBetween(Window.unboundedPreceding, 0)
    regular = accepted.where(~F.col("is_honeypot"))
    acc = (
        regular.join(stored_n, "pair_id", "left")
        .join(req, "pair_id", "left")
        .withColumn("running_n", F.coalesce("stored_n", F.lit(0)) + F.count(F.lit(1)).over(w_pair))
        .withColumn(
            "settles",
            ~F.col("is_honeypot")
            & F.col("required_annotations").isNotNull()
            & (F.col("running_n") >= F.col("required_annotations")),
        )
    )
    verified = acc.groupBy("submission_id").agg(F.count_if("settles").alias("pairs_verified"))
    sub_acc = accepted.groupBy("submission_id").agg(
        F.count(F.lit(1)).alias("accepted"),
        F.sum("input_tokens").alias("in_tok"),
        F.sum("output_tokens").alias("out_tok"),
        F.avg(F.when(F.col("is_honeypot"), (F.col("known_label").cast("int") == F.col("label").cast("int")).cast("double"))).alias(
            "hp_acc"
        ),
    ).join(verified, "submission_id", "left")

    new_ann = annotations.unionByName(
        accepted.select(
            "pair_id",
            "contributor_id",
            "batch_id",
            F.col("label").cast("short").alias("label"),
            "model_id",
            "quantization",
            "input_tokens",
            "output_tokens",
            "raw_response_hash",
            "is_honeypot",
            F.col("submitted_at").alias("created_at"),
        ),
        allowMissingColumns=True,
    )

    # replay results are rebuilt from the annotations of (batch, contributor)
    rebuilt = (
        new_ann.join(hp, "pair_id", "left")
        .groupBy("batch_id", "contributor_id")
        .agg(
            F.count(F.lit(1)).alias("r_accepted"),
            F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("r_in"),
            F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("r_out"),
            F.avg(
                F.when(F.col("known_label").isNotNull(), (F.col("known_label").cast("int") == F.col("label").cast("int")).cast("double"))
            ).alias("r_hp_acc"),
        )
    )

    # contributor running totals (stored totals + accepted so far in run order)
    c_tot = contributors.select(
        F.col("id").alias("contributor_id"),
        F.col("total_input_tokens").alias("base_in"),
        F.col("total_output_tokens").alias("base_out"),
    )
    # running token totals per contributor in run order (skew-safe: one
    # contributor may send a third of all submissions)
    res = (
        per_sub.join(sub_acc, "submission_id", "left")
        .join(rebuilt, ["batch_id", "contributor_id"], "left")
        .join(c_tot, "contributor_id", "left")
        .withColumn("in_tok", F.coalesce("in_tok", F.lit(0)))
        .withColumn("out_tok", F.coalesce("out_tok", F.lit(0)))
    )
    ok_sub = F.col("outcome") == "ok"
    res = running_sums(
        res,
        ["contributor_id"],
        _order_cols(),
        {
            "cum_in": F.when(ok_sub, F.col("in_tok")).otherwise(F.lit(0)),
            "cum_out": F.when(ok_sub, F.col("out_tok")).otherwise(F.lit(0)),
        },
        _hour(),
    )
    handled = F.col("outcome").isin("ok", "replay")
    results = res.select(
        "submission_id",
        "batch_id",
        "contributor_id",
        "outcome",
        F.when(F.col("outcome") == "ok", F.coalesce("accepted", F.lit(0)))
        .when(F.col("outcome") == "replay", F.coalesce("r_accepted", F.lit(0)))
        .cast("long")
        .alias("accepted"),
        F.when(F.col("outcome") == "ok", F.col("n_rows") - F.coalesce("accepted", F.lit(0)))
        .when(F.col("outcome") == "replay", F.lit(0))
        .cast("long")
        .alias("rejected"),
        F.when(F.col("outcome") == "ok", F.col("hp_acc")).when(F.col("outcome") == "replay", F.col("r_hp_acc")).alias(
            "honeypot_accuracy"
        ),
        F.when(F.col("outcome") == "ok", F.coalesce("pairs_verified", F.lit(0)))
        .when(F.col("outcome") == "replay", F.lit(0))
        .cast("long")
        .alias("pairs_verified"),
        F.when(handled, F.coalesce("base_in", F.lit(0)) + F.col("cum_in")).cast("long").alias("input_tokens"),
        F.when(handled, F.coalesce("base_out", F.lit(0)) + F.col("cum_out")).cast("long").alias("output_tokens"),
    )

    # new contributors / batches / pairs
    deltas = accepted.groupBy(F.col("contributor_id").alias("id")).agg(
        F.count(F.lit(1)).alias("d_n"), F.sum("input_tokens").alias("d_in"), F.sum("output_tokens").alias("d_out")
    )
    new_contrib = (
        contributors.join(deltas, "id", "left")
        .withColumn("total_annotations", (F.col("total_annotations") + F.coalesce("d_n", F.lit(0))).cast("int"))
        .withColumn("total_input_tokens", (F.col("total_input_tokens") + F.coalesce("d_in", F.lit(0))).cast("long"))
        .withColumn("total_output_tokens", (F.col("total_output_tokens") + F.coalesce("d_out", F.lit(0))).cast("long"))
        .drop("d_n", "d_in", "d_out")
    )
    done = per_sub.where("completes").select(F.col("batch_id").alias("id"), F.col("submitted_at").alias("done_at"))
    new_batches = (
        batches.join(done, "id", "left")
        .withColumn("status", F.when(F.col("done_at").isNotNull(), F.lit("completed")).otherwise(F.col("status")))
        .withColumn(
            "completed_at",
            F.coalesce(F.col("done_at"), F.col("completed_at")) if "completed_at" in batches.columns else F.col("done_at"),
        )
        .drop("done_at")
    )
    from labelforge.operators.votes import apply_status, settle

    touched = accepted.where(~F.col("is_honeypot")).select("pair_id").distinct()
    decisions = settle(pairs, new_ann, honeypots, touched)
    new_pairs = apply_status(pairs, decisions)

    all_rows = rows.join(
        accepted.select("submission_id", "pos", F.lit(True).alias("accepted")), ["submission_id", "pos"], "left"
    ).withColumn("accepted", F.coalesce("accepted", F.lit(False)))
    all_rows = all_rows.withColumn(
        "reason", F.when(~F.col("accepted") & F.col("reason").isNull(), F.lit("conflict")).otherwise(F.col("reason"))
    )
    return SubmissionRun(all_rows, results, new_ann, new_contrib, new_batches, new_pairs, decisions)


def replay_results(annotations: DataFrame, honeypots: DataFrame, contributors: DataFrame) -> DataFrame:
    """Result rebuild for every (batch, contributor) from stored annotations (A12)."""
    hp = honeypots.select("pair_id", "known_label")
    agg = (
        annotations.join(hp, "pair_id", "left")
        .groupBy("batch_id", "contributor_id")
        .agg(
            F.count(F.lit(1)).alias("accepted"),
            F.coalesce(F.sum("input_tokens"), F.lit(0)).cast("long").alias("batch_input_tokens"),
            F.coalesce(F.sum("output_tokens"), F.lit(0)).cast("long").alias("batch_output_tokens"),
            F.avg(
                F.when(F.col("known_label").isNotNull(), (F.col("known_label").cast("int") == F.col("label").cast("int")).cast("double"))
            ).alias("honeypot_accuracy"),
        )
    )
    c = contributors.select(
        F.col("id").alias("contributor_id"),
        F.col("total_input_tokens").alias("input_tokens"),
        F.col("total_output_tokens").alias("output_tokens"),
    )
    return agg.join(c, "contributor_id", "left").select(
        "batch_id",
        "contributor_id",
        "accepted",
        F.lit(0).cast("long").alias("rejected"),
        "honeypot_accuracy",
        F.lit(0).cast("long").alias("pairs_verified"),
        F.coalesce("input_tokens", F.lit(0)).cast("long").alias("input_tokens"),
        F.coalesce("output_tokens", F.lit(0)).cast("long").alias("output_tokens"),
    )
