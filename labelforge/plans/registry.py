"""Registered queries over the driver tables: name -> fn(spark, sf_dir) -> DataFrame.

Every query reads whole tables (see ``labelforge.sources.driver`` for the
mapping rules) and calls the library operators. ``labelforge.plans.oracle``
holds the equivalent DuckDB SQL for each name that has one.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge import schemas
from labelforge.config import MiningConfig
from labelforge.functions.families import KNOWN_FAMILIES, family_match, model_family
from labelforge.functions.ids import content_id, uuid5_url
from labelforge.functions.text import tokenize
from labelforge.functions.vectors import l2_normalize
from labelforge.operators import bm25, candidates, cell_tree, dense, fusion, ivf, lifecycle, planning, reports, submissions, votes
from labelforge.operators.encoders import HashedBagOfWords
from labelforge.sources import driver, sink
from labelforge.session import cut_lineage
from labelforge.sources.corpus import build_corpus, cap_rows

CONV_CFG = MiningConfig(dataset_name="driver", split="conversations")
DOCS_CFG = MiningConfig(dataset_name="driver", split="documents")
ENCODER = HashedBagOfWords(256)
CLAIM_SIZE = 100
ROW_CAP = 150
CLAIM_REQUEST = "first"
CLAIM_MODEL = "Qwen/Qwen2.5-7B-Instruct-AWQ"


# ----------------------------------------------------------------------------- corpus


def q_content_id(spark: SparkSession, sf: str) -> DataFrame:
    d = driver.table(spark, sf, "documents")
    return d.select("doc_id", content_id("text").alias("content_id"))


def q_dedup_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return build_corpus(driver.document_rows(spark, sf)).docs.select("doc_id", "first_ord", "doc_text")


def q_row_cap(spark: SparkSession, sf: str) -> DataFrame:
    """The cap is the feature: the corpus of the first ROW_CAP rows."""
    rows = cap_rows(driver.document_rows(spark, sf), ROW_CAP)
    return build_corpus(rows).docs.select("doc_id", "first_ord")


def q_corpus_queries(spark: SparkSession, sf: str) -> DataFrame:
    return build_corpus(driver.conversation_rows(spark, sf)).queries


def q_pair_id_uuid5(spark: SparkSession, sf: str) -> DataFrame:
    q = build_corpus(driver.conversation_rows(spark, sf)).queries
    label = CONV_CFG.source_dataset_label
    return q.select(
        "query_ord",
        F.col("positive_doc_id").alias("doc_id"),
        uuid5_url(F.col("query_text"), F.col("positive_doc_id"), F.lit(label)).alias("pair_id"),
        F.lit(label).alias("source_dataset"),
    )


def q_tokenize(spark: SparkSession, sf: str) -> DataFrame:
    d = driver.table(spark, sf, "documents").select("doc_id", tokenize("text").alias("t"))
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


# -------------------------------------------------------------------------- retrieval


def _docs_corpus(spark, sf):
    return build_corpus(driver.document_rows(spark, sf), materialize=True)


def q_bm25_terms(spark: SparkSession, sf: str) -> DataFrame:
    idx = bm25.build_index(_docs_corpus(spark, sf).docs)
    return idx.terms.select("term", "df", F.round("idf", 9).alias("idf"))


def _bm25_bench(spark, sf, top_k=DOCS_CFG.bm25_top_k, corpus=None):
    corpus = corpus or _docs_corpus(spark, sf)
    idx = bm25.build_index(corpus.docs)
    return bm25.retrieve(idx, driver.benchmark_queries(spark, sf), top_k)


def q_bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _bm25_bench(spark, sf).select("query_ord", "doc_id", "rank", "score")


def q_encode(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs_corpus(spark, sf).docs
    v = ENCODER.encode(docs, "doc_id", "doc_text")
    return v.select(
        "doc_id",
        F.size(F.filter("embedding", lambda x: x > 0)).alias("nnz"),
        F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 9).alias("norm2"),
        F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 9).alias("vsum"),
    )


def q_l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    e = driver.table(spark, sf, "embeddings")
    n = e.select("vec_id", l2_normalize(F.col("embedding")).alias("v"))
    return n.select(
        "vec_id",
        F.size("v").alias("dim"),
        F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), 9).alias("norm"),
        F.round(F.element_at("v", 1), 9).alias("v1"),
    )


def _dense_self(spark, sf, top_k=DOCS_CFG.dense_top_k):
    vecs = driver.embedding_vectors(spark, sf)
    q = vecs.select(F.col("first_ord").alias("query_ord"), "embedding")
    return dense.exact_topk(q, vecs, top_k)


def q_dense_topk_exact(spark: SparkSession, sf: str) -> DataFrame:
    return _dense_self(spark, sf).select("query_ord", "doc_id", "rank", "score")


def _dense_bench(spark, sf, corpus=None):
    corpus = corpus or _docs_corpus(spark, sf)
    docs = ENCODER.encode(corpus.docs, "doc_id", "doc_text").select("doc_id", "first_ord", "embedding")
    qs = driver.benchmark_queries(spark, sf)
    qv = ENCODER.encode(qs, "query_ord", "query_text").select("query_ord", "embedding")
    return dense.exact_topk(qv, docs, DOCS_CFG.dense_top_k, dim=ENCODER.dim)


def q_rrf_fuse(spark: SparkSession, sf: str) -> DataFrame:
    corpus = _docs_corpus(spark, sf)
    fused = fusion.rrf(_bm25_bench(spark, sf, corpus=corpus), _dense_bench(spark, sf, corpus=corpus), DOCS_CFG.rrf_k)
    return fused.select("query_ord", "doc_id", "bm25_rank", "dense_rank", "fused_rank", "rrf_score")


def _conv_run(spark, sf):
    return candidates.mine_pairs(driver.conversation_rows(spark, sf), CONV_CFG, ENCODER)


def q_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return _conv_run(spark, sf).pairs.select("query_ord", "doc_id", "source_rank")


def q_mine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    p = _conv_run(spark, sf).pairs
    return p.select(*candidates.PAIR_COLUMNS, "query_ord", "rrf_score", "bm25_rank", "dense_rank")


def q_mining_metrics(spark: SparkSession, sf: str) -> DataFrame:
    run = _conv_run(spark, sf)
    return candidates.mining_metrics(run.corpus, run.pairs, CONV_CFG.candidates_per_query, run.plan)


def q_insert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    run = _conv_run(spark, sf)
    res = sink.pairs_insert(run.pairs, None)
    return res.rows.select(
        "id", "query_text", "doc_id", "doc_text", "source_dataset", "retrieval_method", "source_rank", "status"
    )


def q_ivf_cells(spark: SparkSession, sf: str) -> DataFrame:
    vecs = driver.embedding_vectors(spark, sf)
    index = ivf.build(vecs, ivf.ProbePlan.sized(vecs.count(), "ivf").cells)
    return index.vectors.groupBy("cell").agg(F.count(F.lit(1)).alias("n_docs"))


def q_ivf_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Every cell probed: the routed search must equal the exact one."""
    vecs = driver.embedding_vectors(spark, sf)
    plan = ivf.ProbePlan.sized(vecs.count(), "ivf")
    index = ivf.build(vecs, plan.cells)
    q = vecs.select(F.col("first_ord").alias("query_ord"), "embedding")
    return ivf.search(index, q, 10, plan.cells).select("query_ord", "doc_id", "rank", "score")


def q_ivf_cells_checked(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of a cell tree: vectors in all, and how many are in no cell, in several, or not at their branch's nearest leaf."""
    vecs = driver.embedding_vectors(spark, sf)
    tree = cell_tree.build(vecs)
    rows = tree.vectors.join(tree.leaves.select("cell", "branch", "centre"), "cell", "left")
    near = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0).cast("double"), lambda s, x: s + x)
    own = rows.select("first_ord", "embedding", "branch", F.col("cell").alias("own"), near("embedding", "centre").alias("own_near"))
    other = tree.leaves.select("branch", "cell", "centre")
    better = own.join(other, "branch").where((F.col("cell") != F.col("own")) & (near("embedding", "centre") > F.col("own_near") + 1e-9))
    counts = rows.groupBy("first_ord").agg(F.count("*").alias("cells"), F.count_if(F.col("branch").isNull()).alias("unknown"))
    return counts.agg(
        F.count("*").alias("vectors"),
        F.count_if(F.col("cells") > 1).alias("in_several"),
        F.sum("unknown").alias("in_no_cell"),
        F.lit(better.select("first_ord").distinct().count()).cast("long").alias("not_nearest"),
    )


def q_ivf_tree_recall(spark: SparkSession, sf: str) -> DataFrame:
    """The tree searched below full probe, against the exact search: recall of the ten nearest of every vector."""
    vecs = driver.embedding_vectors(spark, sf)
    tree = cell_tree.build(vecs)
    q = vecs.select(F.col("first_ord").alias("query_ord"), "embedding")
    cells = tree.leaves.count()
    probes = max(1, cells * 3 // 4)
    found = cell_tree.search(tree, q, 10, probes, len(tree.branches)).select("query_ord", "doc_id")
    exact = dense.exact_topk(q, vecs, 10).select("query_ord", "doc_id")
    both = exact.join(found.withColumn("hit", F.lit(1)), ["query_ord", "doc_id"], "left")
    return both.agg(
        F.count_distinct("query_ord").alias("queries"),
        F.lit(probes < cells).alias("below_full_probe"),
        (F.count("hit") / F.count("*") >= 0.9).alias("recall_reached"),
    )


def q_mine_pairs_ivf(spark: SparkSession, sf: str) -> DataFrame:
    """Mining in IVF mode with a budget that probes every cell: the same pairs as the exact mode."""
    cfg = dataclasses.replace(CONV_CFG, search="ivf", min_search_docs=2**62)
    p = candidates.mine_pairs(driver.conversation_rows(spark, sf), cfg, ENCODER).pairs
    return p.select(*candidates.PAIR_COLUMNS, "query_ord", "rrf_score", "bm25_rank", "dense_rank")


def q_bm25_top50(spark: SparkSession, sf: str) -> DataFrame:
    return _bm25_bench(spark, sf, 50).select("query_ord", "doc_id", "rank", "score")


def q_dense_top10(spark: SparkSession, sf: str) -> DataFrame:
    return _dense_self(spark, sf, 10).select("query_ord", "doc_id", "rank", "score")


def q_insert_ignore_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Insert into a table that holds the pairs of every even source rank already; the load holds every pair twice."""
    pairs = cut_lineage(_conv_run(spark, sf).pairs, "mined")
    stored = pairs.where(F.col("source_rank") % 2 == 0).select(F.col("pair_id").alias("id")).distinct()
    again = pairs.withColumn("query_ord", F.col("query_ord") + 10**12)
    res = sink.pairs_insert(pairs.unionByName(again), stored)
    return res.rows.select("id", "source_rank", "status", res.attempted.alias("attempted"), res.inserted.alias("inserted"))


# --------------------------------------------------------------------------- planning


def _tables(spark, sf):
    """The annotation tables derived from the driver data."""
    return dict(
        pairs=driver.pairs(spark, sf),
        annotations=driver.annotations(spark, sf),
        batch_pairs=driver.batch_pairs(spark, sf),
        batches=driver.batches(spark, sf),
        honeypots=driver.honeypots(spark, sf),
    )


def q_claimable_pairs(spark: SparkSession, sf: str) -> DataFrame:
    t = _tables(spark, sf)
    return planning.claimable_pairs(t["pairs"], t["annotations"], t["batch_pairs"], t["batches"], t["honeypots"])


def q_honeypot_pool(spark: SparkSession, sf: str) -> DataFrame:
    t = _tables(spark, sf)
    return planning.honeypot_pool(t["pairs"], t["batch_pairs"], t["batches"], t["honeypots"])


def q_family_excluded(spark: SparkSession, sf: str) -> DataFrame:
    return planning.family_annotated(driver.annotations(spark, sf))


def _claimant(ann: DataFrame):
    """The contributor with the most stored annotations (ties: smallest id)."""
    top = ann.groupBy("contributor_id").agg(F.count(F.lit(1)).alias("n"))
    return top.orderBy(F.col("n").desc(), F.col("contributor_id").asc()).limit(1).select("contributor_id").scalar()


def _plan(spark, sf):
    t = _tables(spark, sf)
    cid = _claimant(t["annotations"])
    return planning.plan_batch(
        t["pairs"], t["annotations"], t["batch_pairs"], t["batches"], t["honeypots"], cid, CLAIM_SIZE, CLAIM_MODEL, request_id=CLAIM_REQUEST
    ), cid


def q_plan_batch(spark: SparkSession, sf: str) -> DataFrame:
    return _plan(spark, sf)[0]


def q_batch_rows(spark: SparkSession, sf: str) -> DataFrame:
    chosen, cid = _plan(spark, sf)
    b, _ = planning.batch_rows(chosen, cid, driver.as_of(spark, sf))
    return b.select("id", "contributor_id", "size", "status", "assigned_at", "expires_at")


def q_release_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Per batch: a stranger's request, two of the owner's, one for a batch that doesn't exist."""
    b = driver.batches(spark, sf)
    own, none = F.col("contributor_id"), F.col("id") + 500
    asks = [(F.col("id"), own + 1, 1), (F.col("id"), own, 2), (F.col("id"), own, 3), (none, own, 4)]
    reqs = b.select(
        F.explode(
            F.array(
                *[
                    F.struct(i.alias("batch_id"), c.alias("contributor_id"), F.lit(n).alias("requested_at"))
                    for i, c, n in asks
                ]
            )
        ).alias("r")
    ).select("r.*")
    outcomes, _ = lifecycle.release(b, reqs)
    return outcomes.select("batch_id", "contributor_id", "requested_at", "outcome")


def q_expire_batches(spark: SparkSession, sf: str) -> DataFrame:
    b = lifecycle.expire(driver.batches(spark, sf), driver.as_of(spark, sf))
    return b.select("id", "status", "expired_now")


def q_model_family(spark: SparkSession, sf: str) -> DataFrame:
    s = driver.submissions(spark, sf)
    return s.groupBy("model_id").agg(F.count(F.lit(1)).alias("n")).select("model_id", model_family("model_id").alias("family"), "n")


def q_family_match(spark: SparkSession, sf: str) -> DataFrame:
    models = driver.submissions(spark, sf).select("model_id").distinct()
    fam = models.select("model_id", F.explode(F.array(*[F.lit(f) for f in KNOWN_FAMILIES])).alias("family"))
    return fam.select("model_id", "family", family_match(F.col("model_id"), F.col("family")).alias("matches"))


# ---------------------------------------------------------------------------- quality


def q_honeypot_check(spark: SparkSession, sf: str) -> DataFrame:
    ann = driver.annotations(spark, sf).select("pair_id", "contributor_id", "label")
    r = votes.honeypot_check(ann, driver.honeypots(spark, sf))
    return r.select("pair_id", "contributor_id", "label", "known_label", "passed")


def q_settle_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return votes.settle(driver.pairs(spark, sf), driver.annotations(spark, sf), driver.honeypots(spark, sf))


def _run(spark, sf, subs=None):
    t = _tables(spark, sf)
    # the run reads the stored annotations several times: their window runs once
    t["annotations"] = cut_lineage(t["annotations"], "annotations")
    contrib = reports.contributor_totals(driver.contributors_base(spark, sf), t["annotations"])
    subs = driver.run_submissions(spark, sf) if subs is None else subs
    return submissions.process(
        subs, t["batches"], t["batch_pairs"], t["honeypots"], t["annotations"], contrib, t["pairs"], materialize=False
    )


def q_submission_gate(spark: SparkSession, sf: str) -> DataFrame:
    t = _tables(spark, sf)
    return submissions.gate(driver.run_submissions(spark, sf), t["batches"]).select(
        "submission_id", "batch_id", "contributor_id", "n_rows", "gate"
    )


def q_accept_annotations(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf).rows.select("submission_id", "pos", "pair_id", "contributor_id", "accepted", "reason")


def q_accept_mixed(spark: SparkSession, sf: str) -> DataFrame:
    rows = _run(spark, sf, driver.mixed_submissions(spark, sf)).rows
    return rows.select("submission_id", "pos", "pair_id", "contributor_id", "accepted", "reason")


def q_results_mixed(spark: SparkSession, sf: str) -> DataFrame:
    r = _run(spark, sf, driver.mixed_submissions(spark, sf)).results
    return r.select("submission_id", "batch_id", "contributor_id", "outcome", "accepted", "rejected", "input_tokens", "output_tokens")


def q_submission_results(spark: SparkSession, sf: str) -> DataFrame:
    r = _run(spark, sf).results
    return r.select(
        "submission_id",
        "batch_id",
        "contributor_id",
        "outcome",
        "accepted",
        "rejected",
        "honeypot_accuracy",
        "pairs_verified",
        "input_tokens",
        "output_tokens",
    )


def q_contributor_totals(spark: SparkSession, sf: str) -> DataFrame:
    c = _run(spark, sf).contributors
    return c.select("id", "total_annotations", "total_input_tokens", "total_output_tokens")


def q_batches_after_run(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf).batches.select("id", "contributor_id", "status", "completed_at")


def q_pairs_after_run(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf).pairs.select("id", "status", "required_annotations")


def q_annotations_after_run(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf).annotations.select(
        "pair_id", "contributor_id", "batch_id", "label", "model_id", "quantization", "input_tokens", "output_tokens",
        "raw_response_hash", "is_honeypot", "created_at",
    )


def q_batch_links(spark: SparkSession, sf: str) -> DataFrame:
    chosen, cid = _plan(spark, sf)
    return planning.batch_rows(chosen, cid, driver.as_of(spark, sf))[1]


def q_replay_results(spark: SparkSession, sf: str) -> DataFrame:
    ann = driver.annotations(spark, sf)
    contrib = reports.contributor_totals(driver.contributors_base(spark, sf), ann)
    r = submissions.replay_results(ann, driver.honeypots(spark, sf), contrib)
    return r.select(
        "batch_id", "contributor_id", "accepted", "rejected", "honeypot_accuracy", "pairs_verified", "input_tokens", "output_tokens"
    )


# ---------------------------------------------------------------------------- reports


def _contributors(spark, sf):
    return reports.contributor_totals(driver.contributors_base(spark, sf), driver.annotations(spark, sf))


def q_stats(spark: SparkSession, sf: str) -> DataFrame:
    return reports.stats(driver.pairs(spark, sf), _contributors(spark, sf), driver.annotations(spark, sf), driver.as_of(spark, sf))


def q_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    return reports.leaderboard(_contributors(spark, sf), 20)


def q_profile_lookup(spark: SparkSession, sf: str) -> DataFrame:
    owners = driver.batches(spark, sf).where(F.col("status") == "assigned").select(F.col("contributor_id").alias("id"))
    return reports.profile(_contributors(spark, sf), owners)


def q_profile_upsert(spark: SparkSession, sf: str) -> DataFrame:
    c = _contributors(spark, sf).withColumn("id", F.col("id").cast("string"))
    ev = driver.table(spark, sf, "events").where(F.col("event_type") == "signup")
    logins = ev.select(
        F.col("user_id").alias("github_id"),
        F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("#"), F.col("event_id").cast("string")).alias(
            "github_username"
        ),
        F.col("props").alias("github_avatar_url"),
        F.col("ts").alias("login_at"),
    )
    up = sink.upsert_profiles(c, logins)
    return up.select("id", "github_id", "github_username", "github_avatar_url", "total_annotations", "created_at", "last_seen_at")


def q_validate_domain(spark: SparkSession, sf: str) -> DataFrame:
    checks = []
    for name, df in (
        ("pairs", driver.pairs(spark, sf).withColumn("id", F.col("id").cast("string"))),
        ("batches", driver.batches(spark, sf)),
        ("annotations", driver.annotations(spark, sf).withColumn("id", uuid5_url(F.col("pair_id").cast("string"), F.col("contributor_id").cast("string")))),
    ):
        full = schemas.with_defaults(df, name)
        valid, _ = schemas.validate(full, schemas.rules(name))
        checks.append(
            full.agg(F.count(F.lit(1)).alias("n_rows")).select(
                F.lit(name).alias("table_name"), "n_rows", valid.select(F.count(F.lit(1))).scalar().alias("n_valid")
            )
        )
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def q_domain_violations(spark: SparkSession, sf: str) -> DataFrame:
    """The stored annotations with labels moved up and some models taken away: the rows that break a rule, and which."""
    ann = driver.annotations(spark, sf).withColumn("id", uuid5_url(F.col("pair_id").cast("string"), F.col("contributor_id").cast("string")))
    faulty = ann.withColumn("label", F.col("label") + 2).withColumn("model_id", F.when(F.col("pair_id") % 7 != 0, F.col("model_id")))
    _, bad = schemas.validate(schemas.with_defaults(faulty, "annotations"), schemas.rules("annotations"))
    return bad.select(
        F.col("pair_id").cast("string").alias("pair_id"),
        F.col("contributor_id").cast("string").alias("contributor_id"),
        F.array_join("failed", ",").alias("failed"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "content_id": q_content_id,
    "dedup_corpus": q_dedup_corpus,
    "row_cap": q_row_cap,
    "corpus_queries": q_corpus_queries,
    "pair_id_uuid5": q_pair_id_uuid5,
    "tokenize": q_tokenize,
    "bm25_terms": q_bm25_terms,
    "bm25_topk": q_bm25_topk,
    "encode": q_encode,
    "l2_normalize": q_l2_normalize,
    "dense_topk_exact": q_dense_topk_exact,
    "rrf_fuse": q_rrf_fuse,
    "hard_negatives": q_hard_negatives,
    "mine_pairs": q_mine_pairs,
    "mining_metrics": q_mining_metrics,
    "insert_ignore": q_insert_ignore,
    "ivf_cells": q_ivf_cells,
    "ivf_topk": q_ivf_topk,
    "ivf_cells_checked": q_ivf_cells_checked,
    "ivf_tree_recall": q_ivf_tree_recall,
    "mine_pairs_ivf": q_mine_pairs_ivf,
    "bm25_top50": q_bm25_top50,
    "dense_top10": q_dense_top10,
    "insert_ignore_stored": q_insert_ignore_stored,
    "claimable_pairs": q_claimable_pairs,
    "honeypot_pool": q_honeypot_pool,
    "family_excluded": q_family_excluded,
    "plan_batch": q_plan_batch,
    "batch_rows": q_batch_rows,
    "release_batches": q_release_batches,
    "expire_batches": q_expire_batches,
    "model_family": q_model_family,
    "family_match": q_family_match,
    "honeypot_check": q_honeypot_check,
    "settle_pairs": q_settle_pairs,
    "submission_gate": q_submission_gate,
    "accept_annotations": q_accept_annotations,
    "submission_results": q_submission_results,
    "accept_mixed": q_accept_mixed,
    "results_mixed": q_results_mixed,
    "contributor_totals": q_contributor_totals,
    "batches_after_run": q_batches_after_run,
    "pairs_after_run": q_pairs_after_run,
    "annotations_after_run": q_annotations_after_run,
    "batch_links": q_batch_links,
    "replay_results": q_replay_results,
    "stats": q_stats,
    "leaderboard": q_leaderboard,
    "profile_lookup": q_profile_lookup,
    "profile_upsert": q_profile_upsert,
    "validate_domain": q_validate_domain,
    "domain_violations": q_domain_violations,
}
