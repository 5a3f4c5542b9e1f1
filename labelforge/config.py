"""Plain configuration objects (options become function parameters)."""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Fixed values that must equal the original tool for identical results.
# Mining defaults: source dataset "nomic-ai/nomic-embed-unsupervised-data"
# split "squad" (they form the source label, hence the pair ids),
# bm25_top_k 1000, dense_top_k 1000, rrf_k 60,
# candidates_per_query 10, min_search_docs 100000, retrieval method label "bm25+dense",
# source label "<dataset_name>/<split>".
# BM25 Okapi constants: k1 1.5, b 0.75, epsilon 0.25.
# Annotation service defaults: batch_default_size 100, batch_max_size 500,
# batch_expiry_hours 24, default_required_annotations 2, honeypot_ratio 0.05,
# leaderboard default limit 20 clamped to 1..50, activity window 24 hours.
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class MiningConfig:
    dataset_name: str = "nomic-ai/nomic-embed-unsupervised-data"
    split: str = "squad"
    max_docs: int | None = None
    bm25_top_k: int = 1000
    dense_top_k: int = 1000
    rrf_k: int = 60
    candidates_per_query: int = 10
    #: "exact" or "ivf". The mode is chosen here alone; no corpus size changes it.
    search: str = "exact"
    #: documents an IVF search looks at, about (sets how many cells are probed)
    min_search_docs: int = 100_000
    retrieval_method: str = "bm25+dense"
    # BM25 Okapi
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25
    # engine knobs (no effect on results)
    pad_bm25: bool = True
    query_block: int = 1024
    doc_block: int = 65_536

    @property
    def source_dataset_label(self) -> str:
        return f"{self.dataset_name}/{self.split}"


@dataclass(frozen=True)
class ServiceConfig:
    batch_default_size: int = 100
    batch_max_size: int = 500
    batch_expiry_hours: int = 24
    default_required_annotations: int = 2
    honeypot_ratio: float = 0.05
    leaderboard_default_limit: int = 20
    leaderboard_max_limit: int = 50
    activity_window_hours: int = 24
