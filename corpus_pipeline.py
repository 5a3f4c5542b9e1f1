"""Training-data pipeline over ``documents``: five stages, each by one operator of ``labelforge.llm``.

Every stage takes what its predecessor kept; its result is written as Parquet
and read again as the next one's documents. All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.llm import line_dedup, packing, quality, simhash, toxicity
from labelforge.llm.common import crc_fold, store, table, whole_text
from labelforge.session import cut_lineage

#: No SQL: three stages are fitted models and searches. tests/llm hold each against a brute-force version.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score 0.5 or more)."""
    labels = quality.quality_labels(table(spark, sf_dir, "labels")).where(crc_fold(3) != 1)
    stats = cut_lineage(docs.select("doc_id", quality.statistics_column(whole_text()).alias("stats")), "statistics")
    model = quality.fit(stats, labels)
    return docs.where(quality.score_column(model, quality.statistics_column(whole_text())) >= 0.5)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject (score below 0.5)."""
    labels = toxicity.toxicity_labels(table(spark, sf_dir, "labels")).where(crc_fold(5) != 0)
    model = toxicity.fit(docs, labels)
    return docs.where(toxicity.score_column(spark, model, whole_text()) < 0.5)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document has, or nearly has."""
    return line_dedup.dedup_lines(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the smallest doc_id."""
    return simhash.keep_one_per_component(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in bins of several lengths."""
    return packing.best_fit_packing(docs)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; an empty table goes through all of them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
