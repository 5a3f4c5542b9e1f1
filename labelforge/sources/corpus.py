"""Source rows -> deduplicated corpus + query list.

A source row is a known-positive (query, document) pair. Rows must carry a
stable ordinal column (a natural key or a file row id, never an id recomputed on
retry) because "first occurrence" decides which copy of a document wins and the
order of queries.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelforge.functions.ids import content_id
from labelforge.session import cut_lineage

ROW_SCHEMA = T.StructType(
    [
        T.StructField("ord", T.LongType(), False),
        T.StructField("query", T.StringType(), True),
        T.StructField("document", T.StringType(), False),
        T.StructField("dataset", T.StringType(), True),
        T.StructField("shard", T.IntegerType(), True),
    ]
)


@dataclass
class Corpus:
    """``docs(doc_id, doc_text, first_ord)`` and ``queries(query_ord, query_text, positive_doc_id)``."""

    docs: DataFrame
    queries: DataFrame


def read_rows(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read source rows (ord, query, document[, dataset, shard]) with a fixed schema."""
    reader = spark.read.format(fmt)
    if fmt in ("json", "csv"):
        reader = reader.schema(ROW_SCHEMA)
    return reader.load(path)


def cap_rows(rows: DataFrame, max_docs: int | None, ord_col: str = "ord") -> DataFrame:
    """Keep the first ``max_docs`` rows (rows, not unique documents).

    ``None`` keeps everything; a value <= 0 still keeps one row, as the cap is
    checked after a row has been taken. Distributed top-n (no global sort).
    """
    if max_docs is None:
        return rows
    return rows.orderBy(F.col(ord_col)).limit(max(1, int(max_docs)))


def build_corpus(
    rows: DataFrame,
    ord_col: str = "ord",
    query_col: str = "query",
    document_col: str = "document",
    materialize: bool = False,
) -> Corpus:
    """Exact document dedup (first occurrence wins) and the aligned query list.

    Queries are not deduplicated. Rows with a null query only add their document
    to the corpus. The aggregation combines map-side, so a document repeated in a
    third of all rows costs one partial row per task. ``materialize`` writes both
    frames once to the shared checkpoint folder (the corpus feeds the BM25
    index, the encoder, padding and the final text join).
    """
    keyed = rows.select(
        F.col(ord_col).cast("long").alias("ord"),
        F.col(query_col).alias("query"),
        F.col(document_col).alias("document"),
        content_id(F.col(document_col)).alias("doc_id"),
    )
    docs = keyed.groupBy("doc_id").agg(
        F.min_by("document", "ord").alias("doc_text"),
        F.min("ord").alias("first_ord"),
    )
    queries = keyed.where(F.col("query").isNotNull()).select(
        F.col("ord").alias("query_ord"),
        F.col("query").alias("query_text"),
        F.col("doc_id").alias("positive_doc_id"),
    )
    if materialize:
        docs, queries = cut_lineage(docs), cut_lineage(queries)
    return Corpus(docs=docs, queries=queries)
