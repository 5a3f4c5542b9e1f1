"""Shared helpers of the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.session import checkpoint_dir, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark's reader touches the path."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def crc_fold(modulus: int, name: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, modulo ``modulus`` (null id: fold of the empty text, 0)."""
    return F.pmod(F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def parallelism(spark: SparkSession) -> int:
    """The shuffle width the deployment asked for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def labels_of(labels: DataFrame, name: str) -> DataFrame:
    """One 0/1 label per doc_id: null labels and null ids are dropped, repeats give the largest."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(name).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max(name).cast("int").alias("label"))
    )


def store(df: DataFrame, name: str, codec: str = "zstd", group_bytes: int | None = None) -> DataFrame:
    """Like ``cut_lineage`` with a denser codec, for tables that hold texts.

    ``group_bytes``: bytes of a row group, about, for rows of megabytes. Spark's writer
    and reader hold a row group whole, and by default look at its size every 100 rows.
    """
    base, app = checkpoint_dir(df.sparkSession).rstrip("/"), df.sparkSession.sparkContext.applicationId
    path = f"{base}/labelforge-tables/{app}/{name}-{uuid.uuid4().hex}"
    out = df.write.mode("errorifexists").option("compression", codec)
    if group_bytes is not None:
        checks = {f"parquet.{part}.size.row.check.{end}": "1" for part in ("block", "page") for end in ("min", "max")}
        out = out.options(**checks, **{"parquet.block.size": str(group_bytes)})
    out.parquet(path)
    return df.sparkSession.read.parquet(path)
