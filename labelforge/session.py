"""Session helpers: a local session for tests/bench and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "labelforge") -> SparkSession:
    """A local[N] session configured the way the tests and the bench expect."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LABELFORGE_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``labelforge`` importable in the Python workers (``addPyFile`` of a zip).

    Pandas UDFs and cogroup functions refer to functions of this package;
    executors import it from the zip Spark distributes (the same mechanism as
    ``spark-submit --py-files``). Done once per application.
    """
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="labelforge-pyfiles-"), "labelforge.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster (``spark.checkpoint.dir``).

    On a cluster the folder must be set by the deployment. Only when it is unset
    (local tests and the bench) a fresh scratch folder is created and registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="labelforge-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a query that runs here go when it ends, not when the driver's collector gets to them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/labelforge-tables/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def append_lineage(df: DataFrame, path: str) -> None:
    """Write ``df`` behind what ``path`` holds, and free its shuffle files."""
    with shuffles_freed(df.sparkSession):
        df.write.mode("append").option("compression", "zstd").parquet(path)


def cut_lineage(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet into the shared checkpoint folder and read it back.

    Used for frames that several jobs reuse (the deduplicated corpus, the BM25
    term counts): the lineage is cut, a lost executor re-reads files
    instead of recomputing, and the data is computed exactly once (an eager
    ``Dataset.checkpoint`` runs its input twice and stores serialized rows). The
    shuffle files of the computation go with its end.
    """
    spark = df.sparkSession
    path = table_path(spark, name)
    with shuffles_freed(spark):
        df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)
