"""Session helpers shared by every operator."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SHARED = "spark.checkpoint.dir"


def get_spark(cores: str = "*", shuffle_partitions: int = 8, shared: str | None = None) -> SparkSession:
    """A local session with the settings the engine is tested under. ``shared`` is the folder for written intermediate tables."""
    shared = shared or os.environ.get("FERNGLASS_SHARED") or f"file://{tempfile.mkdtemp(prefix='fernglass-')}"
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("fernglass")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config(SHARED, shared)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's part of the folder that all executors share, removed when the driver ends.

    Where a session names no such folder, a temporary one serves, but only if
    driver and executors are one process; a cluster must name one.
    """
    context = spark.sparkContext
    root = spark.conf.get(SHARED, None)
    if not root:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError(f"{SHARED} must name a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/fernglass-shared"
    path = f"{root.rstrip('/')}/fernglass/{context.applicationId}"
    if path not in _CLEANED:
        _CLEANED.add(path)
        atexit.register(_remove, spark, path)
    return path


_CLEANED: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may have been stopped before
        if path.startswith("file:"):
            import shutil

            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def materialize(df: DataFrame, **options: str) -> DataFrame:
    """Cut lineage: write ``df`` once to the shared folder, with these options of the writer, and read it back.

    A written table, unlike a cached one, survives the loss of any executor
    and keeps its statistics and column pruning for the plans that read it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``df``, which nothing reads any more."""
    for path in {x.rpartition("/")[0] for x in df.inputFiles()}:
        _remove(df.sparkSession, path)


def input_partitions(spark: SparkSession) -> int:
    """Shuffle partitions as the session sets them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
