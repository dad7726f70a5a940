"""Warehouse snapshots: a folder of parquet tables per version, a schema version, and a pointer moved last."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

SCHEMA_VERSION = "1.0"


def _file(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def put_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _file(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def get_text(spark: SparkSession, path: str) -> str | None:
    p, fs = _file(spark, path)
    return "\n".join(r[0] for r in spark.read.text(path).collect()) if fs.exists(p) else None


def write_snapshot(spark: SparkSession, root: str, name: str, tables: dict[str, DataFrame]) -> None:
    """Write every table, then the meta file, then move the pointer: readers see whole snapshots only."""
    for t, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/{t}")
    put_text(spark, f"{root}/{name}/meta.json", json.dumps({"schema_version": SCHEMA_VERSION, "tables": sorted(tables)}))
    put_text(spark, f"{root}/CURRENT", name)


def read_snapshot(spark: SparkSession, root: str) -> dict[str, DataFrame] | None:
    """The current snapshot's tables; None if there is none or its schema version is another (to be rebuilt)."""
    name = get_text(spark, f"{root}/CURRENT")
    meta = get_text(spark, f"{root}/{name}/meta.json") if name else None
    if meta is None or json.loads(meta)["schema_version"] != SCHEMA_VERSION:
        return None
    return {t: spark.read.parquet(f"{root}/{name}/{t}") for t in json.loads(meta)["tables"]}
