"""Streaming queries, run to completion over the tables as files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernglass.session import shared_dir
from fernglass.streaming.ingest import current_snapshot, daily_rollup, merge_into, run_available


def _source(spark: SparkSession, sf: str, name: str) -> DataFrame:
    path = f"{sf}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(spark, path) else f"{sf}/{name}*.parquet")


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def stream_daily_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Daily sums of calls by a stream in update mode; the last update of each day and tool is the result."""
    out = f"{shared_dir(spark)}/fernglass/{uuid.uuid4().hex}"
    calls = _source(spark, sf, "metrics").withColumn("event_time", F.timestamp_seconds("call_timestamp")).dropDuplicates(["call_id"])

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(f"{out}/rows")

    run_available(daily_rollup(calls), sink, f"{out}/checkpoint", "update")
    rows = spark.read.parquet(f"{out}/rows")
    latest = rows.groupBy(F.to_date("window.start").alias("day"), "tool_name").agg(F.max_by(F.struct("calls", "tokens_returned", "duration_total", "duration_n"), "batch_id").alias("s"))
    return latest.select("day", "tool_name", "s.calls", "s.tokens_returned")


def stream_monotonic_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Latest state per chunk_id by a stream of chunk rows merged into snapshots."""
    out = f"{shared_dir(spark)}/fernglass/{uuid.uuid4().hex}"
    rows = _source(spark, sf, "chunks").select("chunk_id", "file_mtime", "start_line", "chunk_type", F.xxhash64("content").alias("arrival"))
    run_available(rows, merge_into(f"{out}/merged", "chunk_id", "file_mtime", "arrival"), f"{out}/checkpoint")
    return current_snapshot(spark, f"{out}/merged").select("chunk_id", "file_mtime", "start_line", "chunk_type")


QUERIES = {f.__name__: f for f in (stream_daily_rollup, stream_monotonic_merge)}
ORACLE = {
    "stream_daily_rollup": "SELECT CAST(make_timestamp(CAST(floor(call_timestamp * 1000000) AS BIGINT)) AS DATE) AS day, tool_name, count(*) AS calls, CAST(sum(tokens_returned) AS BIGINT) AS tokens_returned FROM (SELECT DISTINCT call_id, call_timestamp, tool_name, tokens_returned FROM metrics) GROUP BY 1, 2",
    "stream_monotonic_merge": "SELECT chunk_id, max(file_mtime) AS file_mtime, arg_max(start_line, file_mtime) AS start_line, arg_max(chunk_type, file_mtime) AS chunk_type FROM chunks GROUP BY chunk_id",
}
