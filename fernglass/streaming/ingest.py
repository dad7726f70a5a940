"""Structured Streaming wrappers: the same batch functions, fed by micro-batches."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fernglass.operators.ingest import monotonic_merge

QUIET = "500 milliseconds"
LOG = logging.getLogger("fernglass")
MAX_FAILURES = 3


def watch(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """File events (parquet rows landing in a folder) as a stream. Deletions are found by a manifest diff, not here."""
    return spark.readStream.schema(schema).parquet(folder)


def coalesced(events: DataFrame, at: str = "event_time", path: str = "path", delay: str = "10 seconds") -> DataFrame:
    """One row per path and quiet period: events closer than the quiet period fall together."""
    return events.withWatermark(at, delay).groupBy(F.session_window(at, QUIET), path).agg(F.count("*").alias("n_events"), F.max(at).alias("last"))


def daily_rollup(calls: DataFrame, at: str = "event_time", delay: str = "3 days") -> DataFrame:
    """Running calls and sums per day and tool; rows later than the delay are dropped by the watermark."""
    return calls.withWatermark(at, delay).groupBy(F.window(at, "1 day"), "tool_name").agg(
        F.count("*").alias("calls"), F.sum("tokens_returned").alias("tokens_returned"), F.sum("duration_ms").alias("duration_total"), F.count("duration_ms").alias("duration_n")
    )


def merge_into(folder: str, key: str, at: str, arrival: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that keeps the latest row per key in versioned snapshots.

    Each batch writes a new snapshot and then moves the pointer file, so readers
    never see half a batch and a repeated batch changes nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now = current_snapshot(spark, folder)
        first = batch.limit(0) if now is None else now
        monotonic_merge(first, batch, key, at, arrival).write.mode("overwrite").parquet(f"{folder}/v{batch_id}")
        _pointer(spark, folder, f"v{batch_id}")

    return write


def _fs(spark: SparkSession, folder: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return jvm, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _pointer(spark: SparkSession, folder: str, name: str) -> None:
    jvm, fs = _fs(spark, folder)
    out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{folder}/CURRENT"), True)
    out.writeBytes(name)
    out.close()


def current_snapshot(spark: SparkSession, folder: str) -> DataFrame | None:
    jvm, fs = _fs(spark, folder)
    if not fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/CURRENT")):
        return None
    name = spark.read.text(f"{folder}/CURRENT").first()[0]
    return spark.read.parquet(f"{folder}/{name}")


def retrying(write: Callable[[DataFrame, int], None], failures: list[int] | None = None) -> Callable[[DataFrame, int], None]:
    """Tries a batch up to MAX_FAILURES times, then leaves it out, notes its id and logs why."""
    failures = [] if failures is None else failures

    def attempt(batch: DataFrame, batch_id: int) -> None:
        for n in range(MAX_FAILURES):
            try:
                return write(batch, batch_id)
            except Exception:
                last = n == MAX_FAILURES - 1
                LOG.warning("batch %s failed, try %s of %s%s", batch_id, n + 1, MAX_FAILURES, ": left out" if last else "", exc_info=True)
                if last:
                    failures.append(batch_id)
        return None

    return attempt


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there in micro-batches, then stop."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
