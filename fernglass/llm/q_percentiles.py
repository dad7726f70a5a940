"""Problem 3: percentiles of call durations and lock waits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernglass.llm.percentiles import BITS, from_order_key, histogram, percentiles, radix_select
from fernglass.session import materialize, table

PS = [0.5, 0.95, 0.99]
ERROR = 2.0 ** (11 - BITS)


def measurements(spark: SparkSession, sf: str) -> DataFrame:
    """(measure, grp, day, value): one row per call or event, null and negative values left out."""
    day = lambda c: F.to_date(F.timestamp_seconds(F.col(c)))
    once = lambda t, k, *cols: table(spark, sf, t).groupBy(k).agg(F.min(F.struct(*cols)).alias("r")).select("r.*")
    calls = once("metrics", "call_id", "call_timestamp", "tool_name", "duration_ms").select(F.lit("duration_ms").alias("measure"), F.col("tool_name").alias("grp"), day("call_timestamp").alias("day"), F.col("duration_ms").alias("value"))
    locks = once("lock_events", "event_id", "event_ts", "caller", "wait_ms", "hold_ms").select(F.expr("stack(2, 'wait_ms', wait_ms, 'hold_ms', hold_ms) as (measure, value)"), "caller", "event_ts").select(
        "measure", F.col("caller").alias("grp"), day("event_ts").alias("day"), "value"
    )
    return calls.unionByName(locks).filter("value >= 0")


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """The daily results, written: mergeable histograms per measure, group and day. Any range of days needs these alone."""
    return materialize(histogram(measurements(spark, sf), ["measure", "grp", "day"], "value"))


def p3_daily_histograms(spark: SparkSession, sf: str) -> DataFrame:
    """The stored daily result itself, with the lower bound of every bucket."""
    low = F.shiftleft("bucket", 64 - BITS)
    return daily(spark, sf).select("measure", "grp", "day", from_order_key(low).alias("at_least"), "n")


def p3_daily_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return percentiles(daily(spark, sf), ["measure", "grp", "day"], PS).withColumn("max_rel_error", F.lit(ERROR))


def p3_range_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Per week, from the daily results alone."""
    days = daily(spark, sf).withColumn("week", F.to_date(F.date_trunc("week", "day")))
    return percentiles(days, ["measure", "grp", "week"], PS).withColumn("max_rel_error", F.lit(ERROR))


def p3_exact_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return radix_select(measurements(spark, sf), ["measure", "grp"], "value", PS)


_ROWS = """WITH v AS (
  SELECT 'duration_ms' AS measure, tool_name AS grp, CAST(make_timestamp(CAST(floor(call_timestamp * 1000000) AS BIGINT)) AS DATE) AS day, duration_ms AS value
  FROM (SELECT DISTINCT call_id, call_timestamp, tool_name, duration_ms FROM metrics)
  UNION ALL SELECT 'wait_ms', caller, CAST(make_timestamp(CAST(floor(event_ts * 1000000) AS BIGINT)) AS DATE), wait_ms FROM (SELECT DISTINCT event_id, caller, event_ts, wait_ms FROM lock_events)
  UNION ALL SELECT 'hold_ms', caller, CAST(make_timestamp(CAST(floor(event_ts * 1000000) AS BIGINT)) AS DATE), hold_ms FROM (SELECT DISTINCT event_id, caller, event_ts, hold_ms FROM lock_events)
), c AS (SELECT *, CASE WHEN value = 0 THEN 0 ELSE (floor(value / pow(2, length(bin(value)) - 1) * 512) + 0.5) / 512 * pow(2, length(bin(value)) - 1) END AS mid,
  date_trunc('week', day)::DATE AS week FROM v WHERE value >= 0)"""


def _sql(by: str) -> str:
    at = lambda p: f"min(mid) FILTER (WHERE r = greatest(1, (n * {p} + 99) // 100))"
    return f"""{_ROWS}, r AS (SELECT measure, grp, {by}, mid, row_number() OVER (PARTITION BY measure, grp, {by} ORDER BY mid) AS r,
  count(*) OVER (PARTITION BY measure, grp, {by}) AS n FROM c)
SELECT measure, grp, {by}, max(n) AS n, {at(50)} AS p50, {at(95)} AS p95, {at(99)} AS p99, CAST({ERROR!r} AS DOUBLE) AS max_rel_error FROM r GROUP BY measure, grp, {by}"""


QUERIES = {"p3_daily_percentiles": p3_daily_percentiles, "p3_daily_histograms": p3_daily_histograms, "p3_range_percentiles": p3_range_percentiles, "p3_exact_percentiles": p3_exact_percentiles}
ORACLE = {
    "p3_daily_percentiles": _sql("day"),
    "p3_daily_histograms": _ROWS + " SELECT measure, grp, day, CASE WHEN value = 0 THEN 0.0 ELSE floor(value / pow(2, length(bin(value)) - 1) * 512) / 512 * pow(2, length(bin(value)) - 1) END::DOUBLE AS at_least, count(*) AS n FROM c GROUP BY ALL",
    "p3_range_percentiles": _sql("week"),
    "p3_exact_percentiles": _ROWS
    + " SELECT measure, grp, count(*) AS n, "
    + ", ".join(f"CAST(quantile_disc(value, 0.{p}) AS DOUBLE) AS p{p}" for p in (50, 95, 99))
    + " FROM c GROUP BY measure, grp",
}
