"""Telemetry queries over metrics and lock_events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernglass.operators import telemetry as T
from fernglass.operators.chunks import once
from fernglass.session import table


def calls(spark: SparkSession, sf: str) -> DataFrame:
    return T.once(table(spark, sf, "metrics"), "call_id", T.METRIC_COLUMNS)


def metrics_summary(spark: SparkSession, sf: str) -> DataFrame:
    return T.summary(calls(spark, sf).filter("call_timestamp >= 1743465600"), ["tool_name"])


def session_summary(spark: SparkSession, sf: str) -> DataFrame:
    return T.summary(calls(spark, sf), ["session_id", "tool_name"])


def metrics_daily_rollup(spark: SparkSession, sf: str) -> DataFrame:
    parts = T.daily_partials(calls(spark, sf))
    done = T.merge_daily(parts.filter("day < date '2025-04-01'"), parts.filter("day >= date '2025-04-01'"))
    return done.select("day", "tool_name", "calls", "tokens_returned", "tokens_full_file", F.round(F.col("duration_total") / F.col("duration_n"), 6).alias("avg_duration_ms"))


def metrics_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return T.with_percentiles(calls(spark, sf), ["tool_name"])


def efficiency_report(spark: SparkSession, sf: str) -> DataFrame:
    per = T.summary(calls(spark, sf), ["tool_name"])
    by_tool = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tool_name", "calls"))), lambda x: F.concat(x["tool_name"], F.lit("="), x["calls"])), ",")
    out = per.agg(F.sum("calls").alias("calls"), F.sum("tokens_returned").alias("tokens_returned"), F.sum("tokens_full_file").alias("tokens_full_file"), by_tool.alias("calls_by_tool"))
    return out.withColumn("efficiency_ratio", F.round(T.efficiency(F.col("tokens_returned"), F.col("tokens_full_file")), 9))


def metrics_retention(spark: SparkSession, sf: str) -> DataFrame:
    return T.retention(calls(spark, sf), F.lit(1747872000.0), 30)


def lock_summary(spark: SparkSession, sf: str) -> DataFrame:
    return T.lock_summary(T.once(table(spark, sf, "lock_events"), "event_id", ["kind", "caller", "wait_ms", "hold_ms"]))


def chain_follow_on(spark: SparkSession, sf: str) -> DataFrame:
    return T.follow_on(calls(spark, sf))


def chain_rate(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.follow_on(calls(spark, sf))
    return rows.groupBy("session_id").agg(F.count("*").alias("n_searches"), F.count("follow_id").alias("n_followed"), F.round(100.0 * F.count("follow_id") / F.count("*"), 6).alias("rate"))


def session_inventory(spark: SparkSession, sf: str) -> DataFrame:
    day = T.day_of(F.col("call_timestamp"))
    return calls(spark, sf).groupBy("tool_name").agg(F.count("*").alias("calls"), F.countDistinct("session_id").alias("n_sessions"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return calls(spark, sf).groupBy("tool_name", "status").agg(F.count("*").alias("calls"))


def import_symbols_capped(spark: SparkSession, sf: str) -> DataFrame:
    return once(table(spark, sf, "imports").select("import_id", "symbols"), "import_id").select("import_id", T.cap_json_list(F.col("symbols"), 2).alias("json"))


def file_token_bound(spark: SparkSession, sf: str) -> DataFrame:
    """Upper bound of tokens per repository: distinct files, a quarter of their bytes each, rounded up."""
    rows = table(spark, sf, "files").filter("deleted_at is null").groupBy("path").agg(F.max_by(F.octet_length("content"), F.struct("indexed_at", "file_id")).alias("bytes"))
    return rows.groupBy(F.substring_index("path", "/", 1).alias("repo")).agg(F.count("*").alias("n_files"), F.sum(F.ceil(F.coalesce("bytes", F.lit(0)) / 4.0)).alias("token_bound"))


_M = "m AS (SELECT DISTINCT call_id, call_timestamp, tool_name, tokens_returned, tokens_full_file_upper_bound, duration_ms, session_id, status FROM metrics)"
_DAY = "CAST(make_timestamp(CAST(floor(call_timestamp * 1000000) AS BIGINT)) AS DATE)"
_SUM = """count(*) AS calls, CAST(sum(tokens_returned) AS BIGINT) AS tokens_returned, CAST(sum(tokens_full_file_upper_bound) AS BIGINT) AS tokens_full_file, round(avg(duration_ms), 6) AS avg_duration_ms,
  round(CASE WHEN sum(tokens_full_file_upper_bound) > 0 THEN 1.0::DOUBLE - sum(tokens_returned)::DOUBLE / sum(tokens_full_file_upper_bound) ELSE 0 END, 9) AS efficiency_ratio"""
_FOLLOW = """f AS (SELECT call_id, session_id, tool_name, first_value(CASE WHEN tool_name IN ('signature', 'exports') THEN call_id END IGNORE NULLS) OVER w AS follow_id,
  first_value(CASE WHEN tool_name IN ('signature', 'exports') THEN tool_name END IGNORE NULLS) OVER w AS follow_tool FROM m
  WINDOW w AS (PARTITION BY session_id ORDER BY call_timestamp, call_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))"""

QUERIES = {
    f.__name__: f
    for f in (
        metrics_summary, session_summary, metrics_daily_rollup, metrics_percentiles, efficiency_report, metrics_retention, lock_summary, chain_follow_on, chain_rate, session_inventory, status_counts,
        import_symbols_capped, file_token_bound,
    )
}
ORACLE = {
    "metrics_summary": f"WITH {_M} SELECT tool_name, {_SUM} FROM m WHERE call_timestamp >= 1743465600 GROUP BY 1",
    "session_summary": f"WITH {_M} SELECT session_id, tool_name, {_SUM} FROM m GROUP BY 1, 2",
    "metrics_daily_rollup": f"WITH {_M} SELECT {_DAY} AS day, tool_name, count(*) AS calls, CAST(sum(tokens_returned) AS BIGINT) AS tokens_returned, CAST(sum(tokens_full_file_upper_bound) AS BIGINT) AS tokens_full_file, round(sum(duration_ms)::DOUBLE / count(duration_ms), 6) AS avg_duration_ms FROM m GROUP BY 1, 2",
    "metrics_percentiles": f"WITH {_M} SELECT tool_name, count(*) AS calls, CAST(quantile_disc(duration_ms, 0.5) AS DOUBLE) AS p50_ms, CAST(quantile_disc(duration_ms, 0.95) AS DOUBLE) AS p95_ms FROM m GROUP BY 1",
    "efficiency_report": f"""WITH {_M} SELECT count(*) AS calls, CAST(sum(tokens_returned) AS BIGINT) AS tokens_returned, CAST(sum(tokens_full_file_upper_bound) AS BIGINT) AS tokens_full_file,
  (SELECT string_agg(tool_name || '=' || n, ',' ORDER BY tool_name) FROM (SELECT tool_name, count(*) AS n FROM m GROUP BY 1)) AS calls_by_tool,
  round(1.0::DOUBLE - sum(tokens_returned)::DOUBLE / sum(tokens_full_file_upper_bound), 9) AS efficiency_ratio FROM m""",
    "metrics_retention": f"WITH {_M} SELECT tool_name, count(*) FILTER (WHERE call_timestamp >= 1747872000.0 - 30 * 86400) AS kept, count(*) FILTER (WHERE call_timestamp < 1747872000.0 - 30 * 86400) AS dropped FROM m GROUP BY 1",
    "lock_summary": """WITH l AS (SELECT DISTINCT event_id, kind, caller, wait_ms, hold_ms FROM lock_events), v AS (SELECT caller, kind, CASE WHEN kind = 'acquired' THEN wait_ms END AS wait, CASE WHEN kind = 'released' THEN hold_ms END AS hold FROM l)
  SELECT caller, count(*) FILTER (WHERE kind = 'acquired') AS n_acquired, coalesce(CAST(quantile_disc(hold, 0.5) AS DOUBLE), 0) AS hold_p50, coalesce(CAST(quantile_disc(hold, 0.95) AS DOUBLE), 0) AS hold_p95, coalesce(max(hold), 0) AS hold_max,
  coalesce(CAST(quantile_disc(wait, 0.5) AS DOUBLE), 0) AS wait_p50, coalesce(CAST(quantile_disc(wait, 0.95) AS DOUBLE), 0) AS wait_p95, coalesce(max(wait), 0) AS wait_max, count(*) FILTER (WHERE kind = 'failed') AS n_failed FROM v GROUP BY 1""",
    "chain_follow_on": f"WITH {_M}, {_FOLLOW} SELECT call_id, session_id, follow_id, follow_tool FROM f WHERE tool_name = 'search'",
    "chain_rate": f"WITH {_M}, {_FOLLOW} SELECT session_id, count(*) AS n_searches, count(follow_id) AS n_followed, round(100.0::DOUBLE * count(follow_id) / count(*), 6) AS rate FROM f WHERE tool_name = 'search' GROUP BY 1",
    "session_inventory": f"WITH {_M} SELECT tool_name, count(*) AS calls, count(DISTINCT session_id) AS n_sessions, min({_DAY}) AS first_day, max({_DAY}) AS last_day FROM m GROUP BY 1",
    "status_counts": f"WITH {_M} SELECT tool_name, status, count(*) AS calls FROM m GROUP BY 1, 2",
    "import_symbols_capped": """SELECT import_id, '[' || array_to_string(list_transform(CASE WHEN len(symbols) > 2 THEN list_concat(symbols[1:2], ['_truncated:' || (len(symbols) - 2)]) ELSE symbols END, lambda x: '"' || x || '"'), ',') || ']' AS json FROM (SELECT DISTINCT import_id, symbols FROM imports)""",
    "file_token_bound": "SELECT split_part(path, '/', 1) AS repo, count(*) AS n_files, CAST(sum(ceil(coalesce(strlen(content), 0) / 4.0)) AS BIGINT) AS token_bound FROM (SELECT DISTINCT ON (path) path, content FROM files WHERE deleted_at IS NULL) GROUP BY 1",
}
