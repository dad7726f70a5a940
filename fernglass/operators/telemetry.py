"""Telemetry: call metrics, roll-ups, retention, lock events, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fernglass.operators import chunks

KEEP_RAW_DAYS, KEEP_DAILY_DAYS = 7, 90
FOLLOW_ON = ("signature", "exports")

METRIC_COLUMNS = ["call_timestamp", "tool_name", "tokens_returned", "tokens_full_file_upper_bound", "duration_ms", "session_id", "status"]


def once(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per key of a log in which rows repeat."""
    return chunks.once(rows.select(key, *columns), key)


def day_of(seconds: Column) -> Column:
    return F.to_date(F.timestamp_seconds(seconds))


#: Seconds of each unit of a span.
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def parse_since(text: Column, now: Column) -> Column:
    """Unix seconds of a point in time: a span before ``now`` (``7d``, ``12h``), or an ISO date or time; null if it is neither."""
    number, unit = F.regexp_extract(text, r"^\s*(\d+)\s*([smhdw])\s*$", 1), F.regexp_extract(text, r"^\s*(\d+)\s*([smhdw])\s*$", 2)
    size = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    return F.when(number != "", now - number.cast("double") * size[unit]).otherwise(F.unix_micros(F.try_to_timestamp(F.trim(text))) / 1e6)


def format_age(seconds: Column) -> Column:
    """The largest whole unit of an age: ``3d``, ``5h``, ``12m`` or ``40s``; negative ages are ``0s``."""
    a = F.greatest(F.floor(seconds), F.lit(0))
    out = F.concat(a.cast("string"), F.lit("s"))
    for unit in ("m", "h", "d"):
        out = F.when(a >= UNITS[unit], F.concat(F.floor(a / UNITS[unit]).cast("string"), F.lit(unit))).otherwise(out)
    return out


def efficiency(returned: Column, bound: Column) -> Column:
    """1 - returned / bound; negative when more was returned; 0 without a bound."""
    return F.when(bound > 0, 1.0 - returned / bound).otherwise(0.0)


def summary(calls: DataFrame, by: list[str]) -> DataFrame:
    """Calls, token sums, mean duration and efficiency per group."""
    out = calls.groupBy(*by).agg(
        F.count("*").alias("calls"),
        F.sum("tokens_returned").alias("tokens_returned"),
        F.sum("tokens_full_file_upper_bound").alias("tokens_full_file"),
        F.round(F.avg("duration_ms"), 6).alias("avg_duration_ms"),
    )
    return out.withColumn("efficiency_ratio", F.round(efficiency(F.col("tokens_returned"), F.col("tokens_full_file")), 9))


def nearest_rank(value: str, p: float) -> Column:
    """Nearest-rank percentile (sorted[ceil(p n) - 1]) of the values that are not null; 0 if there are none."""
    return F.coalesce(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})"), F.lit(0.0))


def with_percentiles(calls: DataFrame, by: list[str]) -> DataFrame:
    return calls.groupBy(*by).agg(F.count("*").alias("calls"), nearest_rank("duration_ms", 0.5).cast("double").alias("p50_ms"), nearest_rank("duration_ms", 0.95).cast("double").alias("p95_ms"))


def merge_daily(daily: DataFrame, new: DataFrame) -> DataFrame:
    """Add partial sums (n, sums) of new calls to daily rows: order and batching make no difference."""
    both = daily.unionByName(new)
    return both.groupBy("day", "tool_name").agg(*[F.sum(c).alias(c) for c in ("calls", "tokens_returned", "tokens_full_file", "duration_total", "duration_n")])


def daily_partials(calls: DataFrame) -> DataFrame:
    return calls.groupBy(day_of(F.col("call_timestamp")).alias("day"), "tool_name").agg(
        F.count("*").alias("calls"),
        F.sum("tokens_returned").alias("tokens_returned"),
        F.sum("tokens_full_file_upper_bound").alias("tokens_full_file"),
        F.sum("duration_ms").alias("duration_total"),
        F.count("duration_ms").alias("duration_n"),
    )


def retention(calls: DataFrame, now: Column, keep_days: int = KEEP_RAW_DAYS) -> DataFrame:
    """Rows kept and dropped per tool by an age limit, ``now`` in unix seconds."""
    keep = F.col("call_timestamp") >= now - keep_days * 86400
    return calls.groupBy("tool_name").agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("dropped"))


def lock_summary(events: DataFrame) -> DataFrame:
    """Per caller: acquisitions, holds and waits with p50, p95 and maximum, failures. Waits are those of acquired events."""
    wait = F.when(F.col("kind") == "acquired", F.col("wait_ms"))
    hold = F.when(F.col("kind") == "released", F.col("hold_ms"))
    rows = events.select("caller", "kind", wait.alias("wait"), hold.alias("hold"))
    p = lambda c, q, name: nearest_rank(c, q).cast("double").alias(name)
    return rows.groupBy("caller").agg(
        F.count_if(F.col("kind") == "acquired").alias("n_acquired"),
        p("hold", 0.5, "hold_p50"), p("hold", 0.95, "hold_p95"), F.coalesce(F.max("hold"), F.lit(0)).alias("hold_max"),
        p("wait", 0.5, "wait_p50"), p("wait", 0.95, "wait_p95"), F.coalesce(F.max("wait"), F.lit(0)).alias("wait_max"),
        F.count_if(F.col("kind") == "failed").alias("n_failed"),
    )


def follow_on(calls: DataFrame, tools: tuple[str, ...] = FOLLOW_ON, span: float = 3600.0) -> DataFrame:
    """For every search, the first later call of its session to one of ``tools`` (an as-of join).

    Sessions are cut into spans of time. Within a span a window looks ahead;
    what it does not find is the first such call of the next span that has
    one, from one row per session and span. So no task holds a whole session.
    """
    rows = calls.withColumn("span", F.floor(F.col("call_timestamp") / span))
    hit = F.when(F.col("tool_name").isin(*tools), F.struct("call_timestamp", "call_id", "tool_name"))
    firsts = rows.groupBy("session_id", "span").agg(F.min(hit).alias("first"))
    later = Window.partitionBy("session_id").orderBy("span").rowsBetween(1, Window.unboundedFollowing)
    beyond = firsts.select(F.col("session_id").alias("s"), F.col("span").alias("t"), F.first("first", ignorenulls=True).over(later).alias("beyond"))
    w = Window.partitionBy("session_id", "span").orderBy("call_timestamp", "call_id").rowsBetween(1, Window.unboundedFollowing)
    found = rows.withColumn("within", F.first(hit, ignorenulls=True).over(w)).filter("tool_name = 'search'")
    found = found.join(beyond, F.col("session_id").eqNullSafe(F.col("s")) & F.col("span").eqNullSafe(F.col("t"))).withColumn("next", F.coalesce("within", "beyond"))
    return found.select("call_id", "session_id", F.col("next.call_id").alias("follow_id"), F.col("next.tool_name").alias("follow_tool"))


def cap_json_list(items: Column, cap: int) -> Column:
    """JSON of a string list, at most ``cap`` items and then a marker of how many were left out."""
    more = F.concat(F.slice(items, 1, cap), F.array(F.format_string("_truncated:%d", F.size(items) - cap)))
    return F.to_json(F.when(F.size(items) > cap, more).otherwise(items))
