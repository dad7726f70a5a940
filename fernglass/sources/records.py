"""JSON sources and the append sink: line logs with counted bad lines, gold queries, appended tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOCK_EVENTS = "kind string, type string, caller string, waitMs double, holdMs double, timestamp double"
#: What each kind of lock event must have besides kind, type and timestamp.
LOCK_NEEDS = {"acquired": ("waitMs",), "released": ("holdMs",), "failed": ("waitMs",)}
GOLD = "queries array<struct<id string, query string, relevant array<struct<file_path string, symbol string, line int>>>>"


def read_lines(spark: SparkSession, path: str, schema: str, needs: dict[str, tuple[str, ...]], always: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines by reason) of a file or folder of JSON lines.

    A line is bad if it is no JSON of this schema, if its ``kind`` is unknown,
    or if a field its kind needs is missing. Blank lines are neither. Each line
    is parsed once and none is thrown away silently.
    """
    text = spark.read.text(path).filter(F.trim("value") != "")
    rows = text.select("value", F.from_json("value", schema + ", broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}).alias("r"))
    missing: Column = reduce(lambda a, b: a | b, [F.col(f"r.{c}").isNull() for c in always], F.lit(False))
    for kind, fields in needs.items():
        missing = missing | ((F.col("r.kind") == kind) & reduce(lambda a, b: a | b, [F.col(f"r.{c}").isNull() for c in fields], F.lit(False)))
    why = (
        F.when(F.col("r").isNull() | F.col("r.broken").isNotNull(), "not of the schema")
        .when(F.col("r.kind").isNull() | ~F.col("r.kind").isin(*needs), "unknown kind")
        .when(missing, "missing field")
    )
    judged = rows.withColumn("why", why)
    good = judged.filter("why is null").select("r.*").drop("broken")
    return good, judged.filter("why is not null").groupBy(F.col("why").alias("reason")).agg(F.count("*").alias("n_lines"))


def read_lock_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return read_lines(spark, path, LOCK_EVENTS, LOCK_NEEDS, ("type", "timestamp"))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query, target_id, file_path, symbol, line): one row per relevant place; a query without any keeps one row."""
    q = spark.read.schema(GOLD).json(path, multiLine=True).select(F.explode("queries").alias("q"))
    rows = q.select(F.col("q.id").alias("query_id"), F.col("q.query").alias("query"), F.posexplode_outer("q.relevant").alias("target_id", "t"))
    return rows.select("query_id", "query", "target_id", "t.file_path", "t.symbol", "t.line")


def append(rows: DataFrame, path: str) -> None:
    """Add rows to a table; readers see whole files only."""
    rows.write.mode("append").parquet(path)
