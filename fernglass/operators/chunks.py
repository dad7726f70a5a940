"""Latest states of chunks and symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAR_FUTURE = "9999-12-31"


def latest(rows: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """One row per key, that of the greatest ``at``; ties are settled by the columns in order. Combines before it shuffles."""
    s = F.max(F.struct(F.col(at).alias("at"), *[F.col(c).alias(c) for c in columns if c != key])).alias("s")
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(s).select(key, *[F.col(f"s.{c}").alias(c) for c in columns if c != key])


def current(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows not deleted, the latest life of each key."""
    return latest(rows.filter("deleted_at is null"), key, "indexed_at", columns)


def once(rows: DataFrame, key: str) -> DataFrame:
    """One row per key of a table in which rows repeat, the least where they differ. Combines before it shuffles."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min(F.struct(*rest)).alias("least of key")).select(key, *[F.col("least of key")[c].alias(c) for c in rest])
