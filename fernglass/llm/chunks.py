"""Which rows of a chunk table are in force."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_force(chunks: DataFrame, columns: dict[str, Column], *, where: Column | None = None) -> DataFrame:
    """The latest state of every chunk_id (greatest file_mtime, null lowest), once.

    Only ``chunk_id`` and the given expressions are carried through the
    shuffle. ``where`` holds for whole chunk ids or whole states alike and is
    applied after the latest state is known. Rows that tie on file_mtime but
    differ are settled by the order of the expressions; rows without chunk_id
    are dropped.
    """
    at = F.coalesce(F.col("file_mtime").cast("double"), F.lit(float("-inf")))
    latest = chunks.filter("chunk_id is not null").select("chunk_id", F.struct(at.alias("in force at"), *[v.alias(k) for k, v in columns.items()]).alias("s")).groupBy("chunk_id").agg(F.max("s").alias("s"))
    out = latest.select("chunk_id", *[F.col(f"s.{k}").alias(k) for k in columns])
    return out if where is None else out.filter(where)


def line_count(text: Column) -> Column:
    """Lines of an excerpt, whose lines are joined by LF or CRLF: a last empty line counts."""
    return F.regexp_count(text, F.lit("\n")) + 1
