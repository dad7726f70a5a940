"""Problem 2: code and description of documented functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernglass.llm.chunks import in_force
from fernglass.llm.documentation import pair_functions
from fernglass.session import table


def _functions(spark: SparkSession, sf: str) -> DataFrame:
    """Function and method chunks in force, partitioned by chunk_id alone so that the token windows reuse it."""
    chunks = table(spark, sf, "chunks")
    at = F.coalesce(F.col("file_mtime").cast("double"), F.lit(float("-inf")))
    h = F.xxhash64("content", "symbol_name", "context_before", "chunk_type")
    now = in_force(chunks, {"at": at, "chunk_type": F.col("chunk_type"), "h": h}, where=F.col("chunk_type").isin("function", "method"))
    rows = chunks.filter(F.col("chunk_type").isin("function", "method")).select(F.col("chunk_id").alias("cid"), at.alias("m"), h.alias("x"), "content", "symbol_name", "context_before")
    # no equalities, which would partition by more than chunk_id; a difference would not do for two null times
    same = (F.col("chunk_id") == F.col("cid")) & (F.col("h").bitwiseXOR(F.col("x")) == 0) & (F.col("at") >= F.col("m")) & (F.col("at") <= F.col("m"))
    kept = now.join(rows, same).groupBy("chunk_id").agg(F.first("content").alias("text"), F.first("symbol_name").alias("name"), F.first("context_before").alias("declaration"))
    return kept.withColumnRenamed("chunk_id", "id")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return pair_functions(_functions(spark, sf), code=False).select(F.col("id").alias("chunk_id"))


def p2_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return pair_functions(_functions(spark, sf)).withColumnRenamed("id", "chunk_id")


QUERIES = {"p2_found": p2_found, "p2_pairs": p2_pairs}
ORACLE: dict[str, str] = {}
