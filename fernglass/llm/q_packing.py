"""Problem 7: documents into containers of every capacity in pack_sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernglass.llm.packing import fill_report, pack
from fernglass.llm.tokens import token_table
from fernglass.session import table


def _capacities(spark: SparkSession, sf: str) -> dict[str, int]:
    return {r.container: r.capacity_tokens for r in table(spark, sf, "pack_sizes").collect()}  # a fixed table of three rows


def p7_packed(spark: SparkSession, sf: str) -> DataFrame:
    sizes = token_table(table(spark, sf, "documents"), "doc_id").select(F.col("doc_id").alias("item_id"), F.col("n_tokens").alias("size"))
    packed = pack(sizes, _capacities(spark, sf))
    return packed.select("container", "lane", "bin", F.col("item_id").alias("doc_id"), "piece", F.col("size").alias("n_tokens"), F.col("start").alias("token_start"))


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    return fill_report(p7_packed(spark, sf).withColumnRenamed("n_tokens", "size"), _capacities(spark, sf))


QUERIES = {"p7_packed": p7_packed, "p7_fill": p7_fill}
ORACLE: dict[str, str] = {}
