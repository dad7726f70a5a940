"""Problem 6: files that a strict parser of their language rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernglass.llm.parsing import invalid_files, language
from fernglass.session import table


def _files(spark: SparkSession, sf: str) -> DataFrame:
    # one row per file, spread by file_id so that the token windows need no shuffle of tokens
    return table(spark, sf, "files").filter("content is not null").select("file_id", "path", "content").repartition("file_id")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return invalid_files(_files(spark, sf)).select("file_id")


def p6_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Share of unparsable files per repository and language, by path."""
    files = table(spark, sf, "files").filter("content is not null")
    bad = invalid_files(_files(spark, sf)).select("file_id", F.lit(1).alias("bad"))
    kind = F.coalesce(F.when(language(F.col("path")).isin("ts", "tsx"), "typescript").when(language(F.col("path")).isNotNull(), "javascript"), F.when(F.col("path").endswith(".md"), "markdown"), F.lit("other"))
    rows = files.select("file_id", F.substring_index("path", "/", 1).alias("repo"), kind.alias("language")).join(bad, "file_id", "left")
    return rows.groupBy("repo", "language").agg(F.count("*").alias("n_files"), F.count("bad").alias("n_invalid"), (F.count("bad") / F.count("*")).alias("rate"))


QUERIES = {"p6_found": p6_found, "p6_rates": p6_rates}
ORACLE: dict[str, str] = {}
