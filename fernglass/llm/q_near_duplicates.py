"""Problem 4: functions and methods that recur with small changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernglass.llm.chunks import in_force
from fernglass.llm.near_duplicates import classes, components, similar_classes
from fernglass.session import table

WORDS, MIN_WORDS, THRESHOLD = 4, 30, 0.6


def functions_in_force(spark: SparkSession, sf: str) -> DataFrame:
    """(id, text) of function and method chunks in force. Settled on small columns, then the texts are fetched."""
    chunks = table(spark, sf, "chunks")
    at = F.coalesce(F.col("file_mtime").cast("double"), F.lit(float("-inf")))
    now = in_force(chunks, {"at": at, "chunk_type": F.col("chunk_type"), "h": F.xxhash64("content")}, where=F.col("chunk_type").isin("function", "method"))
    rows = chunks.filter(F.col("chunk_type").isin("function", "method")).select(F.col("chunk_id").alias("cid"), at.alias("m"), F.xxhash64("content").alias("x"), F.col("content").alias("text"))
    same = (F.col("chunk_id") == F.col("cid")) & (F.col("at") == F.col("m")) & (F.col("h") == F.col("x"))
    return now.join(rows, same).select(F.col("chunk_id").alias("id"), "text")


def _similar(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    members, sets = classes(functions_in_force(spark, sf), WORDS, MIN_WORDS)
    return members, similar_classes(sets, THRESHOLD)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of different chunks, as TESTDATA.md asks: links between classes, and copies, over their members."""
    members, pairs = _similar(spark, sf)
    every = pairs.select("a", "b").union(members.groupBy("class").count().filter("count > 1").select(F.col("class").alias("a"), F.col("class").alias("b")))
    left, right = members.select(F.col("id").alias("x"), F.col("class").alias("a")), members.select(F.col("id").alias("y"), F.col("class").alias("b"))
    out = every.join(left, "a").join(right, "b").filter((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
    return out.select(F.least("x", "y").alias("chunk_id_a"), F.greatest("x", "y").alias("chunk_id_b"))


def p4_groups(spark: SparkSession, sf: str) -> DataFrame:
    """One row per chunk: its class of equal sets, the group of linked classes, and its class's number of links."""
    members, pairs = _similar(spark, sf)
    from fernglass.session import materialize

    pairs = materialize(pairs)
    groups = components(members.select(F.col("class").alias("id")), pairs)
    links = pairs.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("n_links"))
    named = members.groupBy("class").agg(F.min("id").alias("class_id"))
    out = members.join(groups.withColumnRenamed("id", "class"), "class").join(links, "class", "left").join(named, "class")
    heads = named.select(F.col("class").alias("group"), F.col("class_id").alias("group_id"))
    return out.join(heads, "group").select(F.col("id").alias("chunk_id"), "class_id", "group_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


QUERIES = {"p4_found": p4_found, "p4_groups": p4_groups}
ORACLE: dict[str, str] = {}
