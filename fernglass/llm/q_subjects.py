"""Problem 9: which trades each document treats, and the make-up of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fernglass.llm.subjects import leaf_terms, subject_areas
from fernglass.session import table


def _areas(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    names = sorted(r.subject for r in table(spark, sf, "subjects").select("subject").collect())  # a fixed table of eight rows
    return subject_areas(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels"), names)


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _areas(spark, sf)[0].select("doc_id", "subject")


def p9_leaf_terms(spark: SparkSession, sf: str) -> DataFrame:
    _, leaves, counts = _areas(spark, sf)
    return leaf_terms(leaves, counts, table(spark, sf, "documents"))


def p9_composition(spark: SparkSession, sf: str) -> DataFrame:
    """Make-up of the corpus by source and subject: documents, and characters split by weight."""
    found = _areas(spark, sf)[0]
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    rows = docs.join(found, "doc_id", "left").groupBy("source", "subject").agg(F.count("*").alias("n_documents"), F.round(F.sum(F.col("n_chars") * F.coalesce("weight", F.lit(1.0))), 3).alias("n_chars"))
    return rows.withColumn("share_of_source", F.col("n_documents") / F.sum("n_documents").over(Window.partitionBy("source")))


QUERIES = {"p9_found": p9_found, "p9_composition": p9_composition, "p9_leaf_terms": p9_leaf_terms}
ORACLE: dict[str, str] = {}
