"""Problem 5: chunks over their repository's threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernglass.llm.chunks import in_force, line_count
from fernglass.llm.splitting import split_oversized
from fernglass.session import table


def oversized(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks in force that span more lines than their repository allows, as items to split.

    The declaration's own lines are cut out of content: context_before lines
    are left off the front. The latest state is settled on small columns and a
    hash of the content; only oversized chunks fetch their text.
    """
    chunks = table(spark, sf, "chunks")
    c = F.col
    by_content = F.greatest(line_count(c("content")) - F.coalesce(c("context_before"), F.lit(0)) - F.coalesce(c("context_after"), F.lit(0)), F.lit(0))
    span = F.when(c("end_line") >= c("start_line"), c("end_line") - c("start_line") + 1).otherwise(by_content)
    small = {"file_mtime": c("file_mtime"), "span": span, "h": F.xxhash64("content"), "file_path": c("file_path"), "chunk_type": c("chunk_type"), "start_line": c("start_line"), "context_before": c("context_before"), "language": c("language")}
    repos = table(spark, sf, "repos").select(F.col("repo"), F.col("chunk_split_threshold").alias("limit"), F.col("overlap_lines").alias("overlap"))
    over = in_force(chunks, small, where=F.col("chunk_type").isNull() | (F.col("chunk_type") != "class_shell")).withColumn("repo", F.substring_index(F.ltrim("file_path", F.lit("/")), "/", 1))
    # repos is a fixed table of 24 rows
    over = over.join(F.broadcast(repos), "repo").filter("span > limit")
    texts = chunks.select(F.col("chunk_id").alias("id"), F.xxhash64("content").alias("h2"), F.coalesce("file_mtime", F.lit(float("-inf"))).alias("m2"), "content")
    hit = over.join(texts, (over.chunk_id == texts.id) & (over.h == texts.h2) & (F.coalesce(over.file_mtime, F.lit(float("-inf"))) == texts.m2)).dropDuplicates(["chunk_id"])
    before = F.coalesce("context_before", F.lit(0))
    lines = F.slice(F.split("content", "\n"), before + 1, F.col("span"))
    return hit.select(F.col("chunk_id").alias("item_id"), F.array_join(lines, "\n").alias("text"), F.col("start_line").alias("first_line"), "limit", "overlap", (F.col("chunk_type") == "doc").alias("prose"))


def p5_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split_oversized(oversized(spark, sf)).withColumnRenamed("item_id", "chunk_id")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return p5_pieces(spark, sf).select("chunk_id").distinct()


QUERIES = {"p5_found": p5_found, "p5_pieces": p5_pieces}
ORACLE = {
    "p5_found": """WITH f AS (SELECT chunk_id, arg_max(struct_pack(a := file_path, b := chunk_type, s := start_line, e := end_line, l := length(content) - length(replace(content, chr(10), '')) + 1 - coalesce(context_before, 0) - coalesce(context_after, 0)), file_mtime) AS x FROM chunks GROUP BY chunk_id)
SELECT chunk_id FROM f JOIN repos r ON r.repo = split_part(x.a, '/', 1)
WHERE x.b <> 'class_shell' AND CASE WHEN x.e >= x.s THEN x.e - x.s + 1 ELSE x.l END > r.chunk_split_threshold"""
}
