"""Extraction queries over the files table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernglass.operators.graph import current_symbols, distinct_edges, link_edges
from fernglass.plans.code_graph import _stars as star_links
from fernglass.session import materialize, table
from fernglass.sources import extract as X


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "files").filter("content is not null").select("path", "content")


def markdown_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return X.extract_chunks(_files(spark, sf).filter(F.col("path").endswith(".md"))).drop("content")


def ts_symbols(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.extract_chunks(_files(spark, sf).filter(~F.col("path").endswith(".md")))
    return rows.filter("chunk_type <> 'block'").select("file_path", F.col("symbol_name").alias("name"), F.col("chunk_type").alias("kind"), F.col("start_line").alias("line"), "is_exported")


def ts_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return X.extract_chunks(_files(spark, sf)).select("chunk_id", "file_path", "start_line", "end_line", "chunk_type", "symbol_name", "parent_symbol", "is_exported", F.sha2("content", 256).alias("content_hash"))


def ts_imports(spark: SparkSession, sf: str) -> DataFrame:
    files = _files(spark, sf)
    return X.resolve_imports(X.extract_imports(files), files.select("path"))


def ts_edges(spark: SparkSession, sf: str) -> DataFrame:
    return X.extract_edges(_files(spark, sf))


def extracted_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of the files as they are, linked to the symbols in the index, imports followed through re-exports."""
    files = _files(spark, sf)
    # imports and re-exports of each file, and what they resolve to
    imports = materialize(X.resolve_imports(X.extract_imports(files), files.select("path")))
    stars = star_links(spark, sf)
    homes = table(spark, sf, "files").filter("deleted_at is null")
    edges = distinct_edges(table(spark, sf, "edges"))
    return link_edges(materialize(X.extract_edges(files)), current_symbols(table(spark, sf, "symbols")), imports, (edges, homes, stars))


QUERIES = {f.__name__: f for f in (markdown_chunks, ts_symbols, ts_chunks, ts_imports, ts_edges, extracted_graph)}
ORACLE: dict[str, str] = {}
