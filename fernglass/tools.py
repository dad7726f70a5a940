"""The query tools over one set of tables; each returns a DataFrame, ``as_json`` its wire form."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernglass.functions.paths import glob_match
from fernglass.functions.text import clip, first_doc_comment, pascal_types
from fernglass.operators import graph as G
from fernglass.operators import ingest, search, telemetry
from fernglass.operators.chunks import latest, once

PAGE = 50


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("json"))


class CodeIndex:
    """``tables`` has files, chunks, symbols, edges, imports, re_export_files and metrics, as in the data model."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]):
        self.spark, self.tables = spark, tables
        self.chunks = latest(tables["chunks"], "chunk_id", "file_mtime", ["chunk_id", "file_path", "start_line", "end_line", "content", "chunk_type", "symbol_name", "parent_symbol", "is_exported", "language"])
        self.symbols = G.current_symbols(tables["symbols"])
        self.edges = G.distinct_edges(tables["edges"])
        self.imports = once(tables["imports"], "import_id")

    def search(self, query: str, limit: int = 10, *, language: str | None = None, file_pattern: str | None = None, chunk_type: str | None = None, only_exported: bool = False) -> DataFrame:
        scope, post = self._all(language and F.col("language") == language, file_pattern and glob_match(F.col("file_path"), file_pattern)), self._all(chunk_type and F.col("chunk_type") == chunk_type, only_exported and F.col("is_exported"))
        found = search.fused_search(self.spark, self.chunks, [(1, query)], limit=limit, scope=scope, post=post)
        return found.join(self.chunks, "chunk_id").select("rank", "chunk_id", "file_path", "start_line", "end_line", "symbol_name", "chunk_type", "rrf", "hint", clip(F.col("content")).alias("excerpt"))

    @staticmethod
    def _all(*conditions: Column | str | bool | None) -> Column | None:
        out = None
        for c in conditions:
            if isinstance(c, Column):
                out = c if out is None else out & c
        return out

    def project_skeleton(self, directory: str = "", max_depth: int | None = None) -> DataFrame:
        return G.skeleton(self.symbols, directory, max_depth if directory else None)

    def exports(self, file_path: str, limit: int = PAGE) -> DataFrame:
        rows = self.chunks.filter((F.col("file_path") == file_path) & F.col("is_exported") & (F.col("chunk_type") != "method"))
        rows = rows.select("symbol_name", "chunk_type", "start_line", "chunk_id", first_doc_comment(F.col("content")).alias("doc"), "file_path")
        return G.page(rows, ["file_path"], limit, F.col("start_line"), F.col("chunk_id"))

    def signature(self, symbol: str, file_path: str | None = None, limit: int = PAGE) -> DataFrame:
        rows = self.chunks.filter(F.col("symbol_name") == symbol)
        rows = rows if file_path is None else rows.filter(F.col("file_path") == file_path)
        head = F.regexp_extract("content", rf"(?m)^.*(?<![\w$]){re.escape(symbol.rsplit('.', 1)[-1])}(?![\w$])[^{{;]*", 0)
        out = rows.select("symbol_name", "file_path", "start_line", "is_exported", F.trim(head).alias("signature"), first_doc_comment(F.col("content")).alias("doc"))
        return G.page(out.withColumn("types", pascal_types(F.col("signature"))), ["symbol_name"], limit, F.desc("is_exported"), F.col("file_path"), F.col("start_line"))

    def callers(self, symbol: str, *, transitive: bool = False) -> DataFrame:
        target = G.lookup_names(self.symbols.filter((F.col("name") == symbol) & (F.col("kind") != "export"))).filter("place = 1").select(F.col("symbol_id").alias("node"))
        if transitive:
            calls = self.edges.filter("edge_type = 'POTENTIAL_CALL'").select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
            target = G.closure(calls, target).select("node").unionByName(target).distinct()
        return G.direct_callers(self.edges.join(target.withColumnRenamed("node", "to_id"), "to_id", "left_semi"), self.symbols)

    def dependencies(self, file_path: str) -> DataFrame:
        return self.imports.filter(F.col("file_path") == file_path).select("module", "symbols", "is_external", "resolved_path").orderBy("module")

    def implementors(self, interface: str, limit: int = PAGE) -> DataFrame:
        rows = G.implementors(self.edges, self.symbols).filter(F.col("interface") == interface)
        return G.page(rows, ["interface"], limit, F.col("file_path"), F.col("line"))

    def rename_impact(self, symbol: str) -> DataFrame:
        return G.rename_impact(self.edges, self.symbols, self.tables["re_export_files"], symbol)

    def status(self, disk: DataFrame | None = None) -> DataFrame:
        files = self.tables["files"].filter("deleted_at is null").groupBy("path").agg(F.max("mtime").alias("mtime"))
        return ingest.freshness(files if disk is None else disk, files, files)

    def stale(self, paths: DataFrame, disk: DataFrame) -> DataFrame:
        """(path, stale) of indexed paths: a newer file on disk, or none, is stale."""
        known = self.tables["files"].filter("deleted_at is null").select("path", F.col("mtime").alias("stored"))
        rows = paths.join(known, "path").join(disk.select("path", F.col("mtime").alias("now")), "path", "left")
        return rows.select("path", F.coalesce(F.col("now") > F.col("stored"), F.lit(True)).alias("stale"))

    def efficiency(self, session: str | None = None, since: float | None = None) -> DataFrame:
        calls = telemetry.once(self.tables["metrics"], "call_id", telemetry.METRIC_COLUMNS)
        calls = calls if session is None else calls.filter(F.col("session_id") == session)
        return telemetry.summary(calls if since is None else calls.filter(F.col("call_timestamp") >= since), ["tool_name"])
