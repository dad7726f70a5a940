"""Problem 1: orphan references of the code index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernglass.functions.paths import canonical_path
from fernglass.operators.orphans import Parent, Reference, orphan_report, orphan_rows
from fernglass.session import table


def _index(spark: SparkSession, sf: str) -> tuple[list[Reference], list[Parent]]:
    col = F.col
    refs = [
        Reference("imports", table(spark, sf, "imports"), col("import_id"), canonical_path(col("resolved_path")), col("indexed_at"), "paths"),
        Reference("edges", table(spark, sf, "edges"), col("edge_id"), col("to_id"), col("indexed_at"), "symbols"),
        Reference("re_export_files", table(spark, sf, "re_export_files"), col("re_export_id"), col("to_file_id"), col("indexed_at"), "files"),
    ]
    files = table(spark, sf, "files")
    parents = [
        Parent("paths", files, canonical_path(col("path")), col("indexed_at"), col("deleted_at")),
        Parent("symbols", table(spark, sf, "symbols"), col("symbol_id"), col("indexed_at"), col("deleted_at")),
        Parent("files", files, col("file_id"), col("indexed_at"), col("deleted_at")),
    ]
    return refs, parents


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_rows(*_index(spark, sf))


def p1_orphans_by_day(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_report(*_index(spark, sf))


_DOTS = r"regexp_replace({0}, '(^|/)[^/]+/\.\.(/|$)', '\1')"


def _sql_path(c: str) -> str:
    flat = rf"regexp_replace(regexp_replace(replace({c}, '\', '/'), '/+', '/', 'g'), '(^|/)(\./)+', '\1', 'g')"
    for _ in range(4):
        flat = _DOTS.format(flat)
    return f"ltrim({flat}, '/')"


_REFS = f"""WITH refs AS (
  SELECT DISTINCT 'imports' AS table_name, import_id AS row_id, {_sql_path('resolved_path')} AS k, indexed_at AS ts FROM imports WHERE resolved_path <> ''
  UNION ALL SELECT DISTINCT 'edges', edge_id, to_id, indexed_at FROM edges WHERE to_id <> ''
  UNION ALL SELECT DISTINCT 're_export_files', re_export_id, CAST(to_file_id AS VARCHAR), indexed_at FROM re_export_files WHERE to_file_id IS NOT NULL
), targets AS (
  SELECT 'imports' AS table_name, {_sql_path('path')} AS k, indexed_at AS s, coalesce(deleted_at, TIMESTAMP '9999-12-31') AS e FROM files
  UNION ALL SELECT 'edges', symbol_id, indexed_at, coalesce(deleted_at, TIMESTAMP '9999-12-31') FROM symbols
  UNION ALL SELECT 're_export_files', CAST(file_id AS VARCHAR), indexed_at, coalesce(deleted_at, TIMESTAMP '9999-12-31') FROM files
), judged AS (
  SELECT r.table_name, r.row_id, r.ts, bool_or(coalesce(t.s <= r.ts AND t.e > r.ts, false)) AS ok, bool_or(t.k IS NOT NULL) AS known, bool_or(coalesce(t.s <= r.ts, false)) AS begun
  FROM refs r LEFT JOIN targets t ON r.table_name = t.table_name AND r.k = t.k GROUP BY ALL
)"""

QUERIES = {"p1_found": p1_found, "p1_orphans_by_day": p1_orphans_by_day}
ORACLE = {
    "p1_found": _REFS + " SELECT table_name, row_id FROM judged WHERE NOT ok",
    "p1_orphans_by_day": _REFS
    + """ SELECT table_name, CAST(ts AS DATE) AS day, count(*) AS n_references, count(*) FILTER (WHERE NOT ok AND NOT known) AS n_missing,
  count(*) FILTER (WHERE NOT ok AND known AND begun) AS n_deleted, count(*) FILTER (WHERE NOT ok AND known AND NOT begun) AS n_later,
  count(*) FILTER (WHERE NOT ok) AS n_orphans FROM judged GROUP BY 1, 2""",
}
