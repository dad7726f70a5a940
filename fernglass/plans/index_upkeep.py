"""Index upkeep: what changed, what is stale, and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fernglass.operators import ingest as I
from fernglass.functions.paths import canonical_path
from fernglass.plans.graph_orphans import _sql_path
from fernglass.session import table

BEFORE = "2025-04-15"


def _listing(spark: SparkSession, sf: str, day: str) -> DataFrame:
    """Files as they stood at a day: the row of each path that was valid then."""
    rows = table(spark, sf, "files").filter((F.col("indexed_at") < F.lit(day).cast("timestamp")) & (F.col("deleted_at").isNull() | (F.col("deleted_at") >= F.lit(day).cast("timestamp"))))
    return rows.groupBy("path").agg(F.max("mtime").alias("mtime"))


def manifest_diff(spark: SparkSession, sf: str) -> DataFrame:
    return I.manifest_diff(_listing(spark, sf, BEFORE), _listing(spark, sf, "2030-01-01"))


def freshness_three_way(spark: SparkSession, sf: str) -> DataFrame:
    return I.freshness(_listing(spark, sf, "2030-01-01"), _listing(spark, sf, BEFORE), _listing(spark, sf, "2025-05-01"))


def unchanged_hash_skip(spark: SparkSession, sf: str) -> DataFrame:
    """Files whose chunks' last states equal their earlier ones: compares each chunk's first and latest state."""
    chunks = table(spark, sf, "chunks")
    w = Window.partitionBy("chunk_id")
    rows = chunks.withColumn("newest", F.max("file_mtime").over(w)).withColumn("oldest", F.min("file_mtime").over(w))
    parts = ["chunk_id", "content", "chunk_type", "start_line"]
    return I.unchanged(rows.filter("file_mtime = oldest"), rows.filter("file_mtime = newest"), "file_path", parts)


def monotonic_merge(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "chunks").select("chunk_id", "file_mtime", "start_line", "chunk_type", F.xxhash64("content").alias("arrival"))
    got = I.monotonic_merge(rows.filter("chunk_type <> 'method'"), rows.filter("chunk_type = 'method'"), "chunk_id", "file_mtime", "arrival")
    return got.select("chunk_id", "file_mtime", "start_line", "chunk_type")


def replace_by_file(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols after the files indexed from 2025-05-01 on are written anew: their earlier rows are replaced."""
    rows = table(spark, sf, "symbols").select("symbol_id", "file_path", "line", "indexed_at").distinct()
    cut = F.lit("2025-05-01").cast("timestamp")
    return I.replace_by_key(rows.filter(F.col("indexed_at") < cut), rows.filter(F.col("indexed_at") >= cut), "file_path").select("symbol_id", "file_path", "line", "indexed_at")


def removed_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Imports and edges left after the rows of deleted files are removed, counted per table."""
    gone = table(spark, sf, "files").filter("deleted_at is not null").select(F.col("path").alias("file_path"))
    alive = table(spark, sf, "files").filter("deleted_at is null").select(F.col("path").alias("file_path"))
    gone = gone.join(alive, "file_path", "left_anti")
    imports = I.cascade(table(spark, sf, "imports").select("import_id", "file_path").distinct(), gone, "file_path")
    dead = table(spark, sf, "symbols").join(gone, "file_path", "left_semi").select(F.col("symbol_id").alias("from_id"))
    edges = I.cascade(I.cascade(table(spark, sf, "edges").select("edge_id", "from_id", "to_id").distinct(), dead, "from_id"), dead.select(F.col("from_id").alias("to_id")), "to_id")
    return imports.agg(F.count("*").alias("n_rows")).select(F.lit("imports").alias("table_name"), "n_rows").unionByName(edges.agg(F.count("*").alias("n_rows")).select(F.lit("edges").alias("table_name"), "n_rows"))


def never_written_files(spark: SparkSession, sf: str) -> DataFrame:
    """Paths that imports resolve to and no file row or chunk has ever held."""
    walked = table(spark, sf, "imports").filter("resolved_path is not null").select(canonical_path(F.col("resolved_path")).alias("path"))
    return I.never_written(walked, table(spark, sf, "chunks").select(F.col("file_path").alias("path")).distinct(), table(spark, sf, "files").select("path").distinct())


def index_status(spark: SparkSession, sf: str) -> DataFrame:
    """Per repository: files there, chunks in force by kind, exported symbols."""
    repo = lambda c: F.substring_index(c, "/", 1).alias("repo")
    files = table(spark, sf, "files").filter("deleted_at is null").groupBy(repo("path")).agg(F.countDistinct("path").alias("n_files"))
    chunks = table(spark, sf, "chunks").groupBy(repo("file_path")).agg(F.countDistinct("chunk_id").alias("n_chunks"))
    symbols = table(spark, sf, "symbols").filter("deleted_at is null").groupBy(repo("file_path")).agg(F.countDistinct("symbol_id").alias("n_symbols"), F.countDistinct(F.when(F.col("is_exported"), F.col("symbol_id"))).alias("n_exported"))
    return files.join(chunks, "repo", "full_outer").join(symbols, "repo", "full_outer").na.fill(0)


def miscased_imports(spark: SparkSession, sf: str) -> DataFrame:
    """Resolved paths that match a file only when case is ignored."""
    paths = table(spark, sf, "files").select("path").distinct()
    wanted = table(spark, sf, "imports").filter("resolved_path is not null").select("resolved_path").distinct()
    missing = wanted.join(paths, wanted.resolved_path == paths.path, "left_anti")
    return missing.join(paths.withColumn("low", F.lower("path")), F.lower("resolved_path") == F.col("low")).select("resolved_path", "path")


def chunk_dup_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ordinal of each distinct state within its chunk_id, oldest first."""
    rows = table(spark, sf, "chunks").select("chunk_id", "file_mtime").distinct()
    return rows.withColumn("dup", F.row_number().over(Window.partitionBy("chunk_id").orderBy("file_mtime")) - 1)


def chunk_subwindows(spark: SparkSession, sf: str) -> DataFrame:
    """Fixed windows of 100 lines with 10 lines overlap over every file's lines."""
    rows = table(spark, sf, "files").filter("content is not null").select("file_id", (F.regexp_count("content", F.lit("\n")) + 1).alias("n"))
    starts = F.when(F.col("n") <= 100, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n") - 10), F.lit(90)))
    return rows.select("file_id", "n", F.posexplode(starts).alias("idx", "start")).select("file_id", "idx", "start", F.least(F.col("start") + 99, F.col("n")).alias("end"))


def section_lead(spark: SparkSession, sf: str) -> DataFrame:
    """End of each markdown section: the line before the next doc chunk of the file."""
    rows = table(spark, sf, "chunks").filter("chunk_type = 'doc'").select("file_path", "start_line").distinct()
    return rows.withColumn("section_end", F.lead("start_line").over(Window.partitionBy("file_path").orderBy("start_line")) - 1)


_L = "SELECT path, max(mtime) AS mtime FROM files WHERE indexed_at < TIMESTAMP '{d}' AND (deleted_at IS NULL OR deleted_at >= TIMESTAMP '{d}') GROUP BY path"
_A, _N, _F = _L.format(d=BEFORE), _L.format(d="2030-01-01"), _L.format(d="2025-05-01")

QUERIES = {
    f.__name__: f
    for f in (manifest_diff, freshness_three_way, unchanged_hash_skip, monotonic_merge, replace_by_file, removed_cascade, never_written_files, index_status, miscased_imports, chunk_dup_ids, chunk_subwindows, section_lead)
}
ORACLE = {
    "manifest_diff": f"SELECT * FROM (SELECT path, CASE WHEN a.mtime IS NULL THEN 'added' WHEN n.mtime IS NULL THEN 'deleted' WHEN n.mtime > a.mtime THEN 'stale' END AS state FROM ({_A}) a FULL JOIN ({_N}) n USING (path)) WHERE state IS NOT NULL",
    "freshness_three_way": f"SELECT count(*) FILTER (WHERE d.mtime > coalesce(m.mtime, f.mtime)) AS n_stale, count(*) FILTER (WHERE d.mtime IS NOT NULL AND f.mtime IS NULL) AS n_unindexed, count(*) FILTER (WHERE d.mtime IS NULL) AS n_deleted, count(*) AS n_total FROM ({_N}) d FULL JOIN ({_A}) m USING (path) FULL JOIN ({_F}) f USING (path)",
    "unchanged_hash_skip": """WITH r AS (SELECT DISTINCT chunk_id, file_path, content, chunk_type, start_line, file_mtime = max(file_mtime) OVER (PARTITION BY chunk_id) AS newest, file_mtime = min(file_mtime) OVER (PARTITION BY chunk_id) AS oldest FROM chunks),
  a AS (SELECT file_path, string_agg(md5(concat_ws('|', chunk_id, content, chunk_type, start_line)), '' ORDER BY chunk_id) AS h FROM (SELECT DISTINCT * EXCLUDE (newest, oldest) FROM r WHERE oldest) GROUP BY 1),
  b AS (SELECT file_path, string_agg(md5(concat_ws('|', chunk_id, content, chunk_type, start_line)), '' ORDER BY chunk_id) AS h FROM (SELECT DISTINCT * EXCLUDE (newest, oldest) FROM r WHERE newest) GROUP BY 1) SELECT a.file_path FROM a JOIN b USING (file_path) WHERE a.h = b.h""",
    "monotonic_merge": "SELECT chunk_id, max(file_mtime) AS file_mtime, arg_max(start_line, file_mtime) AS start_line, arg_max(chunk_type, file_mtime) AS chunk_type FROM chunks GROUP BY chunk_id",
    "replace_by_file": "WITH r AS (SELECT DISTINCT symbol_id, file_path, line, indexed_at FROM symbols) SELECT * FROM r WHERE indexed_at >= TIMESTAMP '2025-05-01' OR file_path NOT IN (SELECT file_path FROM r WHERE indexed_at >= TIMESTAMP '2025-05-01')",
    "removed_cascade": """WITH g AS (SELECT path FROM files WHERE deleted_at IS NOT NULL EXCEPT SELECT path FROM files WHERE deleted_at IS NULL), d AS (SELECT symbol_id FROM symbols WHERE file_path IN (SELECT path FROM g))
  SELECT 'imports' AS table_name, count(*) AS n_rows FROM (SELECT DISTINCT import_id, file_path FROM imports) WHERE file_path NOT IN (SELECT path FROM g)
  UNION ALL SELECT 'edges', count(*) FROM (SELECT DISTINCT edge_id, from_id, to_id FROM edges) WHERE from_id NOT IN (SELECT symbol_id FROM d) AND (to_id IS NULL OR to_id NOT IN (SELECT symbol_id FROM d))""",
    "index_status": """SELECT repo, coalesce(n_files, 0) AS n_files, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_symbols, 0) AS n_symbols, coalesce(n_exported, 0) AS n_exported FROM (SELECT split_part(path, '/', 1) AS repo, count(DISTINCT path) AS n_files FROM files WHERE deleted_at IS NULL GROUP BY 1)
  FULL JOIN (SELECT split_part(file_path, '/', 1) AS repo, count(DISTINCT chunk_id) AS n_chunks FROM chunks GROUP BY 1) USING (repo) FULL JOIN (SELECT split_part(file_path, '/', 1) AS repo, count(DISTINCT symbol_id) AS n_symbols, count(DISTINCT symbol_id) FILTER (WHERE is_exported) AS n_exported FROM symbols WHERE deleted_at IS NULL GROUP BY 1) USING (repo)""",
    "never_written_files": f"SELECT DISTINCT {_sql_path('resolved_path')} AS path FROM imports WHERE resolved_path IS NOT NULL AND {_sql_path('resolved_path')} NOT IN (SELECT file_path FROM chunks) AND {_sql_path('resolved_path')} NOT IN (SELECT path FROM files)",
    "miscased_imports": "SELECT i.resolved_path, f.path FROM (SELECT DISTINCT resolved_path FROM imports WHERE resolved_path NOT IN (SELECT path FROM files)) i JOIN (SELECT DISTINCT path FROM files) f ON lower(i.resolved_path) = lower(f.path)",
    "chunk_dup_ids": "SELECT chunk_id, file_mtime, CAST(row_number() OVER (PARTITION BY chunk_id ORDER BY file_mtime) - 1 AS INT) AS dup FROM (SELECT DISTINCT chunk_id, file_mtime FROM chunks)",
    "chunk_subwindows": "WITH f AS (SELECT file_id, length(content) - length(replace(content, chr(10), '')) + 1 AS n FROM files WHERE content IS NOT NULL), s AS (SELECT file_id, n, unnest(CASE WHEN n <= 100 THEN [1] ELSE range(1, n - 9, 90) END) AS start FROM f) SELECT file_id, CAST((start - 1) // 90 AS INT) AS idx, CAST(start AS INT) AS start, CAST(least(start + 99, n) AS INT) AS \"end\" FROM s",
    "section_lead": "SELECT file_path, start_line, lead(start_line) OVER (PARTITION BY file_path ORDER BY start_line) - 1 AS section_end FROM (SELECT DISTINCT file_path, start_line FROM chunks WHERE chunk_type = 'doc')",
}
