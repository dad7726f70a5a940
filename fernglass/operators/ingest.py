"""Incremental ingest: manifest diffs, freshness, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest_diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, state) from two (path, mtime) listings: added, stale (newer mtime) or deleted; unchanged files are left out."""
    a, b = before.select("path", F.col("mtime").alias("old")), now.select("path", F.col("mtime").alias("new"))
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("new") > F.col("old"), "stale")
    return a.join(b, "path", "full_outer").select("path", state.alias("state")).filter("state is not null")


def freshness(disk: DataFrame, manifest: DataFrame, files: DataFrame) -> DataFrame:
    """One row: how many files are stale, not indexed, deleted, and known in all, of three (path, mtime) listings."""
    d, m, f = disk.select("path", F.col("mtime").alias("d")), manifest.select("path", F.col("mtime").alias("m")), files.select("path", F.col("mtime").alias("f"))
    rows = d.join(m, "path", "full_outer").join(f, "path", "full_outer")
    return rows.agg(
        F.count_if(F.col("d") > F.coalesce("m", "f")).alias("n_stale"),
        F.count_if(F.col("d").isNotNull() & F.col("f").isNull()).alias("n_unindexed"),
        F.count_if(F.col("d").isNull()).alias("n_deleted"),
        F.count("*").alias("n_total"),
    )


def never_written(walked: DataFrame, queued: DataFrame, stored: DataFrame) -> DataFrame:
    """Paths found by the walk that are neither queued for indexing nor stored."""
    return walked.select("path").distinct().join(queued.select("path"), "path", "left_anti").join(stored.select("path"), "path", "left_anti")


def content_signature(rows: DataFrame, by: str, parts: list[str]) -> DataFrame:
    """(by, n, signature): an order-independent signature over whole rows of a file, from per-row hashes that add up.

    Sums of hashes combine before the shuffle, so no file's rows are gathered.
    """
    h = lambda seed: F.xxhash64(F.lit(seed), *parts).cast("decimal(38,0)")
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.sum(h(1)).alias("h1"), F.sum(h(2)).alias("h2")).select(by, "n", F.sha2(F.concat_ws(":", "n", "h1", "h2"), 256).alias("signature"))


def unchanged(before: DataFrame, now: DataFrame, by: str, parts: list[str]) -> DataFrame:
    """Keys whose rows are equal as sets on both sides, all parts compared."""
    a = content_signature(before.select(by, *parts).distinct(), by, parts)
    b = content_signature(now.select(by, *parts).distinct(), by, parts)
    return a.join(b.select(by, F.col("signature").alias("other")), by).filter("signature = other").select(by)


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``old`` whose key ``new`` does not write, and all of ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def cascade(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def monotonic_merge(stored: DataFrame, incoming: DataFrame, key: str, at: str, arrival: str) -> DataFrame:
    """Latest row per key: a greater ``at`` wins, equal ones go to the later arrival, older writes are refused."""
    columns = [c for c in stored.columns if c != key]
    both = stored.unionByName(incoming.select(*stored.columns))
    s = F.max(F.struct(F.col(at).alias("order 1"), F.col(arrival).alias("order 2"), *[F.col(c).alias(c) for c in columns])).alias("s")
    return both.groupBy(key).agg(s).select(key, *[F.col(f"s.{c}").alias(c) for c in columns])
