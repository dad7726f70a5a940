"""Verdicts on possible call sites: candidates per project, an injected classifier, upserts, freshness.

The classifier is any function (path, content, line, name) -> verdict. The
default is syntactic: it tells call-shaped mentions from others.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CALLS, OTHER, UNRESOLVED = "resolves_to_queried", "non_call_site", "unresolved"
SCHEMA = "symbol_id string, file_path string, line int, verdict string, mtime double"


def call_shaped(path: str, content: str, line: int, name: str) -> str:
    lines = content.split("\n")
    if not 1 <= line <= len(lines):
        return UNRESOLVED
    text = re.sub(r"//.*$|'[^']*'|\"[^\"]*\"", " ", lines[line - 1])
    bare = re.escape(name.rsplit(".", 1)[-1])
    return CALLS if re.search(rf"(?<!function )\b{bare}\s*(?:<[^>]*>)?\(", text) else OTHER


def mentions(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol_id, name, file_path, content, mtime, line) of every line that mentions a symbol's bare name."""
    lines = files.select(F.col("path").alias("file_path"), "mtime", F.posexplode(F.split("content", "\n")).alias("at", "text"))
    words = lines.select("file_path", "mtime", (F.col("at") + 1).alias("line"), "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b[A-Za-z_$][\w$]*\b"), F.lit(0)))).alias("bare"))
    wanted = symbols.select("symbol_id", "name", F.substring_index("name", ".", -1).alias("bare"))
    return words.join(wanted, "bare").select("symbol_id", "name", "file_path", "mtime", "line", "text")


def classify(candidates: DataFrame, classifier: Callable[[str, str, int, str], str] = call_shaped) -> DataFrame:
    """Verdict of each candidate line (symbol_id, name, file_path, mtime, line, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            verdicts = [classifier(p, t, 1, n) for p, t, n in zip(pdf.file_path, pdf.text, pdf.name, strict=True)]
            yield pd.DataFrame({"symbol_id": pdf.symbol_id, "file_path": pdf.file_path, "line": pdf.line, "verdict": verdicts, "mtime": pdf.mtime})

    return candidates.select("symbol_id", "name", "file_path", "mtime", "line", "text").mapInPandas(run, SCHEMA)


def bucket_projects(candidates: DataFrame, projects: DataFrame) -> DataFrame:
    """(project, n) of candidates by the first project that owns their file; null for files outside all."""
    first = projects.groupBy("file_path").agg(F.min("project").alias("project"))
    return candidates.join(first, "file_path", "left").groupBy("project").agg(F.count("*").alias("n_candidates"))


def upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Overwrite by (symbol_id, file_path, line)."""
    key = ["symbol_id", "file_path", "line"]
    return stored.join(new.select(*key), key, "left_anti").unionByName(new)


def fresh(verdicts: DataFrame, files: DataFrame) -> DataFrame:
    """Verdicts whose file has not changed since: equal path and mtime."""
    return verdicts.join(files.select(F.col("path").alias("file_path"), "mtime"), ["file_path", "mtime"], "left_semi")
