"""Extraction of chunks, imports and calls from source files, Arrow batch by Arrow batch."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernglass.sources.scanner import CONTEXT_LINES, scan_calls, scan_markdown, scan_script, scan_structure

SCRIPTS, MARKDOWN = ("ts", "tsx", "mts", "js", "jsx", "mjs"), ("md",)
CHUNKS = "chunk_id string, file_path string, start_line int, end_line int, content string, chunk_type string, symbol_name string, parent_symbol string, is_exported boolean, ordinal int"
IMPORTS = "file_path string, ordinal int, module string, symbols array<string>, re_export boolean"
CALLS = "file_path string, ordinal int, from_name string, to_name string, resolution string, call_line int"
EDGES = "file_path string, ordinal int, from_name string, to_name string, edge_type string, resolution string, call_line int"


def walk(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, mtime) of every text file under a folder."""
    rows = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"), (F.unix_micros("_metadata.file_modification_time") / 1e6).alias("mtime"))


def _table(batches: Iterator[pd.DataFrame], schema: str, one) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in schema.split(", ")]
    for pdf in batches:
        rows = []
        for path, content in zip(pdf.path, pdf.content, strict=True):
            if path is not None and content:
                rows += one(path, content)
        yield pd.DataFrame(rows, columns=names)


def _extension(path: str) -> str:
    return path.rsplit(".", 1)[-1].lower()


def _chunks_of(path: str, content: str) -> list[tuple]:
    lines = content.lstrip("﻿").replace("\r\n", "\n").split("\n")
    cid = lambda line: hashlib.sha256(f"{path}:{line}".encode()).hexdigest()
    around = lambda a, b: "\n".join(lines[max(0, a - 1 - CONTEXT_LINES) : b + CONTEXT_LINES])
    if _extension(path) in MARKDOWN:
        return [(cid(a), path, a, b, "\n".join(lines[a - 1 : b]), "doc", p, None, False, i) for i, (a, b, p) in enumerate(scan_markdown(content))]
    if _extension(path) not in SCRIPTS:
        return []
    return [(cid(d.start), path, d.start, d.end, around(d.start, d.end), d.kind, d.name, d.parent, d.exported, i) for i, d in enumerate(scan_script(content).declarations)]


def _imports_of(path: str, content: str) -> list[tuple]:
    if _extension(path) not in SCRIPTS:
        return []
    s = scan_script(content)
    rows = [(path, i, m, names, False) for i, (m, names) in enumerate(s.imports)]
    return rows + [(path, len(rows) + i, m, names or [], True) for i, (m, names) in enumerate(s.re_exports)]


def _calls_of(path: str, content: str) -> list[tuple]:
    return [(path, i, *c) for i, c in enumerate(scan_calls(content))] if _extension(path) in SCRIPTS else []


def _edges_of(path: str, content: str) -> list[tuple]:
    """Calls and structural edges of one file, from one scan."""
    if _extension(path) not in SCRIPTS:
        return []
    s = scan_script(content)
    calls = [(a, b, "POTENTIAL_CALL", rule, line) for a, b, rule, line in scan_calls(content, s)]
    rows = calls + [(a, b, kind, None, line) for a, b, kind, line in scan_structure(content, s)]
    return [(path, i, *r) for i, r in enumerate(rows)]


def extract_chunks(files: DataFrame) -> DataFrame:
    """Declaration chunks of (path, content) rows. Null contents and unknown extensions give none."""
    return files.select("path", "content").mapInPandas(lambda b: _table(b, CHUNKS, _chunks_of), CHUNKS)


def extract_imports(files: DataFrame) -> DataFrame:
    return files.select("path", "content").mapInPandas(lambda b: _table(b, IMPORTS, _imports_of), IMPORTS)


def extract_calls(files: DataFrame) -> DataFrame:
    return files.select("path", "content").mapInPandas(lambda b: _table(b, CALLS, _calls_of), CALLS)


def extract_edges(files: DataFrame) -> DataFrame:
    """Calls, base classes, implemented interfaces and named re-exports by name, in the order of each file."""
    return files.select("path", "content").mapInPandas(lambda b: _table(b, EDGES, _edges_of), EDGES)


def resolve_imports(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """Relative modules to files: candidates in order of preference joined to the known paths, not probed on disk."""
    base = F.regexp_replace("file_path", r"/?[^/]*$", "")
    from fernglass.functions.paths import canonical_path

    joined = canonical_path(F.concat_ws("/", base, "module"))
    bare = F.regexp_replace(joined, r"\.(js|jsx|mjs|ts|tsx|mts)$", "")
    tails = [".ts", ".tsx", ".mts", ".js", ".jsx", ".mjs", "/index.ts", "/index.tsx", "/index.js"]
    options = F.posexplode(F.array(*[F.concat(bare, F.lit(t)) for t in tails])).alias("preference", "candidate")
    rel = imports.filter(F.col("module").startswith(".")).select("file_path", "ordinal", options)
    found = rel.join(paths.select(F.col("path").alias("candidate")).distinct(), "candidate").groupBy("file_path", "ordinal").agg(F.min_by("candidate", "preference").alias("resolved_path"))
    return imports.join(found, ["file_path", "ordinal"], "left").withColumn("is_external", ~F.col("module").startswith("."))
