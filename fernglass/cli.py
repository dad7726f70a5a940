"""Command line over a folder of tables or a snapshot: one tool a call, one JSON object a line."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession

from fernglass.session import get_spark, table
from fernglass.sources.snapshot import read_snapshot
from fernglass.tools import CodeIndex, as_json

TABLES = ("files", "chunks", "symbols", "edges", "imports", "re_export_files", "metrics")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="fernglass")
    out.add_argument("--tables", required=True, help="folder of one Parquet table per name, or of snapshots")
    tools = out.add_subparsers(dest="tool", required=True)
    search = tools.add_parser("search", help="ranked chunks")
    search.add_argument("query")
    search.add_argument("--limit", type=int, default=10)
    search.add_argument("--language")
    search.add_argument("--files", help="glob of paths")
    search.add_argument("--exported", action="store_true")
    for name in ("callers", "signature", "implementors", "rename-impact"):
        tools.add_parser(name).add_argument("symbol")
    tools.choices["callers"].add_argument("--transitive", action="store_true")
    for name in ("exports", "dependencies"):
        tools.add_parser(name).add_argument("file")
    skeleton = tools.add_parser("skeleton")
    skeleton.add_argument("--directory", default="")
    skeleton.add_argument("--depth", type=int)
    tools.add_parser("status")
    tools.add_parser("efficiency").add_argument("--session")
    return out


def load(spark: SparkSession, folder: str) -> CodeIndex:
    found = read_snapshot(spark, folder)
    return CodeIndex(spark, found if found is not None else {t: table(spark, folder, t) for t in TABLES})


def answer(index: CodeIndex, a: argparse.Namespace) -> DataFrame:
    if a.tool == "search":
        return index.search(a.query, a.limit, language=a.language, file_pattern=a.files, only_exported=a.exported).orderBy("rank")
    if a.tool == "callers":
        return index.callers(a.symbol, transitive=a.transitive)
    if a.tool == "skeleton":
        return index.project_skeleton(a.directory, a.depth)
    if a.tool == "efficiency":
        return index.efficiency(a.session)
    if a.tool == "status":
        return index.status()
    by_symbol = {"signature": index.signature, "implementors": index.implementors, "rename-impact": index.rename_impact}
    return by_symbol[a.tool](a.symbol) if a.tool in by_symbol else {"exports": index.exports, "dependencies": index.dependencies}[a.tool](a.file)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    index = load(get_spark(os.environ.get("FERNGLASS_CPUS", "*")), a.tables)
    for row in as_json(answer(index, a)).toLocalIterator():
        print(row.json)
    return 0


if __name__ == "__main__":
    sys.exit(main())
