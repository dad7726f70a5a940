import json
from datetime import datetime

import pytest

from fernglass import cli
from fernglass.operators import checker as C
from fernglass.sources.snapshot import read_snapshot, write_snapshot
from fernglass.tools import CodeIndex, as_json

T = datetime(2025, 1, 1)


@pytest.fixture(scope="module")
def index(spark):
    chunks = [
        ("c1", "src/a.ts", 1, 3, "/** Adds. */\nexport function add(a: Num): Num {\n}", "function", "add", None, True, "typescript", 1.0), ("c2", "src/b.ts", 1, 3, "function useAdd() {\n add(1);\n}", "function", "useAdd", None, False, "typescript", 1.0),
        ("c3", "src/b.js", 1, 3, "function add() {}", "function", "add", None, False, "javascript", 1.0), ("c1", "src/a.ts", 1, 3, "old", "function", "add", None, True, "typescript", 0.5),
    ]
    cols = "chunk_id string, file_path string, start_line int, end_line int, content string, chunk_type string, symbol_name string, parent_symbol string, is_exported boolean, language string, file_mtime double"
    sym = [("s1", "add", "function", "src/a.ts", 1, 0, True, T, None), ("s2", "useAdd", "function", "src/b.ts", 1, 0, False, T, None), ("s3", "top", "function", "src/c.ts", 1, 0, True, T, None), ("i", "Shape", "interface", "src/a.ts", 9, 1, True, T, None), ("k", "Box", "class_shell", "src/b.ts", 9, 1, True, T, None), ("m", "Box.area", "method", "src/b.ts", 10, 2, True, T, None)]
    tables = {
        "chunks": spark.createDataFrame(chunks, cols),
        "symbols": spark.createDataFrame(sym, "symbol_id string, name string, kind string, file_path string, line int, ordinal int, is_exported boolean, indexed_at timestamp, deleted_at timestamp"),
        "edges": spark.createDataFrame([(1, "s2", "s1", "POTENTIAL_CALL", "import", 2, "add(1);"), (2, "s3", "s2", "POTENTIAL_CALL", "import", 5, None), (3, "k", "i", "IMPLEMENTS", None, None, None), (4, "s2", "s1", "POTENTIAL_CALL", "import", 9, "again")], "edge_id bigint, from_id string, to_id string, edge_type string, resolution string, call_line int, context string"),
        "imports": spark.createDataFrame([(1, "src/b.ts", 0, "./a", ["add"], False, "src/a.ts")], "import_id bigint, file_path string, ordinal int, module string, symbols array<string>, is_external boolean, resolved_path string"),
        "re_export_files": spark.createDataFrame([("src/index.ts", "src/a.ts"), ("lib.ts", "src/index.ts")], "from_path string, to_path string"),
        "files": spark.createDataFrame([("src/a.ts", 1.0, None), ("src/b.ts", 1.0, None)], "path string, mtime double, deleted_at timestamp"),
        "metrics": spark.createDataFrame([(1, 1.0, "search", 10, 100, 5, "s", "ok")], "call_id bigint, call_timestamp double, tool_name string, tokens_returned bigint, tokens_full_file_upper_bound bigint, duration_ms bigint, session_id string, status string"),
    }
    return CodeIndex(spark, tables)


def test_search_and_scope(index):
    got = index.search("addNumbers add", file_pattern="src/*.ts", only_exported=True).collect()
    assert [r.chunk_id for r in got] == ["c1"]
    assert {r.chunk_id for r in index.search("add", language="javascript").collect()} == {"c3"}
    assert index.search("zz").count() == 0


def test_graph_tools(index):
    assert [(r.caller, r.line) for r in index.callers("add").collect()] == [("useAdd", 2)]
    assert {r.caller for r in index.callers("add", transitive=True).collect()} == {"useAdd", "top"}
    assert [(r["class"], r.methods) for r in index.implementors("Shape").collect()] == [("Box", "area")]
    assert {(r.part, r.file_path) for r in index.rename_impact("add").collect()} == {("declaration", "src/a.ts"), ("caller", "src/b.ts"), ("barrel", "src/index.ts"), ("barrel", "lib.ts")}
    assert [r.symbol_name for r in index.exports("src/a.ts").collect()] == ["add"]
    sig = index.signature("add", "src/a.ts").first()
    assert sig.signature.startswith("export function add(a: Num): Num") and sig.types == ["Num"] and sig.doc == "/** Adds. */"
    assert index.dependencies("src/b.ts").first().resolved_path == "src/a.ts"
    assert {r.file_path for r in index.project_skeleton("src").collect()} == {"src/a.ts", "src/b.ts", "src/c.ts"}
    assert index.efficiency().first().efficiency_ratio == 0.9 and index.status().first().n_stale == 0
    assert '"tool_name":"search"' in as_json(index.efficiency("s")).first().json


def test_stale_flags(spark, index):
    disk = spark.createDataFrame([("src/a.ts", 2.0)], "path string, mtime double")
    paths = spark.createDataFrame([("src/a.ts",), ("src/b.ts",), ("nowhere.ts",)], "path string")
    assert {r.path: r.stale for r in index.stale(paths, disk).collect()} == {"src/a.ts": True, "src/b.ts": True}


def test_verdicts(spark):
    files = spark.createDataFrame([("b.ts", "add(1);\n// add(2)\nconst add = 3;", 1.0)], "path string, content string, mtime double")
    symbols = spark.createDataFrame([("s", "add")], "symbol_id string, name string")
    v = C.classify(C.mentions(files, symbols)).cache()
    assert {r.line: r.verdict for r in v.collect()} == {1: C.CALLS, 2: C.OTHER, 3: C.OTHER}
    new = v.filter("line = 1").selectExpr("symbol_id", "file_path", "line", "'unresolved' as verdict", "2.0D as mtime")
    merged = C.upsert(v, new)
    assert merged.count() == 3 and C.fresh(merged, files).count() == 2


def test_snapshots(spark, tmp_path):
    root = f"file://{tmp_path}/w"
    assert read_snapshot(spark, root) is None
    write_snapshot(spark, root, "v1", {"a": spark.range(3)})
    write_snapshot(spark, root, "v2", {"a": spark.range(5)})
    assert read_snapshot(spark, root)["a"].count() == 5


@pytest.mark.parametrize(
    ("args", "key", "want"),
    [
        (["search", "add", "--files", "src/*.ts", "--exported"], "chunk_id", {"c1"}), (["callers", "add"], "caller", {"useAdd"}), (["callers", "add", "--transitive"], "caller", {"useAdd", "top"}), (["exports", "src/a.ts"], "symbol_name", {"add"}),
        (["signature", "add"], "file_path", {"src/a.ts", "src/b.js"}), (["signature", "$add"], "file_path", set()), (["dependencies", "src/b.ts"], "module", {"./a"}), (["skeleton"], "file_path", {"src/a.ts", "src/b.ts", "src/c.ts"}), (["efficiency"], "tool_name", {"search"}),
    ],
)
def test_command_line(index, args, key, want):
    rows = as_json(cli.answer(index, cli.parser().parse_args(["--tables", "x", *args]))).collect()
    assert {json.loads(r.json)[key] for r in rows} == want


def test_command_line_reads_snapshots(spark, index, tmp_path, capsys):
    write_snapshot(spark, str(tmp_path), "v1", index.tables)
    assert cli.load(spark, str(tmp_path)).dependencies("src/b.ts").count() == 1
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["--tables", str(tmp_path), "nothing"])
