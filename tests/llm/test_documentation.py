import os

import pytest
from pyspark.sql import functions as F

from fernglass.llm.documentation import is_telling, pair_functions
from fernglass.llm.q_documentation import p2_found
from tests.compare import DATA

TELLING = [
    ("/** Oldest pillar wins. */", "countRows"),
    ("// Milliseconds, not ticks.", "wait"),
    ("/**\n * @returns null once the shelf is empty, else the oldest box\n */", "takeBox"),
    ("/**\n * Renvoie la première valeur encore valable de parseLock.\n */", "parseLock"),
    ("/** 返回最近一次写入的记录 */", "lastRow"),
    ("/**\n * Opens the gate.\n * Callers must hold the lock, otherwise rows may be lost.\n * @example\n * openGate(x);\n */", "openGate"),
    ("/**\n * @param box the freshest box to start from\n */", "take"),
]
TRIVIAL = [
    ("/** */", "f"), ("//", "f"), ("// ----------", "f"), ("/** The openGate function. */", "openGate"), ("// openGate", "openGate"), ("/**\n * This is the openGate function.\n * It opens the gate.\n */", "openGate"),
    ("/** Evicts the badge lanterns. */", "Store.evictBadgeLantern"), ("/**\n * @param a\n * @param {string} b\n * @returns {Promise<void>}\n * @since 2.1.0\n */", "f"), ("// TODO: describe this", "f"), ("/** FIXME document me later */", "f"), ("/** tbd */", "f"),
    ("/** Auto-generated stub. */", "f"), ("/** Generated, do not edit. */", "f"), ("// eslint-disable-next-line complexity", "f"), ("// @ts-expect-error wrong typings upstream", "f"), ("/* istanbul ignore next */", "f"), ("// prettier-ignore", "f"),
    ("/*\n * Copyright 2025 the makers.\n * Licensed under the terms in the LICENSE file.\n */", "f"), ("// const a = b(c);\n// return a;", "f"), ("/** @internal */", "f"), ("/** @deprecated */", "f"),
]


def test_triviality(spark):
    rows = [(c, n, True) for c, n in TELLING] + [(c, n, False) for c, n in TRIVIAL] + [("/** Keeps the oldest row. */", None, True)]
    got = spark.createDataFrame(rows, "c string, n string, want boolean").withColumn("got", is_telling(F.col("c"), F.col("n"))).filter("got <> want").collect()
    assert got == []


CASES = {
    "block": ("const a = 1;\n\n/**\n * Keeps the oldest row of each shard.\n */\nexport function f(x) {\n  return { a: '}' };\n}\n\nother();", 5, True),
    "lines": ("// Keeps the oldest row.\n// Never throws, even late.\nfunction f() {\n}", 2, True),
    "gap": ("// Keeps the oldest row.\n\nfunction f() {\n}", 2, False),
    "trailing": ("a(); // Keeps the oldest row.\nfunction f() {\n}", 1, False),
    "string": ("const s = '// Keeps the oldest row.';\nfunction f() {\n}", 1, False),
    "inside": ("function f() {\n  // Keeps the oldest row.\n}", 0, False),
    "decorated": ("  /** Keeps the oldest row. */\n  @once()\n  f() {\n  }", 1, True),
    "template": ("`;\n\n/** Keeps the oldest row. */\nfunction f() {\n  return `a${1}b`;\n}", 3, True),
    "crlf": ("// Keeps the oldest row.\r\nfunction f() {\r\n}", 1, True),
    "other comment": ("/** Keeps the oldest row. */\n// eslint-disable-next-line\nfunction f() {\n}", 2, False),
    "empty": ("", 0, False),
    "long": ("// Keeps the oldest row.\nfunction f() {\n" + "  call({ a: [1, 2] });\n" * 5000 + "}", 1, True),
}


def test_pairs(spark):
    rows = [(k, t, "Box.f", d) for k, (t, d, _) in CASES.items()] + [("null text", None, "f", 0), (None, CASES["lines"][0], "f", 2), ("null line", "// x\nf() {}", None, None)]
    df = spark.createDataFrame(rows, "id string, text string, name string, declaration int").withColumn("pos", F.lit("clash")).withColumn("tok", F.lit("clash"))
    got = {r.id: r for r in pair_functions(df.filter("id is not null")).collect()}
    assert set(got) == {k for k, v in CASES.items() if v[2]}
    assert got["block"].code == "export function f(x) {\n  return { a: '}' };\n}" and got["block"].description == "Keeps the oldest row of each shard."
    assert got["decorated"].code.strip().startswith("@once()") and got["decorated"].code.endswith("}")
    assert got["long"].code.endswith("}") and len(got["long"].code) > 100_000
    ids = {r.id for r in pair_functions(df.filter("id is not null"), code=False).collect()}
    assert ids == set(got)


@pytest.mark.parametrize("code", [True, False])
def test_empty(spark, code):
    df = spark.createDataFrame([], "id string, text string, name string, declaration int")
    assert pair_functions(df, code=code).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_chunks_without_a_time_are_kept(spark, tmp_path):
    chunks = spark.read.parquet(f"{DATA}/chunks.parquet").dropDuplicates(["chunk_id"])
    chunks.write.parquet(f"{tmp_path}/timed/chunks.parquet")
    spark.read.parquet(f"{tmp_path}/timed/chunks.parquet").withColumn("file_mtime", F.lit(None).cast("double")).write.parquet(f"{tmp_path}/null/chunks.parquet")
    want = {r.chunk_id for r in p2_found(spark, f"{tmp_path}/timed").collect()}
    assert want and {r.chunk_id for r in p2_found(spark, f"{tmp_path}/null").collect()} == want


def test_code_ends_with_the_function_whatever_stands_in_it(spark):
    doc = "/** Splits the quoted part off the given line. */\n"
    bodies = [
        "function cut({ a = { b: 1 } }, c) {\n  const x = { d: [1, { e: 2 }] };\n  return x;\n}",
        "function cut(a) {\n  return" + " " * 300 + "/[\"'{(]/.test(a) ? '}' : `}${{ a }.a}`;\n}",
        "function cut(a) {\n  b = a.replace(/'/g, \"\\\"{\");\n  // } not here\n  /* nor } here */\n  return [/[/{]/, (a) => { return { a }; }];\n}",
        "function cut(a) { return (b) => ({ a, b }); }",
    ]
    tail = "\n\nfunction other() {\n  return '}';\n}\n"
    rows = [(f"f{i}", doc + b + tail, "cut", 1) for i, b in enumerate(bodies)] + [("cut off", doc + "function cut(a) {\n  return {", "cut", 1)]
    got = {r.id: r.code for r in pair_functions(spark.createDataFrame(rows, "id string, text string, name string, declaration int")).collect()}
    assert got == {f"f{i}": b for i, b in enumerate(bodies)} | {"cut off": "function cut(a) {\n  return {"}
