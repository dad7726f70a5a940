from fernglass.operators.graph import link_edges
from fernglass.sources.extract import extract_chunks, extract_edges, extract_imports, resolve_imports
from fernglass.sources.scanner import scan_calls, scan_markdown, scan_script, scan_structure

CODE = """import { base, type Kind } from './base.js';
import def, * as all from 'lib';
export * from './more';
export { one as two } from './more';

/** Doc. */
export function add(a: number, b: number): number {
  return base(a) + helper({ b: '}' });
}

export const twice = (x: number): number => add(x, x);
const helper = async (o) => {
  return o;
};

export interface Shape {
  area(): number;
}

export type Id = string | { a: 1 };

export class Box<T> implements Shape {
  private size = 1;

  constructor(private kind: Kind) {}

  /** Area. */
  area(): number {
    return this.scale(this.kind.value());
  }

  private scale(n: number): number {
    const other = new Box(n);
    other.area();
    return n;
  }
}
"""


def test_declarations():
    got = [(d.kind, d.name, d.exported) for d in scan_script(CODE).declarations]
    assert got == [
        ("function", "add", True), ("function", "twice", True), ("function", "helper", False), ("interface", "Shape", True), ("type", "Id", True), ("class_shell", "Box", True),
        ("method", "Box.constructor", True), ("method", "Box.area", True), ("method", "Box.scale", False),
    ]
    d = {x.name: x for x in scan_script(CODE).declarations}
    lines = CODE.split("\n")
    assert lines[d["add"].start - 1].startswith("export function add") and lines[d["add"].end - 1] == "}"
    assert lines[d["Box"].end - 1] == "}" and "private scale" in lines[d["Box.scale"].start - 1]


def test_imports_and_calls():
    s = scan_script(CODE)
    assert s.imports == [("./base.js", ["base", "Kind"]), ("lib", ["def", "all"])]
    assert s.re_exports == [("./more", None), ("./more", ["two"])]
    calls = {(a, b, e) for a, b, e, _ in scan_calls(CODE)}
    assert {("add", "base", "import"), ("add", "helper", "same_file"), ("twice", "add", "same_file"), ("Box.area", "Box.scale", "this_method"), ("Box.scale", "Box.area", "new_expression")} <= calls


def test_markdown():
    text = "# Title\nintro\n\n## One\ntext\n### Deep\n```\n# no\n```\n## Two\nend\n\n"
    assert scan_markdown(text) == [(1, 3, "Title"), (4, 9, "Title > One"), (10, 11, "Title > Two")]
    assert scan_markdown("# T\n\n## A\nx") == [(3, 4, "T > A")] and scan_markdown("plain\ntext") == [(1, 2, None)] and scan_markdown("") == []


def test_tables(spark):
    files = spark.createDataFrame([("src/a.ts", CODE), ("src/base.ts", "export const base = 1;\n"), ("src/more/index.ts", ""), ("doc.md", "# A\nx"), ("x.txt", "a"), ("n.ts", None), (None, "a")], "path string, content string")
    chunks = extract_chunks(files).collect()
    assert {r.file_path for r in chunks} == {"src/a.ts", "src/base.ts", "doc.md"} and len({r.chunk_id for r in chunks}) == len(chunks)
    got = {r.module: (r.resolved_path, r.is_external) for r in resolve_imports(extract_imports(files), files.select("path")).collect()}
    assert got["./base.js"] == ("src/base.ts", False) and got["lib"] == (None, True) and got["./more"] == ("src/more/index.ts", False)


SHAPES = """import { Pump } from './pump';
export { run as start, type Flow } from './flow';
export class Tank<T extends Wide = Wide> extends Vessel<T> implements Leaky, Round<T> {
  private pump: Pump;
  readonly size: Size = new Size();

  constructor(private valve: Valve, plain: Plain) {
    super(plain);
  }

  drain(hose: Hose): void {
    this.pump.stop();
    this.valve.open();
    this.plain.never();
    super.drain(hose);
    hose.lay();
    this.a.b.c();
    other.thing();
    this.fill();
    make().chained();
  }

  fill() {}
}
export interface Leaky extends Broken {}
"""


def test_receivers_of_every_kind():
    calls = {(b, rule) for a, b, rule, _ in scan_calls(SHAPES) if a == "Tank.drain"}
    assert calls == {("Pump.stop", "field_type"), ("Valve.open", "field_type"), ("Vessel.drain", "super_method"), ("Hose.lay", "parameter_type"), ("Tank.fill", "this_method")}


def test_structure():
    assert [x[:3] for x in scan_structure(SHAPES)] == [
        ("Tank", "Vessel", "EXTENDS"), ("Tank", "Leaky", "IMPLEMENTS"), ("Tank", "Round", "IMPLEMENTS"), ("Leaky", "Broken", "EXTENDS"), ("start", "run", "RE_EXPORTS"), ("Flow", "Flow", "RE_EXPORTS"),
    ]


def test_extracted_edges_are_linked(spark):
    files = spark.createDataFrame([("tank.ts", SHAPES), ("pump.ts", "export class Pump {\n  stop() {}\n}\n"), ("flow.ts", "export function run() {}\n"), ("vessel.ts", "export class Vessel {\n  drain() {}\n}\n"), ("n.ts", None)], "path string, content string")
    symbols = [("Tank", "class_shell", "tank.ts", 3), ("Tank.drain", "method", "tank.ts", 11), ("Tank.fill", "method", "tank.ts", 23), ("Leaky", "interface", "tank.ts", 25), ("start", "export", "tank.ts", 2)]
    symbols += [("Pump", "class_shell", "pump.ts", 1), ("Pump.stop", "method", "pump.ts", 2), ("run", "function", "flow.ts", 1), ("Vessel", "class_shell", "vessel.ts", 1), ("Vessel.drain", "method", "vessel.ts", 2)]
    sdf = spark.createDataFrame([(f"{p}#{n}", n, k, p, i, 0, True) for n, k, p, i in symbols], "symbol_id string, name string, kind string, file_path string, line int, ordinal int, is_exported boolean")
    imports = resolve_imports(extract_imports(files), files.select("path"))
    got = {(r.from_id, r.to_id, r.edge_type, r.resolution) for r in link_edges(extract_edges(files), sdf, imports).collect()}
    assert got == {
        ("tank.ts#Tank", "vessel.ts#Vessel", "EXTENDS", None), ("tank.ts#Tank", "tank.ts#Leaky", "IMPLEMENTS", None), ("tank.ts#start", "flow.ts#run", "RE_EXPORTS", None),
        ("tank.ts#Tank.drain", "pump.ts#Pump.stop", "POTENTIAL_CALL", "field_type"), ("tank.ts#Tank.drain", "tank.ts#Tank.fill", "POTENTIAL_CALL", "this_method"),
    }
