import re

import pytest

from fernglass.llm.grammar import permissible
from fernglass.llm.parsing import invalid_files

VALID = {
    "empty.ts": "", "bom.ts": "﻿import { a } from 'b';\n", "bang.mjs": "#!/usr/bin/env node\n/* c */\nexport const a = 1;\n", "comment.js": "// <<<<<<< kept\n/*\n=======\n*/",
    "types.ts": "import type { A } from './a';\nexport abstract class B<T extends A = A> extends C<T> implements D, E {\n  private readonly x?: Map<string, T[]>;\n  static y = 1;\n  constructor(private z: number, ...rest: string[]) { super(z); }\n  get w(): string { return this.z! as unknown as string; }\n  async *m<U>(u: U): AsyncGenerator<U> { yield* [u]; }\n  [key: string]: any;\n}\ntype F = (a: number, b?: string) => void | null;\ntype G<T> = T extends (infer U)[] ? U : { readonly [K in keyof T]?: T[K] };\nenum H { A = 1, B }\ndeclare module 'x' { export const q: number; }\nfunction is(a: unknown): a is string { return typeof a === 'string'; }\nexport default is;\n",
    "labels.js": "outer: for (let i = 0; i < 3; i += 1) {\n  if (i > 1) continue outer;\n  else break outer;\n}\n",
    "literals.js": "const a = /[{(]+\\/>/g.test(b) ? `x${c ? `y${d}` : ''}z` : '}} not closed {';\nconst o = { 'a-b': 1, [c]: 2, get d() { return 1; }, async *e() {}, ...f, default: 3 };\n",
    "asi.js": "const a = 1\nlet b = a\n++b\nfoo()\nexport { a as default, b }\n", "switch.js": "switch (a.b) {\n  case 'x':\n    f(a);\n    break;\n  case g(1):\n  default:\n    h();\n}\n",
    "ternary.js": "const a = b ? (c) : d;\nconst e = f(a ? g(1) : h, [x ? y : z]);\n", "arrow.js": "export const f = async ({ a, b = 2 }, [c]) => ({ a, b, c });\nf(x => x * 2, (y) => { return y; });\n",
    "chain.js": "p.then((x) => x.y).catch((e) => { throw e; }).finally(() => {});\nconst { a, b: c } = d?.e ?? f[0]?.(1);\n",
    "text.tsx": "export function A({ label }: { label: string }) {\n  const m = new Map<string, number>();\n  return (\n    <section className=\"a-b\">\n      <h2>{label} it's fine, (really)</h2>\n      <B size={4} onX={(e) => f({ e })} {...rest} />\n      <>\n        {xs.map((x) => <li key={x}>{x}</li>)}\n      </>\n    </section>\n  );\n}\n",
    "plain.jsx": "const a = b < c && d > e;\nconst v = <A>text</A>;\n", "conflict.ts": "const a = `\n<<<<<<< ours\n=======\n>>>>>>> theirs\n`;\n", "any.md": "<<<<<<< (", "noext": "((", "cast.ts": "const a = <string>b;\nconst c = <T>(x: T) => x;\n",
}
INVALID = {
    "truncated.ts": "export function a(b: number) {\n  if (b) {\n", "conflict.js": "const a = 1;\n<<<<<<< HEAD\nconst b = 2;\n=======\nconst b = 3;\n>>>>>>> x\n", "half.ts": "const a = 1;\n=======\nconst b = 3;\n", "types.js": "function a(b: string) { return b; }\n",
    "iface.js": "interface A {\n  b: string;\n}\n", "private.mjs": "class A {\n  private b = 1;\n}\n", "returns.js": "function a(b): void {\n}\n", "jsx.ts": "export const a = () => {\n  return <b c=\"d\">e</b>;\n};\n", "jsx.js": "const a = (\n  <b>\n    <c />\n  </b>\n);\n",
    "assign.ts": "const a = ;\n", "typo.js": "funtcion a() {\n}\n", "string.ts": "const a = 'b\nconst c = 1;\n", "template.ts": "const a = `b;\n", "comment.ts": "const a = 1;\n/* never closed\n", "missing.js": "f(a b);\n", "bracket.ts": "f(a, [1);\n", "extra.js": "const a = 1;\n});\n",
    "else.ts": "const f = () => {\n  else g(1);\n};\n", "json.ts": "{\n  \"name\": \"a\",\n  \"v\": [1]\n}\n", "yaml.js": "name: a\nversion: 6.7.3\n", "html.tsx": "<!doctype html>\n<html><body><p>No.</p></body></html>\n", "css.js": ".a-b {\n  margin: 17px auto;\n}\n", "sql.ts": "SELECT a, count(*)\nFROM b\nWHERE c > 3\n",
    "shell.ts": "set -eu\nfor f in a/*.txt; do\n  echo \"$f\"\ndone\n", "python.ts": "import os\n\ndef main(a):\n    return a\n", "junk.ts": "const a = 1;\n\x00\x01\x02\n", "tags.tsx": "const a = (\n  <b>\n    <c>\n  </b>\n);\n", "diff.ts": "@@ -1,2 +1,3 @@\n-a\n+b\n", "implements.js": "class A implements B {\n}\n",
}


#: Statements that a strict parser rejects in scripts and in TypeScript alike, though brackets and neighbours are right.
BROKEN = [
    '1 = a;',
    'a?.b = 1;',
    'const a + b = 3;',
    'const a;',
    'const a.b = 3;',
    'function f(a, 1) {}',
    'function f(a.b) {}',
    'function f(a, g(b)) {}',
    "import a, b from 'x';",
    'for (const a, b of c) {}',
    'class a.b {}',
    'const q = { a.b, c };',
    'try { f(); } catch (a, b) {}',
    'export { a + b };',
    'try {}',
    'if (a) { b(); } else { c(); } else { d(); }',
    'return 5;',
    'break;',
    'function f() { await g(); }',
    'let a = 1;\nlet a = 2;',
    'const a = ;',
    'f(a b);',
    'while (a) { b(); } else { c(); }',
    'f() = 3;',
    "'use' = a;",
    'a + b = c;',
    'const a = 1, b;',
    'class A { m(a, 1) { return a; } }',
    'continue;',
    'function f(a, b.c) { return a; }',
    'try { a(); } finally { b(); } catch (e) {}',
    'let x = 1;\nfoo();\nconst x = 2;',
]
BROKEN_SCRIPT = ["x = { 1 };", "const a, b = 1;", "x = { 'a' };"]
BROKEN_TYPED = ["interface A, B {}"]
#: And statements that it accepts.
SOUND = [
    'x = a >> b;',
    'x = a >>> 2;',
    'x = a << 2;',
    'x = a>>b;',
    'x = 1<<4;',
    'x >>= 2; y <<= 1; z >>>= 3;',
    'q = { case: 5 };',
    'q = { while: 5, break: 2 };',
    "a =              /x'y/;",
    "function f() { return      /x'y/.test(a); }",
    'for (const a of b) { c(a); }',
    'for (const [a, b] of c) {}',
    'let a;\nlet b;',
    '{ let a = 1; f(a); }\n{ let a = 2; f(a); }',
    'for (let i = 0; i < 3; i++) {}\nfor (let i = 0; i < 3; i++) {}',
    "class A { 1 = 2; 'b' = 3; }",
    'async function f() { await g(); }',
    'await g();',
    'const { a, b } = c;',
    'class A extends mixin(B, 1) { m(a, b) { return a; } }',
    'try { f(); } catch { g(); }',
    'try { f(); } finally { g(); }',
    'if (a) { b(); } else if (c) { d(); } else { e(); }',
    'if (a) b(); else c();',
    'switch (a) { case 1: break; default: f(); }',
    'a.b = 1; a[0] = 2; (a) = 3; [a, b] = [b, a]; ({ a } = c);',
    'export { a, b as c };',
    "import a, { b } from 'x';",
    "import a, * as b from 'x';",
    'label: for (const x of y) { continue label; }',
    'const f = (a, b) => { a.b, c; };',
    'switch (x) { case f(1): { a.b(); } }',
    'x = { a, b, c: 1, ...d, f() { return 1; }, get g() { return 2; } };',
    'var a = 1; var a = 2;',
    'const a = 1, b = 2;',
    'function f(a, b = 2, ...c) { return a; }',
    'if (a) { const z = 1; f(z); } else { const z = 2; f(z); }',
    'const f = async () => { await g(); };',
    'const o = { async m() { await g(); } };',
    'function* g() { yield 1; }',
    'const a = f(1, b);',
    'while (a) { if (b) { break; } else { continue; } }',
    'foo(a, 1);\n{ b(); }',
    'x = y ? { a } : { b };',
    'const x = a ? b : c;',
    'const t = `a ${b} c`;',
    'a ??= b; a ||= c; a &&= d;',
    'export default function (a, b) { return a; }',
    'export const { a, b } = c;',
    'do { f(); } while (a);',
    'const r = a / b / c;',
    'x = y\n++z',
    'x = -1 ** 0 ? 2 : 3;',
]
SOUND_TYPED = [
    'class A { accessor d = 1; }',
    'const a: Array<Array<number>> = [];',
    'const m = new Map<string, Map<string, number>>();',
    'declare const a: number;',
    'declare const b;',
    'x = a >> b;',
    'x = a >>> 2;',
    'x = a << 2;',
    'interface A extends B, C {}',
    'const f: (a: number) => void = g;',
    'enum E { A = 1, B = 2 }',
    'const enum F { A = 1 }',
    'function f(a: number): void;\nfunction f(a: string): void;\nfunction f(a: any) {}',
    'namespace N { const a = 1; }\nnamespace N { const a = 2; }',
    'abstract class A { abstract m(a: number): void; }',
    'type X = { a: number; b?: string };',
    'let v: 1 | 2 = 1;',
    'const a: 5 = 5;',
    'function f(this: A, b: number) { return b; }',
    'class A { constructor(private a: B, public c: D) {} }',
    'class A { m(a, b) { return a; } m2(a: X, b: Y): Z { return a; } }',
    'let a!: number;',
    "export type { A, B } from './x';",
    "import type { A } from './x';",
    'const f = <T,>(a: T) => a;',
    'for (const a of b as C[]) {}',
]
SOUND_MARKUP = ["const a = <div>" + " " * 60 + "text { b }" + " " * 60 + " more text</div>;", "const a = <A b={c}>\n{d}" + "\n" * 45 + "words here</A>;"]


def judged(spark, cases):
    rows = [(i, f"r/f{i}.{ext}", text + "\n") for i, (ext, text) in enumerate(cases)]
    bad = {r.file_id for r in invalid_files(spark.createDataFrame(rows, "file_id bigint, path string, content string")).collect()}
    return [(cases[i], i in bad) for i in range(len(cases))]


def test_statements_follow_their_productions(spark):
    broken = [(e, t) for e in ("js", "ts") for t in BROKEN] + [("js", t) for t in BROKEN_SCRIPT] + [("ts", t) for t in BROKEN_TYPED]
    sound = [(e, t) for e in ("js", "ts", "jsx", "tsx") for t in SOUND] + [("ts", t) for t in SOUND_TYPED] + [(e, t) for e in ("jsx", "tsx") for t in SOUND_MARKUP]
    got = judged(spark, broken + sound)
    assert [case for case, bad in got[: len(broken)] if not bad] == []
    assert [case for case, bad in got[len(broken) :] if bad] == []


def test_blanks_of_any_length_before_an_expression_and_text(spark):
    cases = [(e, f"{head}{' ' * n}/x'y/.test(a);{tail}") for e in ("js", "ts") for head, tail in (("b = ", ""), ("function f() { return ", " }"), ("f(", "")) for n in (0, 1, 14, 300)]
    cases = [(e, t.replace("f( ", "f( ").replace(".test(a);", ".test(a));") if t.startswith("f(") else t) for e, t in cases]
    assert [case for case, bad in judged(spark, cases) if bad] == []


def test_merged_tokens_do_not_hide_what_single_ones_show(spark):
    """Operands are lexed as one token where they stand in a list or call; with a comment between them they are not."""
    cases = [(e, t) for e in ("js", "ts") for t in ("f(a, b c);", "x = a + ;", "x = [a, b;", "f(a,, b);", "x = a b;", "f(a, (b);", "x = a + b c;", "y = f(a)(b c);")]
    apart = [(e, re.sub(r"(?<=[\w)]) ", "/**/ ", t)) for e, t in cases]
    whole = [(e, t) for e in ("js", "ts") for t in ("f(a, b);", "x = a + b;", "x = [a, b];", "f(a)(b);")]
    split = [(e, t.replace(", ", "/**/, ").replace(" +", "/**/ +")) for e, t in whole]
    got = judged(spark, cases + apart + whole + split)
    n = len(cases + apart)
    assert [c for c, bad in got[:n] if not bad] == [] and [c for c, bad in got[n:] if bad] == []


def test_valid_and_invalid_files(spark):
    rows = [(i, f"r/{n}", t) for i, (n, t) in enumerate(VALID.items())] + [(1000 + i, f"r/{n}", t) for i, (n, t) in enumerate(INVALID.items())]
    rows += [(5000, "r/null.ts", None), (5001, None, "const a ="), (5002, "r/long.ts", "f(a, { b: [1, 2] });\n" * 20_000)]
    df = spark.createDataFrame(rows, "file_id bigint, path string, content string").selectExpr("*", "'clash' as lang", "1 as pos").repartition("file_id")
    got = {r.file_id for r in invalid_files(df).collect()}
    names = {r[0]: r[1] for r in rows}
    want = set(range(1000, 1000 + len(INVALID)))
    assert {names[i] for i in want - got} == set() and {names[i] for i in got - want} == set()
    assert invalid_files(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("language", "pair", "allowed"),
    [("js", ("=", ";"), False), ("js", ("ID", "ID"), False), ("ts", ("ID", "ID"), False), ("js", ("return", "ID"), True), ("ts", ("interface", "ID"), True), ("js", ("export", "interface"), False), ("jsx", ("return", "JTAG"), True), ("ts", ("return", "JTAG"), False)],
)
def test_pairs_follow_the_grammar(language, pair, allowed):
    assert ((*pair, False) in permissible(language)) is allowed
