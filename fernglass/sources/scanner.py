"""Declaration scanner of TypeScript, JavaScript and markdown files; plain Python, one file at a time."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

IDENT = r"[A-Za-z_$][\w$]*"
_MASK = re.compile(
    r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|'[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*'?|\"[^\"\\\n]*(?:\\[\s\S][^\"\\\n]*)*\"?|`[^`\\]*(?:\\[\s\S][^`\\]*)*`?"
    r"|(?<=[=(,:;!&|?{\[\n])[ \t]*/(?![*/])[^/\\\[\n]*(?:(?:\\[^\n]|\[[^\]\\\n]*(?:\\[^\n][^\]\\\n]*)*\])[^/\\\[\n]*)*/[a-z]*"
)
_HEAD = re.compile(
    rf"^(?P<export>export\s+)?(?P<default>default\s+)?(?:declare\s+)?(?:(?P<fn>(?:async\s+)?function\b\s*\*?\s*(?P<fname>{IDENT})?)|(?P<cls>(?:abstract\s+)?class\b\s*(?P<cname>{IDENT})?)"
    rf"|(?P<iface>interface\s+(?P<iname>{IDENT}))|(?P<type>type\s+(?P<tname>{IDENT})\s*(?=[<=]))|(?P<enum>(?:const\s+)?enum\s+(?P<ename>{IDENT}))|(?P<var>(?:const|let|var)\s+(?P<vname>{IDENT})))",
    re.M,
)
_METHOD = re.compile(rf"^[ \t]+(?:(?:public|private|protected|static|override|abstract|readonly|async|get|set)\s+)*\*?(?P<name>#?{IDENT})\s*(?:<[^>\n]*>)?\(", re.M)
_EXPORT_LIST = re.compile(r"^export\s*\{([^}]*)\}\s*;?[ \t]*$", re.M)
_IMPORT = re.compile(rf"^import\s+(?:type\s+)?(?:(?P<default>{IDENT})\s*,?\s*)?(?:\*\s+as\s+(?P<star>{IDENT})\s*)?(?:\{{(?P<names>[^}}]*)\}}\s*)?(?:from\s*)?['\"](?P<module>[^'\"\n]+)['\"]", re.M)
_REEXPORT = re.compile(r"^export\s*(?:type\s*)?(?:\*(?:\s*as\s+\w+)?|\{(?P<names>[^}]*)\})\s*from\s*['\"](?P<module>[^'\"\n]+)['\"]", re.M)
_HERITAGE = re.compile(rf"\bextends\s+(?P<base>{IDENT}(?:\.{IDENT})*)|\bimplements\s+(?P<many>[^{{]+)")
_FIELD = re.compile(rf"\b(?:(?:private|public|protected|readonly|static|declare|override)\s+)*(?P<name>{IDENT})[?!]?\s*:\s*(?:readonly\s+)?(?P<type>[A-Z][\w$]*)")
_WORDS = frozenset("if for while switch catch return typeof function new await super import constructor".split())
CONTEXT_LINES, SPLIT_LINES, SPLIT_OVERLAP, HEADING_DEPTH = 3, 100, 10, 2


@dataclass
class Declaration:
    kind: str
    name: str | None
    start: int
    end: int
    exported: bool
    parent: str | None = None
    first: int = 0
    last: int = 0
    body: int = 0


@dataclass
class Scan:
    declarations: list[Declaration] = field(default_factory=list)
    imports: list[tuple[str, list[str]]] = field(default_factory=list)
    re_exports: list[tuple[str, list[str] | None]] = field(default_factory=list)
    masked: str = ""


def mask(text: str) -> str:
    """The text with comments and literals blanked, lines and lengths kept."""
    return _MASK.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def _close(text: str, at: int) -> int:
    """Offset after the bracket that closes the one at ``at``."""
    depth = 0
    for m in re.compile(r"[()\[\]{}]").finditer(text, at):
        depth += 1 if m.group() in "([{" else -1
        if depth == 0:
            return m.end()
    return len(text)


def _statement_end(text: str, at: int, *, block: bool) -> tuple[int, int]:
    """(end, body start) of a statement: after its block, or after the semicolon or line end at depth 0."""
    i, body, opened = at, -1, False
    for m in re.compile(r"[()\[\]{};\n]").finditer(text, at):
        if m.start() < i:
            continue
        c = m.group()
        if c in "([{":
            if c == "{" and body < 0:
                body = m.start()
            i = _close(text, m.start())
            opened = True
            if c == "{" and block and not re.match(r"\s*(?:[=>|&\[]|\{)", text[i : i + 40]):
                return i, body
        elif c == ";":
            return m.end(), body
        elif c in ")]}":
            return m.start(), body
        elif c == "\n" and opened and not block and not re.match(r"\s*(?:[.?:&|+*/=,)\]]|=>)", text[m.end() : m.end() + 60]) and not re.search(r"(?:[=,(&|+:?]|=>)\s*$", text[max(at, m.start() - 12) : m.start()]):
            return m.start(), body
    return len(text), body


def _decorated(text: str, at: int) -> int:
    """Line of a declaration, or of the first of the decorators above it."""
    lines = text[:at].split("\n")
    n = len(lines)
    while n > 1 and lines[n - 2].lstrip().startswith("@"):
        n -= 1
    return n


def scan_script(text: str) -> Scan:
    """Top-level declarations and class methods, imports and re-exports of one file."""
    text = text.lstrip("﻿").replace("\r\n", "\n")
    m = mask(text)
    line = lambda at: m.count("\n", 0, at) + 1
    out = Scan(masked=m)
    listed = {x.split(" as ")[0].strip() for e in _EXPORT_LIST.finditer(m) for x in e.group(1).split(",")}
    at = 0
    while (h := _HEAD.search(m, at)) is not None:
        block = h["fn"] is not None or h["cls"] is not None or h["iface"] is not None or h["enum"] is not None
        end, body = _statement_end(m, h.end(), block=block)
        name = h["fname"] or h["cname"] or h["iname"] or h["tname"] or h["ename"] or h["vname"]
        exported = h["export"] is not None or name in listed
        rest = m[h.end() : end]
        kind = "function" if h["fn"] else "class_shell" if h["cls"] else "interface" if h["iface"] else "type" if h["type"] else "block"
        if h["var"] and re.match(rf"\s*(?::[^=]+(?:=>[^=]+)?)?=\s*(?:async\s*)?(?:function\b|\([^;]*?\)\s*(?::[^;{{]+?)?=>|{IDENT}\s*=>)", rest):
            kind = "function"
        if name:
            out.declarations.append(Declaration(kind, name, _decorated(m, h.start()), line(max(h.start(), end - 1)), exported, None, h.start(), end, max(body, 0)))
        if kind == "class_shell" and body >= 0 and name:
            pos, stop = body + 1, end - 1
            while (f := _METHOD.search(m, pos, stop)) is not None:
                deep = m.count("{", body + 1, f.start()) - m.count("}", body + 1, f.start())
                close = _close(m, f.end() - 1)
                tail = re.match(r"\s*(?::[^;{]+)?\{", m[close : close + 400])
                if deep == 0 and tail and f["name"] not in _WORDS - {"constructor"}:
                    brace = close + tail.end() - 1
                    last = _close(m, brace)
                    begin = f.start() + len(f.group()) - len(f.group().lstrip())
                    shown = exported and not re.search(r"\b(?:private|protected)\b|#", m[begin : f.end()])
                    out.declarations.append(Declaration("method", f"{name}.{f['name']}", _decorated(m, begin), line(last - 1), shown, name, begin, last, brace))
                    pos = last
                else:
                    pos = f.end()
        at = max(end, h.end())
    for i in _IMPORT.finditer(text):
        if m[i.start() : i.start() + 6] == "import":
            names = [x.split(" as ")[-1].replace("type ", "").strip() for x in (i["names"] or "").split(",") if x.strip()]
            out.imports.append((i["module"], [x for x in (i["default"], i["star"]) if x and x != "type"] + names))
    for r in _REEXPORT.finditer(text):
        if m[r.start() : r.start() + 6] == "export":
            out.re_exports.append((r["module"], None if r["names"] is None else [x.split(" as ")[-1].strip() for x in r["names"].split(",") if x.strip()]))
    return out


def scan_markdown(text: str, depth: int = HEADING_DEPTH) -> list[tuple[int, int, str | None]]:
    """(first line, last line, heading path) of the sections at headings up to ``depth``; fenced lines are no headings."""
    lines = text.lstrip("﻿").replace("\r\n", "\n").split("\n")
    while lines and not lines[-1].strip():
        lines.pop()
    fence, heads, stack = None, [], {}
    for n, x in enumerate(lines, 1):
        if f := re.match(r"^\s*(```+|~~~+)", x):
            mark = f.group(1)[0]
            fence = None if fence == mark else fence or mark
        elif fence is None and (h := re.match(r"^(#{1,6})\s+(.*?)\s*#*\s*$", x)):
            level = len(h.group(1))
            stack = {k: v for k, v in stack.items() if k < level} | {level: h.group(2)}
            if level <= depth:
                heads.append((n, " > ".join(stack[k] for k in sorted(stack))))
    out = []
    if lines and (not heads or any(x.strip() for x in lines[: heads[0][0] - 1])):
        out.append((1, heads[0][0] - 1 if heads else len(lines), None))
    for (a, path), nxt in zip(heads, [*heads[1:], (len(lines) + 1, "")], strict=False):
        out.append((a, nxt[0] - 1, path))
    # a title with nothing under it before the next section is no section of its own
    titles = [not any(x.strip() for x in lines[a:b]) and len(out) > 1 for a, b, _ in out]
    return [x for x, bare in zip(out, titles, strict=True) if x[1] >= x[0] and not bare]


def _types(text: str) -> dict[str, str]:
    """Names and the capitalised types they are declared with."""
    return {m["name"]: m["type"] for m in _FIELD.finditer(text)}


def _heritage(code: str, d: Declaration) -> tuple[str | None, list[str]]:
    """(base class, implemented interfaces) of a class, or of the first base of an interface."""
    head = code[: max(0, d.body - d.first)]
    # type parameters can hold ``extends`` too
    while (plain := re.sub(r"<[^<>]*>", " ", head)) != head:
        head = plain
    base, many = None, []
    for m in _HERITAGE.finditer(head):
        if m["base"]:
            base = base or m["base"]
        else:
            many += [x for x in (y.strip() for y in m["many"].split(",")) if re.fullmatch(rf"{IDENT}(?:\.{IDENT})*", x)]
    return base, many


def scan_structure(text: str, scan: Scan | None = None) -> list[tuple[str, str, str, int]]:
    """(from name, to name, edge type, line): base classes, implemented interfaces, and names that are re-exported."""
    s = scan or scan_script(text)
    out = []
    for d in s.declarations:
        if d.kind in ("class_shell", "interface"):
            base, many = _heritage(s.masked[d.first : d.last], d)
            out += [(d.name, base, "EXTENDS", d.start)] * (base is not None) + [(d.name, x, "IMPLEMENTS", d.start) for x in many]
    plain = text.lstrip("\ufeff").replace("\r\n", "\n")
    for r in _REEXPORT.finditer(plain):
        if r["names"] is not None and s.masked[r.start() : r.start() + 6] == "export":
            at = plain.count("\n", 0, r.start()) + 1
            for x in filter(None, (y.strip().removeprefix("type ").strip() for y in r["names"].split(","))):
                old, _, new = x.partition(" as ")
                out.append(((new or old).strip(), old.strip(), "RE_EXPORTS", at))
    return out


def scan_calls(text: str, scan: Scan | None = None) -> list[tuple[str, str, str, int]]:
    """(caller, callee, evidence, line) of calls whose target's name can be told.

    A bare name is imported or of the same file; a receiver is ``this``, one of
    its typed fields, ``super``, a typed parameter, or a local made with ``new``.
    Other receivers give nothing.
    """
    s = scan or scan_script(text)
    m = s.masked
    imported = {n for _, names in s.imports for n in names}
    own = {d.name for d in s.declarations}
    classes = {d.name: d for d in s.declarations if d.kind == "class_shell"}
    bases, fields = {}, {}
    for name, d in classes.items():
        bases[name] = _heritage(m[d.first : d.last], d)[0]
        inner = [x for x in s.declarations if x.parent == name]
        # fields stand between the methods, or are parameters of the constructor with a modifier
        outside, at = "", d.body
        for x in sorted(inner, key=lambda x: x.first):
            outside += m[at : x.first] + "\n"
            at = x.last
        fields[name] = _types(outside + m[at : d.last])
        for x in inner:
            if x.name == f"{name}.constructor":
                fields[name] |= {f["name"]: f["type"] for f in _FIELD.finditer(m[x.first : x.body]) if re.match(r"(?:private|public|protected|readonly)\b", f.group())}
    out = []
    for d in s.declarations:
        if d.kind not in ("function", "method"):
            continue
        code = m[d.first : d.last]
        start = max(0, d.body - d.first)
        types = _types(code[:start])
        made = dict(re.findall(rf"\b(?:const|let|var)\s+({IDENT})\s*=\s*new\s+([A-Z][\w$]*)", code))
        for c in re.finditer(rf"(?P<new>\bnew\s+)?(?P<recv>\b(?:{IDENT}\.)*)?(?P<name>\b{IDENT})\s*\(", code[start:]):
            name, recv = c["name"], (c["recv"] or "").rstrip(".")
            if name in _WORDS or c["new"] or code[start + c.start() - 1 : start + c.start()] == ".":
                continue
            at = m.count("\n", 0, d.first + start + c.start("name")) + 1
            field = fields.get(d.parent, {}).get(recv.removeprefix("this.")) if recv.startswith("this.") else None
            if not recv:
                if name in imported:
                    out.append((d.name, name, "import", at))
                elif name in own:
                    out.append((d.name, name, "same_file", at))
            elif recv == "this" and d.parent:
                out.append((d.name, f"{d.parent}.{name}", "this_method", at))
            elif recv == "super" and bases.get(d.parent):
                out.append((d.name, f"{bases[d.parent]}.{name}", "super_method", at))
            elif field:
                out.append((d.name, f"{field}.{name}", "field_type", at))
            elif recv in made:
                out.append((d.name, f"{made[recv]}.{name}", "new_expression", at))
            elif recv in types:
                out.append((d.name, f"{types[recv]}.{name}", "parameter_type", at))
    return out
