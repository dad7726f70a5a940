import re
from itertools import product

import pytest
from pyspark.sql import functions as F

from fernglass.functions import text as T
from fernglass.functions.paths import canonical_path, depth_below, glob_to_regex

GLOBS = [
    ("**/node_modules/**", "a/node_modules/b/c.ts", True), ("**/node_modules/**", "node_modules/x", True), ("**/node_modules/**", "a/node_modulesx/b", False), (".state/**", ".state/a/b", True), ("src/*.ts", "src/a.ts", True),
    ("src/*.ts", "src/b/a.ts", False), ("src/my_file.ts", "src/myXfile.ts", False), ("src/?.ts", "src/a.ts", True), ("src/?.ts", "src/ab.ts", False), ("**/*.TS", "a.ts", False), ("a+(b).ts", "a+(b).ts", True), ("**/x.ts", "x.ts", True),
]


@pytest.mark.parametrize(("glob", "path", "hit"), GLOBS)
def test_globs(glob, path, hit):
    assert bool(re.match(glob_to_regex(glob), path)) is hit


def test_globs_agree_with_a_matcher_written_from_the_rules():
    def match(p, s):
        if not p:
            return not s
        if p.startswith("**/"):
            return match(p[3:], s) or any(s[i] == "/" and i > 0 and match(p[3:], s[i + 1 :]) for i in range(len(s)))
        if p.startswith("**"):
            return any(match(p[2:], s[i:]) for i in range(len(s) + 1))
        if p[0] == "*":
            return any(match(p[1:], s[i:]) for i in range(len(s) + 1) if "/" not in s[:i])
        return bool(s) and (p[0] == s[0] or p[0] == "?" and s[0] != "/") and match(p[1:], s[1:])

    globs = ["".join(x) for n in (1, 2, 3) for x in product(["a", "*", "**/", "**", "?", "/"], repeat=n)]
    paths = ["".join(x) for n in range(1, 5) for x in product("ab/", repeat=n) if "//" not in "".join(x) and not "".join(x).startswith("/")]
    for g in globs:
        rx = re.compile(glob_to_regex(g))
        assert [p for p in paths if bool(rx.match(p)) != match(g, p)] == [], g


def test_paths_have_one_spelling(spark):
    rows = [("a/b.ts", "a/b.ts"), ("./a//b.ts", "a/b.ts"), ("a\\x\\..\\b.ts", "a/b.ts"), ("/a/./b.ts/", "a/b.ts"), ("../a/b.ts", "a/b.ts"), ("A/b.ts", "A/b.ts"), ("a/..", ""), (None, None), ("", "")]
    got = spark.createDataFrame(rows, "p string, want string").select(canonical_path(F.col("p")).alias("g"), "want").collect()
    assert [r.g for r in got] == [r.want for r in got]
    d = spark.createDataFrame([("a/b/c/d.ts",)], "p string").select(depth_below(F.col("p"), "a/b").alias("d"), depth_below(F.col("p"), "").alias("e")).first()
    assert (d.d, d.e) == (1, 3)


def test_text_functions(spark):
    one = lambda e: spark.range(1).select(e.alias("x")).first().x
    for name, want in (("getUserProfile", ["get", "user", "profile"]), ("get_user_profile", ["get", "user", "profile"]), ("HTTPServer", ["http", "server"]), ("userUserById", ["user"]), ("a-b", [])):
        assert one(T.identifier_words(F.lit(name))) == want
    for a, b, want in (("circle", "circle", 1.0), ("circle", "zzzzzz", 0.0), ("ab", "abc", 0.0), ("night", "nights", 6 / 7)):
        assert abs(one(T.trigram_similarity(F.lit(a), F.lit(b))) - want) < 1e-12
    assert one(T.query_terms(F.lit("an foo_bar foo_bar x"))) == ["foo_bar", "foo_bar"]
    tokens = T.phrase_tokens(F.lit("const bar_baz = a$b; Class.method"))
    assert [one(T.contains_phrase(tokens, p)) for p in (["baz"], ["class", "method"], ["a", "b"], ["method", "class"], [])] == [True, True, True, False, False]
    assert [one(T.is_code_like(F.lit(t))) for t in ("whitespace", "myVar", "my_var", "v8", "$x")] == [False, True, True, True, True]
    assert one(T.first_doc_comment(F.lit("a /* b */ /** c\n d */ /** e */"))) == "/** c\n d */" and one(T.first_doc_comment(F.lit("x"))) is None
    assert one(F.length(T.clip(F.lit("a" * 501)))) == 501 and one(T.clip(F.lit("a" * 500))) == "a" * 500
    assert one(T.pascal_types(F.lit("(a: Foo, b: Promise<Bar>): Foo"))) == ["Foo", "Bar"]
    v = spark.createDataFrame([(x,) for x in ("1.2.10", "1.2.9", "v1.3.0-rc.1", "1.3.0", "2")], "v string").orderBy(T.version_key(F.col("v"))).collect()
    assert [r.v for r in v] == ["1.2.9", "1.2.10", "v1.3.0-rc.1", "1.3.0", "2"]
