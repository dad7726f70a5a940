import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fernglass.operators import graph as G
from fernglass.plans import code_graph as P
from fernglass.plans import code_search

from .compare import DATA


def test_closure_matches_breadth_first_search(spark):
    rng = random.Random(1)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(90)] + [(1, 1)]
    got = {r.node: r.depth for r in G.closure(spark.createDataFrame(links, "src int, dst int"), spark.createDataFrame([(3,), (7,)], "node int")).collect()}
    depth, frontier, d = {}, {3, 7}, 0
    while frontier:
        d += 1
        frontier = {a for a, b in links if b in frontier} - set(depth)
        depth |= dict.fromkeys(frontier, d)
    assert got == depth


def _reached(links):
    """{(target, node): depth} by breadth-first search from every dst."""
    back, out = {}, {}
    for a, b in links:
        back.setdefault(b, set()).add(a)
    for target in back:
        frontier, d = {target}, 0
        while frontier:
            d += 1
            frontier = {x for n in frontier for x in back.get(n, ()) if (target, x) not in out}
            out |= {(target, x): d for x in frontier}
    return out


def test_callers_of_everything_are_searched_or_joined_with_the_same_result(spark, monkeypatch):
    rng = random.Random(2)
    # a long chain, a cycle, a node that calls more than are taken one by one, one without a name
    links = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(330)] + [(f"c{i}", f"c{i + 1}") for i in range(70)] + [("c70", "c69"), ("n1", "n1")] + [("hub", f"n{i}") for i in range(40)]
    df = spark.createDataFrame([*links, *links[:5], (None, "c3"), ("c4", None)], "src string, dst string")
    found = [(r.target, r.node, r.depth) for r in G.closure_of_all(df).collect()]
    assert len(found) == len(set(found)) and {(t, n): d for t, n, d in found} == _reached([*links, (None, "c3")])
    few = spark.createDataFrame(links[:40] + links[-40:], "src string, dst string")
    sides = [sorted(map(tuple, G.closure_of_all(few, n).collect())) for n in (0, G.SHIPPED)]
    assert sides[0] == sides[1] and len(sides[0]) > 40
    assert G.closure_of_all(df.limit(0)).collect() == []
    # pairs are not written or joined on the way, as one round after the other over all of them does not end in time
    monkeypatch.setattr(G, "closure", None)
    assert G.closure_of_all(df).count() == len(found)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_closures_start_from_everything(spark):
    calls = [(r.src, r.dst) for r in P._calls(spark, DATA).collect()]
    assert {(r.target, r.node): r.depth for r in P.graph_transitive_callers_all(spark, DATA).collect()} == _reached(calls)
    stars = [(r.src, r.dst) for r in P._stars(spark, DATA).collect()]
    named = {r.node for r in P._named(spark, DATA).collect()}
    assert {(r.target, r.file_id): r.depth for r in P.graph_star_closure_all(spark, DATA).collect()} == {k: d for k, d in _reached(stars).items() if k[1] not in named}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_dedup_takes_every_chunk(spark):
    first, rows = {}, code_search.chunks(spark, DATA).collect()
    key = lambda c: (c.file_path, c.symbol_name if c.chunk_type == "class_shell" else c.parent_symbol if c.chunk_type == "method" else None)
    for c in sorted(rows, key=lambda c: (-len(c.content), c.chunk_id)):
        first.setdefault(key(c), c.chunk_type)
    want = {c.chunk_id for c in rows if key(c)[1] is None or c.chunk_type == first[key(c)]}
    got = [r.chunk_id for r in code_search.shell_method_dedup_all(spark, DATA).collect()]
    assert len(got) == len(want) and set(got) == want


def test_pagerank_sums_to_one_and_favours_the_called(spark):
    nodes = spark.createDataFrame([(i,) for i in range(6)], "id int")
    edges = spark.createDataFrame([(i, 0) for i in range(1, 5)] + [(1, 2)], "src int, dst int")
    got = {r.id: r["rank"] for r in G.pagerank(edges, nodes, rounds=50).collect()}
    assert abs(sum(got.values()) - 1) < 1e-6 and max(got, key=got.get) == 0 and got[2] > got[3]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_registered_pagerank_converges_over_calls_and_implementors(spark):
    links = [(r.from_id, r.to_id) for r in P.edges(spark, DATA).filter("edge_type in ('POTENTIAL_CALL', 'IMPLEMENTS')").collect()]
    ids = {r.symbol_id for r in P.symbols(spark, DATA).collect()}
    links = [(a, b) for a, b in links if a in ids and b in ids]
    out, rank = Counter(a for a, _ in links), dict.fromkeys(ids, 1 / len(ids))
    for _ in range(300):
        base = (0.15 + 0.85 * sum(v for k, v in rank.items() if k not in out)) / len(ids)
        new = dict.fromkeys(ids, base)
        for a, b in links:
            new[b] += 0.85 * rank[a] / out[a]
        rank = new
    got = {r.id: r["rank"] for r in P.graph_pagerank(spark, DATA).collect()}
    assert got.keys() == ids and sum(abs(got[k] - rank[k]) for k in ids) < 1e-7


SYMBOLS = "symbol_id string, name string, kind string, file_path string, line int, ordinal int, is_exported boolean"


def test_call_resolution_rules(spark):
    symbols = spark.createDataFrame([("1", "f", "function", "a.ts", 1, 0, True), ("2", "f", "function", "b.ts", 1, 0, True), ("3", "T.m", "method", "b.ts", 5, 1, True), ("4", "g", "function", "c.ts", 1, 0, True), ("5", "C.x", "method", "a.ts", 9, 2, False), ("6", "T.m", "method", "z.ts", 1, 0, True)], SYMBOLS)
    imports = spark.createDataFrame([("a.ts", 0, ["T", "g"], "b.ts"), ("d.ts", 0, ["f"], "b.ts"), ("d.ts", 1, ["f"], "a.ts"), ("e.ts", 0, ["g"], None)], "file_path string, ordinal int, symbols array<string>, resolved_path string")
    calls = [("a.ts", 0, "f", "same_file"), ("a.ts", 1, "f", "import"), ("a.ts", 2, "C.x", "this_method"), ("a.ts", 3, "T.m", "parameter_type"), ("d.ts", 0, "f", "import"), ("e.ts", 0, "g", "import"), ("e.ts", 1, "T.m", "field_type"), ("q.ts", 0, "g", None), ("a.ts", 9, "nope", "same_file")]
    got = {(r.file_path, r.to_name): r.symbol_id for r in G.resolve_calls(spark.createDataFrame(calls, "file_path string, ordinal int, to_name string, resolution string"), symbols, imports).collect()}
    assert got == {("a.ts", "f"): "1", ("a.ts", "C.x"): "5", ("a.ts", "T.m"): "3", ("d.ts", "f"): "2", ("e.ts", "T.m"): "3", ("q.ts", "g"): "4"}


def test_calls_resolve_through_barrels(spark):
    symbols = spark.createDataFrame(
        [("m1", "f", "export", "bar.ts", 1, 0, True), ("m2", "f", "export", "mid.ts", 1, 0, True), ("f", "f", "function", "deep.ts", 1, 0, True), ("gone", "g", "function", "a_first.ts", 1, 0, True), ("g", "g", "function", "low.ts", 1, 0, True), ("g2", "g", "function", "high.ts", 1, 0, True), ("t0", "T.m", "method", "a_first.ts", 5, 1, True), ("t", "T.m", "method", "low.ts", 5, 1, True)]
        + [(f"c{i}", "h", "export", f"c{i}.ts", 1, 0, True) for i in range(6)] + [("h", "h", "function", "end.ts", 1, 0, True)], SYMBOLS
    )
    links = [("m1", "m2"), ("m2", "f"), *[(f"c{i}", f"c{i + 1}") for i in range(5)], ("c5", "h")]
    edges = spark.createDataFrame([(i, a, b, "RE_EXPORTS") for i, (a, b) in enumerate(links)], "edge_id int, from_id string, to_id string, edge_type string")
    files = spark.createDataFrame([("bar.ts", 1), ("star.ts", 2), ("mid.ts", 3), ("low.ts", 4), ("high.ts", 5), ("a_first.ts", 6), ("deep.ts", 7)], "path string, file_id int")
    stars = spark.createDataFrame([(2, 3), (3, 5), (3, 4), (4, 2)], "src int, dst int")
    imports = spark.createDataFrame([("x.ts", 0, ["f"], "bar.ts"), ("x.ts", 1, ["g", "T"], "star.ts"), ("x.ts", 2, ["h"], "c0.ts")], "file_path string, ordinal int, symbols array<string>, resolved_path string")
    calls = spark.createDataFrame([("x.ts", 0, "f", "import"), ("x.ts", 1, "g", "import"), ("x.ts", 2, "T.m", "parameter_type"), ("x.ts", 3, "h", "import")], "file_path string, ordinal int, to_name string, resolution string")
    got = {r.to_name: r.symbol_id for r in G.resolve_calls(calls, symbols, imports, (edges, files, stars)).collect()}
    assert got == {"f": "f", "g": "g", "T.m": "t"}
    chain = {r.marker: (r.symbol_id, r.hops) for r in G.named_chain(edges, symbols).collect()}
    assert chain["m1"] == ("f", 2) and chain["c1"] == ("h", 5) and "c0" not in chain


def test_chain_and_page(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(9)], "src int, dst int")
    got = {r.node: (r.end, r.hops) for r in G.chain(links, 5).collect()}
    assert got[0] == (5, 5) and got[8] == (9, 1) and got[6] == (9, 3)
    rows = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 1)], "k string, v int")
    out = G.page(rows, ["k"], 3, F.col("v")).collect()
    assert sorted((r.k, r.place, r.truncated_total) for r in out) == [("a", 1, 5), ("a", 2, 5), ("a", 3, 5), ("b", 1, None)]
