import math
import os
import random

import pytest
from pyspark.sql import functions as F

from fernglass.operators import search as S
from fernglass.plans import code_search, ranking_eval

from .compare import DATA

#: The smallest table where the queries' names are declared.
NAMED = os.path.join(os.path.dirname(DATA), "sf0.01")

COLUMNS = "chunk_id string, chunk_type string, symbol_name string, parent_symbol string, file_path string, start_line int, content string, is_exported boolean"


def chunks(spark, rows):
    return spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4] if len(r) > 4 else "a.ts", 1, r[5] if len(r) > 5 else "", True) for r in rows], COLUMNS)


def test_bm25_counts_overlaps_and_keeps_repeated_terms(spark):
    texts = ["aaaa bbb", "aaa", "foo bar", "", "FOO aaaaaa", None]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "chunk_id string, content string")
    got = {(r.query_id, r.chunk_id): r.score for r in S.bm25(df, [(1, "aaa aaa"), (2, "foo"), (3, "x")]).collect()}
    n, docs = len(texts), [t.lower() for t in texts if t is not None]
    d = [max(0, len(t) - 2) for t in docs]
    avg = sum(d) / n
    for qid, terms in ((1, ["aaa", "aaa"]), (2, ["foo"])):
        for i, t in enumerate(docs):
            cid = str(texts.index(next(x for x in texts if x is not None and x.lower() == t)))
            want = 0.0
            for term in terms:
                f = sum(t.startswith(term, k) for k in range(len(t)))
                df_ = sum(term in x for x in docs)
                idf = math.log((n - df_ + 0.5) / (df_ + 0.5))
                want += max(idf, 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d[i] / avg)) if f else 0
            if want:
                assert abs(got[(qid, cid)] + want) < 1e-9
            else:
                assert (qid, cid) not in got
    assert not any(q == 3 for q, _ in got)


def test_scope_limits_candidates_but_not_statistics(spark):
    df = chunks(spark, [(str(i), "function", None, None, f"{'in' if i % 2 else 'out'}/a.ts", "needle " * (i + 1)) for i in range(9)])
    full = {r.chunk_id: r.score for r in S.bm25(df, [(1, "needle")]).collect()}
    part = {r.chunk_id: r.score for r in S.bm25(df, [(1, "needle")], scope=F.col("file_path").startswith("in/")).collect()}
    assert part == {k: v for k, v in full.items() if int(k) % 2}
    fused = S.fused_search(spark, df, [(1, "needle")], scope=F.col("file_path").startswith("in/")).collect()
    assert {int(r.chunk_id) % 2 for r in fused} == {1}


def test_declared_names(spark):
    df = chunks(spark, [("m", "method", "Scrollable.getFuture", "Scrollable"), ("s", "class_shell", "Scrollable", None), ("u", "method", "A.uniqueMethod", "A"), *[(f"c{i}", "method", f"C{i}.commonMethod", f"C{i}") for i in range(5)], ("v", "method", "Foo.my_var", "Foo"), ("x", "method", "Foo.myXvar", "Foo"), ("n", "block", None, None)])
    got = lambda q: [(r.chunk_id, r.match) for r in S.rank_declared(S.declared(spark, df, [(1, q)]), 10).orderBy("d_rank").collect()]
    assert got("Scrollable getFuture") == [("s", "full"), ("m", "segment")]
    assert got("my_var") == [("v", "segment")] and got("whitespace") == []
    assert got("uniqueMethod commonMethod")[0] == ("u", "segment") and len(got("uniqueMethod commonMethod")) == 6


def test_fusion_order_and_window_effects(spark):
    lexical = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_id int, chunk_id string, f_rank int")
    names = spark.createDataFrame([(1, "c", 1), (1, "z", 2)], "query_id int, chunk_id string, d_rank int")
    got = [r.chunk_id for r in S.top(S.fuse(lexical, names), 10, *S.fused_order()).orderBy("rank").collect()]
    assert got == ["c", "a", "b", "z"]
    eff = {r.chunk_id: (r.rank_with, r.rank_without) for r in S.window_effects(lexical, names, 3).collect()}
    assert eff == {"c": (1, 3), "a": (2, 1), "b": (3, 2)}


def walk(rows, limit):
    kept, kind, hints = [], {}, {}
    for r in rows:
        cls = r["sym"] if r["type"] == "class_shell" else r["parent"] if r["type"] == "method" else None
        key = None if cls is None else (r["file"], cls)
        if key and key in kind and kind[key][0] != r["type"]:
            hints.setdefault(kind[key][1], []).append(r["sym"])
            continue
        if len(kept) == limit:
            break
        if key and key not in kind:
            kind[key] = (r["type"], r["id"])
        kept.append(r["id"])
        if len(kept) == limit:
            break
    return kept, {k: ",".join(v) for k, v in hints.items()}


def test_collisions_match_a_sequential_walk(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for q in range(150):
        ranked = []
        for i in range(rng.randint(0, 14)):
            kind = rng.choice(["class_shell", "method", "method", "function"])
            cls = rng.choice(["A", "B", None])
            ranked.append({"id": f"q{q}_{i}", "type": kind, "sym": (cls if kind == "class_shell" else f"{cls}.m{i}"), "parent": cls if kind == "method" else None, "file": rng.choice("xy")})
        want[q] = walk(ranked, 5)
        rows += [(q, r["id"], r["type"], r["file"], r["sym"], r["parent"], n) for n, r in enumerate(ranked, 1)]
    df = spark.createDataFrame(rows, "query_id int, chunk_id string, chunk_type string, file_path string, symbol_name string, parent_symbol string, rank int")
    got = {}
    for r in S.drop_collisions(df, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, ([], {}))[0].append(r.chunk_id)
        if r.hint is not None:
            got[r.query_id][1][r.chunk_id] = r.hint
    assert got == {q: w for q, w in want.items() if w[0]}


@pytest.mark.skipif(not os.path.isdir(NAMED), reason="needs the test tables")
def test_rrf_sweep_fuses_and_scores(spark):
    lexical, names = code_search._rankers(spark, NAMED)
    f = {(r.query_id, r.chunk_id): r.f_rank for r in lexical.collect()}
    d = {(r.query_id, r.chunk_id): r.d_rank for r in names.collect()}
    at = {c.chunk_id: c for c in code_search.chunks(spark, NAMED).collect()}
    targets = {}
    for t in ranking_eval._asked_targets(spark, NAMED).collect():
        targets.setdefault(t.query_id, []).append(t)
    want, far = {}, math.inf
    for k in ranking_eval.E.RRF_SWEEP:
        for q, ts in targets.items():
            score = {c: sum(1 / (k + r[q, c]) for r in (f, d) if (q, c) in r) for c in {c for x, c in f.keys() | d.keys() if x == q}}
            top = sorted(score, key=lambda c: (-score[c], f.get((q, c), far), d.get((q, c), far), c))[:10]
            firsts = {next((i for i, c in enumerate(top, 1) if at[c].file_path == t.file_path and (at[c].symbol_name == t.symbol or at[c].start_line == t.line)), None) for t in ts} - {None}
            ideal = sum(1 / math.log2(i + 1) for i in range(1, min(10, len(ts)) + 1))
            want[k, q] = sum(1 / math.log2(i + 1) for i in firsts) / ideal
    got = {(r.k, r.query_id): r.ndcg for r in ranking_eval.rrf_k_sweep(spark, NAMED).collect()}
    assert d and want.keys() == got.keys() and all(abs(got[x] - want[x]) < 1e-8 for x in want)
