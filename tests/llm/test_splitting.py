import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from fernglass.llm.splitting import cuts, sparse_table, split_oversized, strengths, strongest


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=60), st.data())
def test_sparse_table_finds_the_rightmost_maximum(values, data):
    v = np.array(values)
    lo = data.draw(st.integers(0, len(v) - 1))
    hi = data.draw(st.integers(lo, len(v) - 1))
    best = max(range(lo, hi + 1), key=lambda i: (v[i], i))
    assert strongest(sparse_table(v), v, lo, hi) == best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=300), st.integers(0, 40), st.integers(0, 50))
def test_pieces_cover_overlap_and_keep_the_limit(values, limit, overlap):
    out = cuts(np.array(values), limit, overlap)
    top = max(1, limit)
    lap = min(max(0, overlap), top - 1)
    assert out[0][0] == 0 and out[-1][1] == len(values) - 1
    assert all(b - a + 1 <= top for a, b, _ in out)
    assert all(nxt[0] == cur[1] + 1 - lap and nxt[1] > cur[1] for cur, nxt in zip(out, out[1:], strict=False))


def test_prose_is_cut_before_headings_and_not_in_fences():
    lines = ["# a", "x.", "", "```", "", "# no", "```", "", "# b", "y."]
    s = strengths(lines, True)
    assert s[7] == 9 and s[4] == 0 and s[5] == 0


def test_split_handles_dirt(spark):
    long = "\n".join(f"line {i};" for i in range(25)) + "\n"
    rows = [("a", long, 10, 10, 3, False), ("b", "one", 1, 10, 3, False), ("c", None, 1, 10, 3, False), ("d", "", 1, 10, 3, True), ("e", long, None, 10, None, True), (None, long, 1, None, 2, False), ("f", "x\r\n" * 30, 1, 1, 5, False), ("a", long, 10, 10, 3, False)]
    df = spark.createDataFrame(rows, "item_id string, text string, first_line int, `limit` int, overlap int, prose boolean").selectExpr("*", "1 as piece", "2 as n_lines")
    out = split_oversized(df).collect()
    assert {r.item_id for r in out} == {"a", "e", "f"}
    a = sorted({(r.piece, r.start_line, r.end_line) for r in out if r.item_id == "a"})
    assert a[0][1] == 10 and a[-1][2] == 34 and all(y[1] == x[2] + 1 - 3 for x, y in zip(a, a[1:], strict=False))
    whole = [r for r in sorted((r for r in out if r.item_id == "e"), key=lambda r: r.piece)]
    assert "\n".join(r.text for r in whole) == long.rstrip("\n")
    assert sum(r.item_id == "f" for r in out) == 30
    assert split_oversized(df.limit(0)).count() == 0
