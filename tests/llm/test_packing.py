import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fernglass.llm.packing import BestFit, fill_report, pack


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 130), max_size=120), st.integers(1, 50), st.integers(1, 6))
def test_bins_hold_whole_items_within_capacity(sizes, capacity, open_bins):
    p = BestFit(capacity, open_bins)
    used, total = {}, 0
    for s in sizes:
        parts = p.add(s)
        assert sum(n for _, _, n, _ in parts) == s
        assert len(parts) == 1 or s > capacity
        assert [start for *_, start in parts] == [sum(x[2] for x in parts[:i]) for i in range(len(parts))]
        for b, _, n, _ in parts:
            used[b] = used.get(b, 0) + n
        total += s
        assert p.open <= open_bins
    assert all(v <= capacity for v in used.values()) and sum(used.values()) == total


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_takes_the_tightest_open_bin_and_closes_the_fullest(sizes):
    p, free, nxt = BestFit(40, 4), {}, 0
    for s in sizes:
        fits = [f for f in free.values() if f >= s]
        b, _, _, _ = p.add(s)[-1]
        if fits:
            assert free[b] == min(fits)
        else:
            if len(free) >= 4:
                del free[next(k for k in free if free[k] == min(free.values()) and k not in set(x for v in p.by_free.values() for x in v))]
            assert b == nxt
            nxt, free[b] = nxt + 1, 40
        free[b] -= s
        if free[b] == 0:
            del free[b]


def test_pack_over_lanes_keeps_every_token(spark):
    rows = [(i, (i * 37) % 700) for i in range(3000)] + [(5, 185), (None, 9), (7, None), (8, 0), (9, 5000)]
    df = spark.createDataFrame(rows, "item_id bigint, size bigint")
    caps = {"small": 512, "large": 4096}
    packed = pack(df.selectExpr("*", "'clash' as lane"), caps, lane_size=100_000).cache()
    got = {r.container: r for r in fill_report(packed, caps).collect()}
    for c in caps:
        assert got[c].n_tokens == sum(s or 0 for _, s in rows)
        assert got[c].max_used <= caps[c] and got[c].fill > 0.85
    assert packed.filter("container = 'small'").select("lane").distinct().count() > 5
    assert packed.filter("container = 'small' and item_id = 9").count() == 11


def test_pack_of_nothing(spark):
    assert pack(spark.createDataFrame([], "item_id bigint, size bigint"), {"a": 10}).count() == 0
    with pytest.raises(ValueError):
        BestFit(0)
