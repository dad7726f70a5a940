import os
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fernglass.llm.mixing import BLOCKS, draw, interleave, plan_mix, schedule, shares
from fernglass.llm.q_mixing import _mix, p8_drawn
from tests.compare import DATA

LARGE = "/root/testdata/sf0.1"


def _furthest(order):
    """Most tokens that a source is off its share of what has been drawn, after any of (source, tokens)."""
    total, done, now, worst = Counter(), Counter(), 0, 0.0
    for s, n in order:
        total[s] += n
    every = sum(total.values())
    for s, n in order:
        done[s] += n
        now += n
        worst = max([worst, *(abs(done[x] - total[x] / every * now) for x in total)])
    return worst


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(1, 60), min_size=1, max_size=25), min_size=1, max_size=9))
def test_schedule_deviates_by_less_than_one_block(lengths):
    blocks = {f"s{i}": b for i, b in enumerate(lengths)}
    order = schedule(blocks)
    assert {s: [i for x, i in order if x == s] for s in blocks} == {s: list(range(len(b))) for s, b in blocks.items()}
    longest = max(max(b) for b in lengths)
    # in every unit of every block, not only at their ends
    assert _furthest([(s, 1) for s, i in order for _ in range(blocks[s][i])]) < longest


def test_schedule_of_empty_documents():
    assert sorted(schedule({"a": [0, 0], "b": [3], "c": []})) == [("a", 0), ("a", 1), ("b", 0)]


def _docs(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 4}", 20 + i % 90) for i in range(4000)]
    rows += [(9001, None, 5), (9002, "unknown", 5), (9003, "s1", 0)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint").withColumn("bucket", F.lit("clash"))


def test_draw_reaches_the_shares_and_the_caps(spark):
    rows, docs = _docs(spark)
    targets = {"hot": (0.2, 1), "s0": (0.1, 2), "s1": (0.4, 3), "s2": (0.2, 2), "s3": (0.1, 1), "gone": (0.5, 3)}
    have = {}
    for _, s, n in rows:
        if s in targets:
            have[s] = have.get(s, 0) + n
    plans = plan_mix(have, targets)
    drawn = draw(docs, plans).cache()
    got = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("t"), F.max("repeats").alias("r"), F.count("*").alias("n"), F.countDistinct("doc_id").alias("u")).collect()
    total = sum(r.t for r in got)
    live = sum(targets[r.source][0] for r in got)
    assert {r.source for r in got} == {"hot", "s0", "s1", "s2", "s3"}
    for r in got:
        assert abs(r.t / total - targets[r.source][0] / live) < 0.002 and r.r <= targets[r.source][1] and r.n == r.u
    assert any(p.need >= p.max_repeats * p.available - 1 for p in plans)
    slots = interleave(drawn, plans, 64)
    assert slots.count() == drawn.agg(F.sum("repeats")).first()[0]
    tdf = spark.createDataFrame([(s, w, r) for s, (w, r) in targets.items()], "source string, target_share double, max_repeats int")
    adf = spark.createDataFrame(list(have.items()), "source string, available bigint")
    out = {r.source: r for r in shares(drawn, tdf, adf).collect()}
    assert out["gone"].actual_share == 0 and abs(sum(r.actual_share for r in out.values()) - 1) < 1e-9


def _longest_block(uses):
    blocks = Counter()
    for u in uses:
        blocks[u.slot] += u.n_tokens
    return max(blocks.values())


def test_prefixes_of_drawn_documents_keep_the_shares(spark):
    rows = [(i, f"s{i % 3}", 4000 if i % 50 < 3 else 10 + i % 40) for i in range(1500)] + [(9000, "rare", 3), (9001, "rare", 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    have = {}
    for _, s, n in rows:
        have[s] = have.get(s, 0) + n
    plans = plan_mix(have, {"s0": (0.5, 2), "s1": (0.3, 3), "s2": (0.19998, 2), "rare": (0.00002, 2)})
    drawn = draw(docs, plans).cache()
    total = sum(p.need for p in plans)
    for blocks in (1 << 14, 30):
        uses = interleave(drawn, plans, blocks).orderBy("slot", "at", "doc_id").collect()
        assert len(uses) == drawn.agg(F.sum("repeats")).first()[0] and {u.source for u in uses} == {"s0", "s1", "s2", "rare"}
        assert len({u.slot for u in uses}) <= blocks + 4 and _longest_block(uses) < total / blocks + 4000
        assert _furthest([(u.source, u.n_tokens) for u in uses]) < _longest_block(uses)


@pytest.mark.skipif(not os.path.isdir(LARGE), reason="needs the test tables")
@pytest.mark.parametrize("folder", [DATA, LARGE])
def test_p8_drawn_is_in_the_order_of_the_schedule(spark, folder):
    uses = p8_drawn(spark, folder).collect()
    _, _, _, plans = _mix(spark, folder)
    assert [(u.slot, u.at) for u in uses] == sorted((u.slot, u.at) for u in uses)
    assert Counter(u.doc_id for u in uses) == {u.doc_id: u.repeats for u in uses}
    block, longest = _longest_block(uses), max(u.n_tokens for u in uses)
    assert block < longest + max(1, sum(p.need for p in plans) / BLOCKS)
    # after every document, against what is drawn and against the targets
    assert _furthest([(u.source, u.n_tokens) for u in uses]) < block
    done, now = Counter(), 0
    for u in uses:
        done[u.source] += u.n_tokens
        now += u.n_tokens
        assert all(abs(done[p.source] - p.weight * now) < block + longest / 2 for p in plans)


def test_nothing_to_draw(spark):
    docs = spark.createDataFrame([], "doc_id bigint, source string, n_tokens bigint")
    plans = plan_mix({}, {"a": (1.0, 2)})
    assert plans == [] and draw(docs, plans).count() == 0 and interleave(draw(docs, plans), plans).count() == 0
