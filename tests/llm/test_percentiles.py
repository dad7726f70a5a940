import math
import random

import pytest
from pyspark.sql import functions as F

from fernglass.llm.percentiles import BITS, from_order_key, histogram, merge, order_key, percentiles, radix_select

VALUES = [0.0, -0.0, 1.0, -1.0, 2.0**-1074, 2.0**-1022, 1e-300, 3.5, 2.0**52 + 1, 1.7976931348623157e308, float("inf"), -float("inf"), -3.5, 8.0, 7.999999999999999, 1024.0, 1023.9999999999999]


def test_order_key_sorts_and_round_trips(spark):
    df = spark.createDataFrame([(v,) for v in VALUES], "v double").select("v", order_key(F.col("v")).alias("k"))
    rows = df.withColumn("back", from_order_key(F.col("k"))).collect()
    assert all(r.back == r.v for r in rows)
    ordered = sorted(rows, key=lambda r: r.k)
    assert [r.v for r in ordered] == sorted(VALUES)


def test_null_and_nan_have_no_key(spark):
    rows = spark.createDataFrame([(None,), (float("nan"),)], "v double").select(order_key(F.col("v")).alias("k")).collect()
    assert [r.k for r in rows] == [None, None]


def _data(spark):
    rng = random.Random(5)
    rows = [(g, d, float(int(rng.lognormvariate(4, 2)))) for g in ("a", "b", None) for d in range(4) for _ in range(200)]
    rows += [("hot", 0, 7.0)] * 500 + [("a", 0, None), ("none", 0, None), ("a", 0, float("nan"))]
    return rows, spark.createDataFrame(rows, "grp string, day int, value double").withColumn("n", F.lit("clash")).withColumn("bucket", F.lit("clash"))


def _expected(rows, p, keep):
    out = {}
    for g, d, v in rows:
        if v is not None and v == v:
            out.setdefault((g, d) if keep else g, []).append(v)
    return {k: sorted(v)[max(1, math.ceil(p * len(v) - 1e-9)) - 1] for k, v in out.items()}


def test_merged_daily_histograms_stay_within_the_error(spark):
    rows, df = _data(spark)
    days = histogram(df, ["grp", "day"], "value")
    got = {r.grp: r for r in percentiles(days, ["grp"], [0.5, 0.95, 0.99]).collect()}
    assert set(got) == {"a", "b", None, "hot"}
    for p, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")):
        for g, want in _expected(rows, p, False).items():
            assert abs(got[g][name] - want) <= want * 2.0 ** (11 - BITS)
    assert got["hot"]["n"] == 500


def test_merge_of_parts_equals_the_whole(spark):
    _, df = _data(spark)
    whole = histogram(df, ["grp"], "value")
    parts = histogram(df.filter("day < 2"), ["grp"], "value").unionByName(histogram(df.filter("day >= 2"), ["grp"], "value"))
    assert sorted(map(str, merge(parts, ["grp"]).collect())) == sorted(map(str, whole.select("grp", "bucket", "n").collect()))


def test_radix_select_is_exact(spark):
    rows, df = _data(spark)
    got = {(r.grp, r.day): r for r in radix_select(df, ["grp", "day"], "value", [0.5, 0.99]).collect()}
    for p, name in ((0.5, "p50"), (0.99, "p99")):
        want = _expected(rows, p, True)
        assert {k: got[k][name] for k in want} == want


@pytest.mark.parametrize("by", [["grp"], []])
def test_empty_input(spark, by):
    df = spark.createDataFrame([], "grp string, value double")
    assert percentiles(histogram(df, by, "value"), by, [0.5]).filter("n > 0").count() == 0
