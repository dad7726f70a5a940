import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from fernglass.operators import orphans as O

T0 = datetime(2025, 1, 1)


def sides(spark, children, parents):
    c = spark.createDataFrame(children, "id bigint, ref string, at timestamp").withColumn("until", F.lit("clash")).withColumn("key", F.lit("clash"))
    p = spark.createDataFrame(parents, "pid string, s timestamp, e timestamp").withColumn("at", F.lit(3))
    return [O.Reference("kids", c, F.col("id"), F.col("ref"), F.col("at"), "things")], [O.Parent("things", p, F.col("pid"), F.col("s"), F.col("e"))]


def test_orphans_match_brute_force_with_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(O, "HOT_PARTS", 4)
    rng = random.Random(2)
    at = lambda: T0 + timedelta(hours=rng.randrange(400))
    parents = []
    for k in [f"k{i}" for i in range(40)] + ["hot"]:
        for _ in range(rng.randrange(3) + (k == "hot")):
            s = at()
            parents.append((k, s, s + timedelta(hours=rng.randrange(100)) if rng.random() < 0.7 else None))
    children = [(i, rng.choice(["hot", f"k{rng.randrange(60)}"]), at()) for i in range(30_000)]
    children += children[:50] + [(90_001, None, at()), (90_002, "", at()), (90_003, "k1", None)]
    parents += [("k2", None, None), (None, T0, None)]
    want = {i for i, k, t in children if k and not any(p == k and s is not None and t is not None and s <= t and (e is None or e > t) for p, s, e in parents)}
    refs, ps = sides(spark, children, parents)
    got = O.orphan_rows(refs, ps).collect()
    assert sorted(r.row_id for r in got) == sorted(want) and {r.table_name for r in got} == {"kids"}
    assert O.orphan_report(refs, ps).agg(F.sum("n_orphans")).first()[0] == len(want)


def test_states_and_borders(spark):
    h = lambda n: T0 + timedelta(hours=n)
    refs, ps = sides(spark, [(1, "a", h(0)), (2, "a", h(5)), (3, "a", h(10)), (4, "b", h(1)), (5, "c", h(1)), (6, "a", h(12))], [("a", h(0), h(10)), ("c", h(2), None), ("a", h(12), None)])
    got = {r.row_id: r.state for r in O.resolve_references(refs, ps).collect()}
    assert got == {1: "valid", 2: "valid", 3: "deleted", 4: "missing", 5: "later", 6: "valid"}


def test_empty_tables(spark):
    refs, ps = sides(spark, [], [])
    assert O.orphan_rows(refs, ps).count() == 0 and O.orphan_report(refs, ps).count() == 0
    refs, ps = sides(spark, [(1, "a", T0)], [])
    assert O.orphan_rows(refs, ps).count() == 1
