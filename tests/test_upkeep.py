import random

from pyspark.sql import functions as F

from fernglass.functions import paths as P
from fernglass.operators import telemetry as T
from fernglass.sources import records as R
from fernglass.operators import evalstats as E
from fernglass.operators import ingest as I
from fernglass.operators import telemetry as T
from fernglass.streaming.ingest import current_snapshot, merge_into, retrying, run_available


def test_diff_and_freshness(spark):
    df = lambda rows: spark.createDataFrame(rows, "path string, mtime double")
    got = {r.path: r.state for r in I.manifest_diff(df([("a", 1.0), ("b", 1.0), ("c", 1.0)]), df([("a", 1.0), ("b", 2.0), ("d", 1.0)])).collect()}
    assert got == {"b": "stale", "c": "deleted", "d": "added"}
    f = I.freshness(df([("a", 2.0), ("n", 1.0)]), df([("a", 1.0), ("g", 1.0)]), df([("a", 1.0)])).first()
    assert (f.n_stale, f.n_unindexed, f.n_deleted, f.n_total) == (1, 1, 1, 3)


def test_signature_is_blind_to_order_and_sees_every_part(spark):
    a = spark.createDataFrame([("f", "1", "x"), ("f", "2", "y"), ("g", "1", "x")], "p string, id string, c string")
    b = spark.createDataFrame([("f", "2", "y"), ("f", "1", "x"), ("g", "1", "X")], "p string, id string, c string")
    assert [r.p for r in I.unchanged(a, b, "p", ["id", "c"]).collect()] == ["f"]


def test_incremental_equals_full(spark):
    rng = random.Random(8)
    rows = [(rng.choice("abcdef"), float(rng.randrange(5)), i, f"v{i}") for i in range(60)]
    df = lambda x: spark.createDataFrame(x, "k string, at double, n int, v string")
    full = {r.k: r.v for r in I.monotonic_merge(df(rows), df(rows[:0]), "k", "at", "n").collect()}
    state = df(rows[:0])
    for i in range(0, 60, 20):
        state = I.monotonic_merge(df([tuple(r) for r in state.collect()]), df(rows[i : i + 20]), "k", "at", "n")
    assert {r.k: r.v for r in state.collect()} == full


def test_percentiles_and_locks(spark):
    rows = [("one", 100), *[("four", v) for v in (10, 20, 30, 40)], *[("ten", v) for v in (3, 1, 4, 10, 5, 9, 2, 6, 8, 7)], ("none", None)]
    got = {r.tool_name: (r.p50_ms, r.p95_ms) for r in T.with_percentiles(spark.createDataFrame(rows, "tool_name string, duration_ms bigint"), ["tool_name"]).collect()}
    assert got == {"one": (100, 100), "four": (20, 40), "ten": (5, 10), "none": (0, 0)}
    events = spark.createDataFrame([("acquired", "i", 5, None), ("acquired", "i", 120, None), ("released", "i", None, 80), ("failed", "j", 9, None), ("failed", None, 9, None)], "kind string, caller string, wait_ms bigint, hold_ms bigint")
    locks = {r.caller: r for r in T.lock_summary(events).collect()}
    assert (locks["i"].n_acquired, locks["i"].wait_p50, locks["i"].wait_max, locks["i"].hold_p95, locks["j"].n_failed, locks["j"].hold_max) == (2, 5, 120, 80, 1, 0) and None in locks


def test_statistics(spark):
    assert E.wilcoxon_exact([1, 2, 3, 4, 5]) == (15.0, 2 / 32) and E.wilcoxon_exact([0, 0]) == (0.0, 1.0)
    m, lo, hi = E.bca_interval([float(x) for x in range(40)])
    assert lo < m < hi and E.bca_interval([2.0, 2.0]) == (2.0, 2.0, 2.0)
    df = spark.createDataFrame([("g", float(x), 3.0 * x + 1) for x in range(10)], "g string, x double, y double")
    o = E.ols(df, ["g"], "x", "y").first()
    assert abs(o.slope - 3) < 1e-9 and abs(o.intercept - 1) < 1e-9 and o.se_hc3 < 1e-6
    signs = spark.createDataFrame([("g", 1, 0)] * 8 + [("g", 0, 1)] * 2 + [("h", 1, 1)], "g string, a int, b int")
    got = {r.g: r.p for r in E.sign_test(signs, ["g"], "a", "b").collect()}
    assert abs(got["g"] - 2 * (1 + 10 + 45) / 1024) < 1e-12 and got["h"] == 1.0
    values = [1.0, 4.0, 4.0, 9.0]
    walsh = sorted((values[i] + values[j]) / 2 for i in range(4) for j in range(i, 4))
    hl = E.hodges_lehmann(spark.createDataFrame([("g", v) for v in values], "g string, v double"), ["g"], "v").first().hodges_lehmann
    assert hl == (walsh[4] + walsh[5]) / 2


def test_stream_merge_and_retry(spark, tmp_path):
    schema = "k string, at double, n int"
    for i, rows in enumerate(([("a", 1.0, 1), ("b", 5.0, 2)], [("a", 2.0, 3), ("b", 4.0, 4)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = f"file://{tmp_path}/out"
    run_available(stream, merge_into(out, "k", "at", "n"), f"file://{tmp_path}/cp")
    assert {(r.k, r.at) for r in current_snapshot(spark, out).collect()} == {("a", 2.0), ("b", 5.0)}
    tries, failed = [], []

    def broken(df, i):
        tries.append(i)
        raise ValueError

    retrying(broken, failed)(spark.range(1), 7)
    assert tries == [7, 7, 7] and failed == [7]


def test_ranking_quality(spark):
    results = spark.createDataFrame([(1, 1, "a.ts", "x", 1, 9), (1, 2, "a.ts", "y", 10, 19), (1, 3, "b.ts", "z", 1, 5)], "query_id int, rank int, file_path string, symbol string, start_line int, end_line int")
    targets = spark.createDataFrame([(1, "t1", "a.ts", "q", 12), (1, "t2", "b.ts", "z", 99), (2, "t3", "a.ts", "x", 1)], "query_id int, target_id string, file_path string, symbol string, line int")
    import math

    got = {r.query_id: r for r in E.ranking_quality(results, targets).collect()}
    want = (1 / math.log2(3) + 1 / math.log2(4)) / (1 + 1 / math.log2(3))
    assert abs(got[1].ndcg - want) < 1e-12 and got[1].rr == 0.5 and got[1].recall == 1 and got[2].ndcg == 0
    assert F is not None


def test_distributions_and_fits(spark):
    import numpy as np

    assert abs(E.t_two_sided(2.228, 10) - 0.05) < 1e-4 and abs(E.f_upper(4.96, 1, 10) - 0.05) < 2e-4 and abs(E.beta_cdf(0.5, 2, 3) - 0.6875) < 1e-12
    x = np.repeat(np.arange(10.0), 4)
    rng = np.random.default_rng(1)
    noise = rng.normal(size=40) * 0.1
    assert E.wild_cluster_p(x, 2 * x + noise, np.repeat(np.arange(10), 4), draws=500) < 0.05
    assert E.wild_cluster_p(x, noise, np.repeat(np.arange(10), 4), draws=500) > 0.05
    rows = [("line", float(a), float(2 * a + n)) for a, n in zip(x, noise, strict=True)] + [("curve", float(a), float(a * a + n)) for a, n in zip(x, noise, strict=True)]
    got = {r.g: r.p for r in E.lack_of_fit(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y").collect()}
    assert got["line"] > 0.01 and got["curve"] < 1e-6
    q = spark.createDataFrame([("src/a.ts src/b.ts",), ("src/a.ts reads",), ("",)], "q string")
    assert sorted(r.q for r in E.self_referential(q, "q", ["src/"]).collect()) == ["", "src/a.ts reads"]


def test_json_lines_count_what_they_cannot_read(spark, tmp_path):
    lines = ['{"kind":"acquired","type":"write","caller":"a","waitMs":5,"timestamp":1}', '{"kind":"released","type":"write","caller":"a","holdMs":80,"timestamp":2}', '{"kind":"failed","type":"write","waitMs":1,"timestamp":3}', "", "not json", '{"kind":"acquired","type":"w","timestamp":4}', '{"kind":"other","type":"w","timestamp":4}', '{"kind":"released","holdMs":80,"timestamp":2}', '{"kind":"acquired","type":"w","waitMs":"long","timestamp":4}']
    (tmp_path / "l.jsonl").write_text("\n".join(lines) + "\n")
    good, bad = R.read_lock_events(spark, str(tmp_path / "l.jsonl"))
    assert sorted(r.kind for r in good.collect()) == ["acquired", "failed", "released"]
    assert {r.reason: r.n_lines for r in bad.collect()} == {"not of the schema": 2, "missing field": 2, "unknown kind": 1}
    (tmp_path / "g.json").write_text('{"queries": [\n{"id": "q1", "query": "a", "relevant": [{"file_path": "x.ts", "symbol": "f", "line": 3}, {"file_path": "y.ts"}]},\n{"id": "q2", "query": "b", "relevant": []}]}')
    got = sorted((r.query_id, r.file_path or "", r.line) for r in R.read_gold(spark, str(tmp_path / "g.json")).collect())
    assert got == [("q1", "x.ts", 3), ("q1", "y.ts", None), ("q2", "", None)]
    for _ in range(2):
        R.append(good, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 6


def test_watched_paths_spans_and_ages(spark):
    paths = ["/r/a.ts", "/r/.state/a.ts", "/r/node_modules/x/a.ts", "/r/a.txt", "/q/a.ts", "/r/noext", "/r/A.TS", None]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(P.should_watch(F.col("p"), "/r", ["ts", "md"], ["**/node_modules/**"]).alias("x")).collect()
    assert [r.x for r in got] == [True, False, False, False, False, False, True, False]
    one = lambda e: spark.range(1).select(e.alias("x")).first().x
    now = F.lit(1_000_000.0)
    assert [one(T.parse_since(F.lit(t), now)) for t in ("7d", "12h", " 30 m", "1970-01-02", "soon")] == [395_200.0, 956_800.0, 998_200.0, 86_400.0, None]
    assert [one(T.format_age(F.lit(float(s)))) for s in (-3, 40, 61, 7300, 200_000)] == ["0s", "40s", "1m", "2h", "2d"]


def test_follow_on_is_the_same_however_sessions_are_cut(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, *(float(rng.randrange(400)) for _ in range(20))]), rng.choice(["search", "search", "signature", "exports", "other"])) for i in range(400)]
    calls = spark.createDataFrame(rows, "call_id bigint, session_id string, call_timestamp double, tool_name string")
    at = lambda r: (r[2] is not None, r[2] or 0.0, r[0])
    want = {}
    for r in rows:
        if r[3] == "search":
            later = [x for x in rows if x[1] == r[1] and at(x) > at(r) and x[3] in T.FOLLOW_ON]
            want[r[0]] = min(later, key=at)[0] if later else None
    for span in (1.0, 37.0, 1e9):
        assert {r.call_id: r.follow_id for r in T.follow_on(calls, span=span).collect()} == want
