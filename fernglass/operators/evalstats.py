"""Statistics used to judge rankings and scaling."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Reciprocal-rank constants of a fusion sweep: fixed values.
RRF_SWEEP = [0, 1, 2, 5, 10, 20, 40, 60, 120]


def match_targets(results: DataFrame, targets: DataFrame) -> DataFrame:
    """(query_id, target_id, rank): first rank that hits each target, by file and by symbol or a line within the result.

    ``results``: query_id, rank, file_path, symbol, start_line, end_line.
    ``targets``: query_id, target_id, file_path, symbol, line.
    """
    r, t = results.alias("r"), targets.alias("t")
    same = (F.col("r.query_id") == F.col("t.query_id")) & (F.col("r.file_path") == F.col("t.file_path")) & ((F.col("r.symbol") == F.col("t.symbol")) | F.col("t.line").between(F.col("r.start_line"), F.col("r.end_line")))
    return r.join(t, same).groupBy("t.query_id", "t.target_id").agg(F.min("r.rank").alias("rank"))


def ranking_quality(results: DataFrame, targets: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg, recall, rr) at ``k`` with binary gain; a result counts for one target only."""
    hits = match_targets(results.filter(F.col("rank") <= k), targets)
    once = hits.groupBy("query_id", "rank").agg(F.min("target_id").alias("target_id"))
    got = once.groupBy("query_id").agg(F.sum(1.0 / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.count("*").alias("n"), F.min("rank").alias("first"))
    want = targets.groupBy("query_id").agg(F.countDistinct("target_id").alias("n_targets"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_targets", F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    rows = want.join(got, "query_id", "left")
    return rows.select("query_id", F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg"), F.coalesce(F.col("n") / F.col("n_targets"), F.lit(0.0)).alias("recall"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"))


def ols(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Slope, intercept, r2 and the HC3 standard error of the slope, from sums alone."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    fit = rows.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    fit = fit.select("*", F.regr_slope("y", "x").over(w).alias("slope"), F.regr_intercept("y", "x").over(w).alias("icept"), F.avg("x").over(w).alias("mx"), F.regr_sxx("y", "x").over(w).alias("sxx"), F.count("*").over(w).alias("n"))
    h = 1.0 / F.col("n") + (F.col("x") - F.col("mx")) ** 2 / F.col("sxx")
    e = F.col("y") - F.col("icept") - F.col("slope") * F.col("x")
    term = (F.col("x") - F.col("mx")) ** 2 * e**2 / (1.0 - h) ** 2
    out = fit.groupBy(*by).agg(F.count("*").alias("n"), F.first("slope").alias("slope"), F.first("icept").alias("intercept"), F.regr_r2("y", "x").alias("r2"), F.sum(term).alias("m"), F.first("sxx").alias("sxx"))
    return out.select(*by, "n", "slope", "intercept", "r2", (F.sqrt("m") / F.col("sxx")).alias("se_hc3"))


def paired(rows: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Mean difference, its standard deviation and error, and t of pairs (a, b) per group."""
    d = F.col(a).cast("double") - F.col(b).cast("double")
    out = rows.select(*by, d.alias("d")).dropna().groupBy(*by).agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"))
    return out.withColumn("se", F.col("sd") / F.sqrt("n")).withColumn("t", F.when(F.col("se") > 0, F.col("mean") / F.col("se")))


def hodges_lehmann(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median of the Walsh averages (x_i + x_j) / 2, i <= j, of each group's distinct differences with their weights.

    Equal values are counted, not repeated, so pairs are of distinct values.
    """
    v = rows.groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c")).dropna(subset=["v"])
    a, b = v.select(*by, F.col("v").alias("x"), F.col("c").alias("cx")), v.select(*by, F.col("v").alias("y"), F.col("c").alias("cy"))
    pairs = a.join(b, by).filter("x <= y")
    n = F.when(F.col("x") == F.col("y"), F.col("cx") * (F.col("cx") + 1) / 2).otherwise(F.col("cx") * F.col("cy")).cast("bigint")
    return pairs.select(*by, ((F.col("x") + F.col("y")) / 2).alias("w"), n.alias("n")).groupBy(*by).agg(F.expr("percentile(w, 0.5, n)").alias("hodges_lehmann"))


def sign_test(rows: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Exact two-sided sign (McNemar) test of wins against losses."""
    c = rows.groupBy(*by).agg(F.count_if(F.col(a) > F.col(b)).alias("wins"), F.count_if(F.col(a) < F.col(b)).alias("losses"))
    n, m = F.col("wins") + F.col("losses"), F.least("wins", "losses")
    choose = F.expr("aggregate(sequence(1, greatest(least(wins, losses), 1)), named_struct('c', 1.0D, 's', 1.0D), (z, i) -> named_struct('c', z.c * (wins + losses - i + 1) / i, 's', z.s + IF(i <= least(wins, losses), z.c * (wins + losses - i + 1) / i, 0.0D)), z -> z.s)")
    return c.withColumn("p", F.when(n > 0, F.least(F.lit(1.0), 2 * choose * F.pow(F.lit(0.5), n))).otherwise(1.0)).drop("m")


def wilcoxon_exact(diffs: list[float]) -> tuple[float, float]:
    """(W+, two-sided p) of the signed-rank test; zeros dropped, ties at mid-ranks, exact null distribution of doubled ranks."""
    d = [x for x in diffs if x == x and x != 0]
    if not d:
        return 0.0, 1.0
    # twice the mid-rank of each size: all that are smaller count double, those as large once, and one
    sizes, at, ties = np.unique(np.abs(d), return_inverse=True, return_counts=True)
    smaller = np.cumsum(ties) - ties
    ranks2 = [int(x) for x in (2 * smaller + ties + 1)[at]]
    w2, total = sum(r for r, x in zip(ranks2, d, strict=True) if x > 0), sum(ranks2)
    ways = np.zeros(total + 1)
    ways[0] = 1.0
    for r in ranks2:
        ways[r:] = ways[r:] + ways[: total + 1 - r]
    low = min(w2, total - w2)
    return w2 / 2, min(1.0, 2 * float(ways[: low + 1].sum() / ways.sum()))


def bca_interval(values: list[float], *, draws: int = 10_000, seed: int = 811, level: float = 0.95) -> tuple[float, float, float]:
    """(mean, low, high): bias-corrected and accelerated bootstrap of the mean."""
    x = np.asarray([v for v in values if v == v], dtype=float)
    if len(x) < 2 or np.all(x == x[0]):
        m = float(x.mean()) if len(x) else 0.0
        return m, m, m
    rng, nd = np.random.default_rng(seed), NormalDist()
    means = np.sort(np.array([x[rng.integers(0, len(x), len(x))].mean() for _ in range(draws)]))
    below = min(max((means < x.mean()).mean(), 1 / draws), 1 - 1 / draws)
    z0 = nd.inv_cdf(float(below))
    jack = (x.sum() - x) / (len(x) - 1)
    d = jack.mean() - jack
    acc = float((d**3).sum() / (6 * ((d**2).sum() ** 1.5))) if (d**2).sum() > 0 else 0.0

    def at(q: float) -> float:
        z = z0 + nd.inv_cdf(q)
        return float(means[min(draws - 1, max(0, int(math.floor(nd.cdf(z0 + z / (1 - acc * z)) * draws))))])

    return float(x.mean()), at((1 - level) / 2), at(1 - (1 - level) / 2)


def per_group(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Signed-rank test and bootstrap interval of the daily means of each group (as many values as there are days)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf["v"].tolist()
        w, p = wilcoxon_exact([x - float(np.median(v)) for x in v])
        m, lo, hi = bca_interval(v)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "n": [len(v)], "w_plus": [w], "p": [p], "mean": [m], "low": [lo], "high": [hi]})

    return rows.select(by, F.col(value).cast("double").alias("v")).dropna().groupBy(by).applyInPandas(run, f"{by} string, n bigint, w_plus double, p double, mean double, low double, high double")


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """``n`` rows by a seeded hash of their key: the same at any partitioning."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            step = c * d
            out *= step
        if abs(step - 1) < 1e-14:
            break
    return front * out


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def f_upper(f: float, df1: float, df2: float) -> float:
    return beta_cdf(df2 / (df2 + df1 * f), df2 / 2, df1 / 2) if f > 0 else 1.0


def lack_of_fit(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """F test of a straight line against free means at each distinct x, from group sums; p is computed on the few result rows."""
    r = rows.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    level = r.groupBy(*by, "x").agg(F.count("*").alias("n"), F.avg("y").alias("m"), (F.var_pop("y") * F.count("*")).alias("pure"))
    line = r.groupBy(*by).agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"))
    both = level.join(line, by).groupBy(*by).agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("pure").alias("pure"), F.sum(F.col("n") * (F.col("m") - F.col("a") - F.col("b") * F.col("x")) ** 2).alias("lack"))
    both = both.filter("k > 2 and n > k and pure > 0").withColumn("f", (F.col("lack") / (F.col("k") - 2)) / (F.col("pure") / (F.col("n") - F.col("k"))))

    @F.pandas_udf("double")
    def p(f: pd.Series, k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([f_upper(a, b - 2, c - b) for a, b, c in zip(f, k, n, strict=True)])

    return both.select(*by, "n", "k", "f", p("f", "k", "n").alias("p"))


#: Webb's six-point weights: fixed values.
WEBB = [-math.sqrt(1.5), -1.0, -math.sqrt(0.5), math.sqrt(0.5), 1.0, math.sqrt(1.5)]


def wild_cluster_p(x: np.ndarray, y: np.ndarray, cluster: np.ndarray, *, slope0: float = 0.0, draws: int = 10_000, seed: int = 811) -> float:
    """Two-sided wild cluster bootstrap p of slope = slope0, residuals of the restricted fit, one Webb weight per cluster."""
    names, at = np.unique(cluster, return_inverse=True)
    dx = x - x.mean()
    sxx = float((dx**2).sum())
    if sxx == 0 or len(names) < 2:
        return 1.0

    def t_of(values: np.ndarray) -> np.ndarray:
        centred = values - values.mean(axis=-1, keepdims=True)
        b = centred @ dx / sxx
        e = centred - b[..., None] * dx
        score = np.stack([(e[..., at == g] * dx[at == g]).sum(axis=-1) for g in range(len(names))], axis=-1)
        se = np.sqrt((score**2).sum(axis=-1)) / sxx
        return (b - slope0) / np.where(se > 0, se, np.inf)

    fitted = slope0 * x + (y - slope0 * x).mean()
    residual, rng = y - fitted, np.random.default_rng(seed)
    weights = np.array(WEBB)[rng.integers(0, 6, size=(draws, len(names)))]
    stat = np.concatenate([t_of(fitted + residual * w[:, at]) for w in np.array_split(weights, max(1, draws // 500))])
    return float((np.abs(stat) >= abs(float(t_of(y[None, :])[0])) - 1e-12).mean())


def self_referential(queries: DataFrame, query: str, own_paths: list[str]) -> DataFrame:
    """Queries without those that only name the project's own files."""
    words = F.filter(F.split(F.col(query), r"\s+"), lambda w: w != "")
    own = F.forall(words, lambda w: F.lit(False) if not own_paths else _any_prefix(w, own_paths))
    return queries.filter(~((F.size(words) > 0) & own))


def _any_prefix(word, paths: list[str]):
    out = F.lit(False)
    for p in paths:
        out = out | word.startswith(p)
    return out
