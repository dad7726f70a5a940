"""Ranking quality and scaling statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernglass.operators import evalstats as E
from fernglass.operators import search as S
from fernglass.operators.chunks import once
from fernglass.plans.code_search import ASKED, _rankers, chunks
from fernglass.plans.telemetry_reports import _DAY, _M, calls
from fernglass.session import materialize, table
from fernglass.operators.telemetry import day_of


def _results(spark: SparkSession, sf: str) -> DataFrame:
    """Functions of a file by length: a ranking whose targets are known."""
    c = chunks(spark, sf).filter("chunk_type in ('function', 'method')").withColumn("query_id", F.col("file_path"))
    ranked = S.top(c, 10, F.desc(F.length("content")), F.asc("chunk_id"))
    return ranked.select("query_id", "rank", "file_path", F.col("symbol_name").alias("symbol"), "start_line", F.col("start_line").alias("end_line"))


def _targets(spark: SparkSession, sf: str) -> DataFrame:
    s = once(table(spark, sf, "symbols").filter("deleted_at is null and is_exported and kind in ('function', 'method')").select("symbol_id", "name", "file_path", "line"), "symbol_id")
    return s.select(F.col("file_path").alias("query_id"), F.col("symbol_id").alias("target_id"), "file_path", F.col("name").alias("symbol"), "line")


def ndcg_at_10(spark: SparkSession, sf: str) -> DataFrame:
    q = E.ranking_quality(_results(spark, sf), _targets(spark, sf))
    return q.select("query_id", *[F.round(c, 9).alias(c) for c in ("ndcg", "recall", "rr")])


def _asked_targets(spark: SparkSession, sf: str) -> DataFrame:
    """What the queries ask for: the symbols whose name, or its last segment, they hold."""
    s = once(table(spark, sf, "symbols").filter("deleted_at is null").select("symbol_id", "name", "file_path", "line"), "symbol_id")
    words = spark.createDataFrame([(q, w.lower()) for q, text in ASKED for w in S.name_terms(text)], "query_id int, word string").distinct()
    named = s.withColumn("word", F.explode(F.array_distinct(F.array(F.lower("name"), F.lower(F.substring_index("name", ".", -1))))))
    # a few words of the fixed queries
    return named.join(F.broadcast(words), "word").select("query_id", F.col("symbol_id").alias("target_id"), "file_path", F.col("name").alias("symbol"), "line").distinct()


def rrf_k_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Quality at 10 of the fused BM25 and declared-name rankings, with the windows of the fused search, under each constant."""
    lexical, names = (materialize(r) for r in _rankers(spark, sf))
    at = chunks(spark, sf).select("chunk_id", "file_path", F.col("symbol_name").alias("symbol"), "start_line", F.col("start_line").alias("end_line"))
    fused = [S.top(S.fuse(lexical, names, k), 10, *S.fused_order()).select(F.lit(k).alias("k"), "query_id", "rank", "chunk_id") for k in E.RRF_SWEEP]
    ranked = reduce(lambda a, b: a.unionByName(b), fused).join(at, "chunk_id")
    ks = F.explode(F.array(*[F.lit(k) for k in E.RRF_SWEEP])).alias("k")
    targets = materialize(_asked_targets(spark, sf)).select("*", ks)
    # one ranking per query and constant
    both = F.struct("k", "query_id")
    q = E.ranking_quality(ranked.withColumn("query_id", both), targets.withColumn("query_id", both))
    return q.select("query_id.k", "query_id.query_id", *[F.round(c, 9).alias(c) for c in ("ndcg", "recall", "rr")])


def ols_slope(spark: SparkSession, sf: str) -> DataFrame:
    rows = calls(spark, sf).filter("duration_ms > 0 and tokens_returned > 0").select("tool_name", F.log("tokens_returned").alias("x"), F.log("duration_ms").alias("y"))
    out = E.ols(rows, ["tool_name"], "x", "y")
    return out.select("tool_name", "n", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2", "se_hc3")])


def paired_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = E.paired(calls(spark, sf), ["tool_name"], "tokens_full_file_upper_bound", "tokens_returned")
    return out.select("tool_name", "n", *[F.round(c, 4).alias(c) for c in ("mean", "sd", "se", "t")])


def _daily_medians(spark: SparkSession, sf: str) -> DataFrame:
    return calls(spark, sf).filter("duration_ms >= 0").groupBy("tool_name", day_of(F.col("call_timestamp")).alias("day")).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY duration_ms)").alias("v"))


def walsh_median(spark: SparkSession, sf: str) -> DataFrame:
    return E.hodges_lehmann(_daily_medians(spark, sf), ["tool_name"], "v")


def sign_test(spark: SparkSession, sf: str) -> DataFrame:
    rows = _daily_medians(spark, sf).withColumn("a", F.col("v")).withColumn("b", F.lit(40))
    return E.sign_test(rows, ["tool_name"], "a", "b").select("tool_name", "wins", "losses", F.round("p", 9).alias("p"))


def fire_rate(spark: SparkSession, sf: str) -> DataFrame:
    return calls(spark, sf).groupBy("tool_name").agg(F.round(F.avg((F.col("status") == "ok").cast("int")), 9).alias("rate"), F.count("*").alias("n"))


def signed_rank_and_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return E.per_group(_daily_medians(spark, sf), "tool_name", "v")


def seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    return E.seeded_sample(table(spark, sf, "files").select("file_id", "path"), "file_id", 100)


def index_invariant(spark: SparkSession, sf: str) -> DataFrame:
    """Each chunk with content is in the identifier index once; counts must agree."""
    c = chunks(spark, sf)
    bags = c.filter(F.col("content").rlike(r"[A-Za-z_$]")).select("chunk_id").distinct()
    return c.agg(F.count("*").alias("n_chunks")).crossJoin(bags.agg(F.count("*").alias("n_indexed")))  # one row each


def lack_of_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Whether call durations depend on the hour of day by more than a line."""
    rows = calls(spark, sf).filter("duration_ms > 0").select("tool_name", F.hour(F.timestamp_seconds("call_timestamp")).alias("x"), F.log("duration_ms").alias("y"))
    return E.lack_of_fit(rows, ["tool_name"], "x", "y").select("tool_name", "n", "k", F.round("f", 6).alias("f"), F.round("p", 6).alias("p"))


_DM = f"WITH {_M}, dm AS (SELECT tool_name, {_DAY} AS day, quantile_disc(duration_ms, 0.5) AS v FROM m WHERE duration_ms >= 0 GROUP BY 1, 2)"
QUERIES = {f.__name__: f for f in (ndcg_at_10, rrf_k_sweep, ols_slope, paired_stats, walsh_median, sign_test, fire_rate, lack_of_fit, signed_rank_and_bootstrap, seeded_sample, index_invariant)}
ORACLE = {
    # each tool's daily medians against the fixed 40: wins, losses and the two-sided binomial tail
    "sign_test": f"""WITH {_M}, d AS (SELECT tool_name, {_DAY} AS day, quantile_disc(duration_ms, 0.5) AS v FROM m WHERE duration_ms >= 0 GROUP BY 1, 2),
  c AS (SELECT tool_name, count(*) FILTER (WHERE v > 40) AS wins, count(*) FILTER (WHERE v < 40) AS losses FROM d GROUP BY 1)
  SELECT tool_name, wins, losses, round(CASE WHEN wins + losses = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, least(wins, losses) + 1), lambda i: exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2))))) END, 9) AS p FROM c""",
    "ndcg_at_10": """WITH k AS (SELECT chunk_id, arg_max(struct_pack(p := file_path, l := start_line, n := symbol_name, t := chunk_type, c := length(content)), file_mtime) AS s FROM chunks GROUP BY 1),
  r AS (SELECT s.p AS q, s.n AS symbol, s.l AS l, row_number() OVER (PARTITION BY s.p ORDER BY s.c DESC, chunk_id) AS rank FROM k WHERE s.t IN ('function', 'method')),
  t AS (SELECT DISTINCT symbol_id, name, file_path AS q, line FROM symbols WHERE deleted_at IS NULL AND is_exported AND kind IN ('function', 'method')),
  h AS (SELECT t.q, symbol_id, min(rank) AS rank FROM r JOIN t ON r.q = t.q AND rank <= 10 AND (r.symbol = t.name OR r.l = t.line) GROUP BY 1, 2), o AS (SELECT DISTINCT q, rank FROM h),
  g AS (SELECT q, sum(1 / log2(rank + 1)) AS dcg, count(*) AS n, min(rank) AS first FROM o GROUP BY 1), w AS (SELECT q, count(DISTINCT symbol_id) AS nt FROM t GROUP BY 1)
  SELECT q AS query_id, round(coalesce(dcg / list_sum(list_transform(range(1, least(nt, 10) + 1), lambda i: 1 / log2(i + 1))), 0), 9) AS ndcg, round(coalesce(n::DOUBLE / nt, 0), 9) AS recall, round(coalesce(1.0::DOUBLE / first, 0), 9) AS rr FROM w LEFT JOIN g USING (q)""",
    "ols_slope": f"""WITH {_M}, x AS (SELECT tool_name, ln(tokens_returned) AS x, ln(duration_ms) AS y FROM m WHERE duration_ms > 0 AND tokens_returned > 0),
  f AS (SELECT tool_name, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2, avg(x) AS mx, regr_sxx(y, x) AS sxx FROM x GROUP BY 1)
  SELECT tool_name, n, round(any_value(b), 6) AS slope, round(any_value(a), 6) AS intercept, round(any_value(r2), 6) AS r2, round(sqrt(sum((x - mx) ** 2 * (y - a - b * x) ** 2 / (1 - 1.0 / n - (x - mx) ** 2 / sxx) ** 2)) / any_value(sxx), 6) AS se_hc3 FROM x JOIN f USING (tool_name) GROUP BY tool_name, n""",
    "paired_stats": f"WITH {_M}, d AS (SELECT tool_name, (tokens_full_file_upper_bound - tokens_returned)::DOUBLE AS d FROM m) SELECT tool_name, count(d) AS n, round(avg(d), 4) AS mean, round(stddev_samp(d), 4) AS sd, round(stddev_samp(d) / sqrt(count(d)), 4) AS se, round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 4) AS t FROM d GROUP BY 1",
    "walsh_median": f"{_DM}, r AS (SELECT tool_name, v, row_number() OVER (PARTITION BY tool_name ORDER BY v) AS i FROM dm) SELECT a.tool_name, quantile_cont((a.v + b.v) / 2.0::DOUBLE, 0.5) AS hodges_lehmann FROM r a JOIN r b ON a.tool_name = b.tool_name AND a.i <= b.i GROUP BY 1",
    "fire_rate": f"WITH {_M} SELECT tool_name, round(avg((status = 'ok')::INT), 9) AS rate, count(*) AS n FROM m GROUP BY 1",
    "index_invariant": "SELECT count(DISTINCT chunk_id) AS n_chunks, (SELECT count(*) FROM (SELECT chunk_id, arg_max(content, file_mtime) AS c FROM chunks GROUP BY 1) WHERE regexp_matches(c, '[A-Za-z_$]')) AS n_indexed FROM chunks",
}
