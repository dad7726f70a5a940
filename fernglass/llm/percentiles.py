"""Percentiles of very large numeric columns by radix selection.

Every value maps to a 64-bit integer that sorts like the value. A histogram of
the leading bits of these integers, with counts per group and day, is the
daily result: it merges by adding counts. A percentile is found by following
digits: the counts of the first digit tell which digit holds the target rank,
only that digit's buckets are split further, and so on. Values are handled as
doubles: integers beyond 2**53 are those nearest to them.

Stated error: with ``bits`` leading bits kept (12 of them sign and exponent) a
bucket spans at most ``2**(12-bits)`` of its lower bound, and the middle of the
bucket is returned, so the relative error is at most ``2**(11-bits)``
(``bits=21``: 0.098 %). ``radix_select`` follows all 64 bits and is exact.

Defined results: null and NaN values are not counted; a group without values
gives no row; infinities sort at the ends; ties share a bucket; a null group
is a group; percentiles use the nearest rank ``ceil(p * n)``; input columns
not named are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fernglass.session import materialize

SIGN_EXPONENT = 12
BITS = 21


def order_key(value: Column) -> Column:
    """64-bit integer in the order of the double ``value``: its IEEE bits, negatives mirrored.

    Spark has no cast from double to its bits, so exponent and mantissa are
    taken apart with exact powers of two. -0.0 equals 0.0.
    """
    v = value.cast("double")
    a = F.abs(v)
    two = lambda e: F.pow(F.lit(2.0), e)
    e0 = F.least(F.greatest(F.floor(F.log2(a)), F.lit(-1022)), F.lit(1023)).cast("double")
    # log2 may round across a power of two
    e = F.when(a < two(e0), F.greatest(e0 - 1, F.lit(-1022.0))).when((e0 < 1023) & (a / two(e0) >= 2), e0 + 1).otherwise(e0)
    normal = F.shiftleft((e + 1023).cast("bigint"), 52) + ((a / two(e) - 1) * F.lit(2.0**52)).cast("bigint")
    tiny = (a * F.lit(2.0**537) * F.lit(2.0**537)).cast("bigint")
    bits = F.when(a == float("inf"), F.lit(2047 << 52)).when(a < F.lit(2.0**-1022), tiny).otherwise(normal)
    return F.when(v.isNull() | F.isnan(v), F.lit(None).cast("bigint")).when(v < 0, -bits - 1).otherwise(bits)


def from_order_key(key: Column) -> Column:
    bits = F.when(key < 0, -key - 1).otherwise(key)
    e = F.shiftright(bits, 52)
    m = bits.bitwiseAND(F.lit((1 << 52) - 1)).cast("double") / F.lit(2.0**52)
    size = F.when(e == 2047, F.lit(float("inf"))).when(e == 0, m * F.lit(2.0**-1022)).otherwise((1 + m) * F.pow(F.lit(2.0), (e - 1023).cast("double")))
    return F.when(key < 0, -size).otherwise(size)


def histogram(rows: DataFrame, by: list[str], value: str, bits: int = BITS) -> DataFrame:
    """Counts per group and leading ``bits`` of the order key: (*by, bucket, n). Combines before it shuffles."""
    key = order_key(F.col(value))
    return rows.select(*by, F.shiftright(key, 64 - bits).alias("bucket")).filter("bucket is not null").groupBy(*by, "bucket").agg(F.count("*").alias("n"))


def merge(histograms: DataFrame, by: list[str]) -> DataFrame:
    """Add histograms over whatever of their groups is not in ``by`` (days, partitions)."""
    return histograms.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))


def _inside(rows: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    """Rows whose ``digit`` is the one followed for their group, once per target."""
    t = targets.select(*[F.col(c).alias(f"of {i}") for i, c in enumerate(by)], F.col("bucket").alias("followed"), "p", "rank", "total")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"of {i}")) for i, c in enumerate(by)], F.col("digit") == F.col("followed"))
    return rows.join(t, same).drop("followed", *[f"of {i}" for i in range(len(by))])


def _follow(counts: DataFrame, targets: DataFrame | None, by: list[str], ps: list[float]) -> DataFrame:
    """The digit that holds each target rank: (*by, p, rank within the digit, bucket, total)."""
    w = Window.partitionBy(*by).orderBy("bucket") if by else Window.orderBy("bucket")
    if targets is None:
        every = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        c = counts.select("*", F.sum("n").over(every).alias("total"), F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
        c = c.select("*", F.explode(F.array([F.lit(p) for p in ps])).alias("p")).withColumn("rank", F.ceil(F.col("p") * F.col("total") - 1e-9).cast("bigint"))
        c = c.withColumn("rank", F.greatest(F.col("rank"), F.lit(1)))
    else:
        c = counts.withColumn("upto", F.sum("n").over(Window.partitionBy(*by, "p").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
    return c.filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank"))).select(*by, "p", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "bucket", "total")


def _wide(found: DataFrame, by: list[str], ps: list[float], value: Column) -> DataFrame:
    name = lambda p: f"p{p * 100:g}".replace(".", "_")
    picked = [F.max(F.when(F.col("p") == p, value)).alias(name(p)) for p in ps]
    return found.groupBy(*by).agg(F.max("total").alias("n"), *picked)


def percentiles(histograms: DataFrame, by: list[str], ps: list[float], bits: int = BITS) -> DataFrame:
    """Percentiles within the stated error from (merged) histograms alone: (*by, n, p50, ...). They are read twice, so should be a written table.

    Follows two digits: sign and exponent (at most 4,096 counts a group), then
    the kept mantissa bits of the one exponent that holds the rank.
    """
    low = bits - SIGN_EXPONENT
    merged = merge(histograms, by)
    first = merged.groupBy(*by, F.shiftright("bucket", low).alias("digit")).agg(F.sum("n").alias("n")).withColumnRenamed("digit", "bucket")
    t = _follow(first, None, by, ps)
    found = _follow(_inside(merged.withColumn("digit", F.shiftright("bucket", low)), t, by), t, by, ps)
    half = F.shiftleft("bucket", 64 - bits) + F.lit(1 << (63 - bits))
    middle = F.when(F.col("bucket") == 0, F.lit(0.0)).otherwise(from_order_key(half))
    return _wide(found, by, ps, middle)


def radix_select(rows: DataFrame, by: list[str], value: str, ps: list[float], digits: tuple[int, ...] = (12, 14, 14, 12, 12)) -> DataFrame:
    """Exact percentiles: one pass over the rows per digit, keeping only rows in the followed digit.

    Each pass counts with map-side combination; rows never gather by group.
    The targets (groups times percentiles) are written before each pass, so
    Spark broadcasts them only when their measured size is below its threshold.
    """
    keys = rows.select(*by, order_key(F.col(value)).alias("key")).filter("key is not null")
    used, targets = 0, None
    for d in digits:
        used += d
        bucket = F.shiftright(F.col("key"), 64 - used)
        if targets is None:
            t = _follow(keys.groupBy(*by, bucket.alias("bucket")).agg(F.count("*").alias("n")), None, by, ps)
        else:
            hit = _inside(keys.withColumn("digit", F.shiftright("key", 64 - used + d)), targets, by)
            t = _follow(hit.groupBy(*by, "p", "rank", "total", bucket.alias("bucket")).agg(F.count("*").alias("n")), targets, by, ps)
        targets = materialize(t)
    return _wide(targets, by, ps, from_order_key(F.col("bucket")))
