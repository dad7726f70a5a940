"""Near-duplicate records by min-max hashing.

Each record becomes the set of its distinct runs of ``words`` consecutive
words, hashed. Records with the same set form a class and are handled once. A
permutation of the hash space gives two signature values per class, the
minimum and the maximum, so the hash evaluations are half of plain min-wise
hashing; two permutations (four values) make the key of one band. Classes that
share a band key are candidates, and every candidate pair is then checked on
its whole sets.

With similarity ``s`` a pair is missed with chance ``(1 - s**4) ** bands``: 1.4e-4
at s = 0.6 and 64 bands, 5e-12 at s = 0.8 with 48. Sets are kept as 32-bit
hashes of the runs; the chance that a hash collision changes a pair's overlap is
below 1e-5 for sets of a few hundred runs.

Defined results: null texts, and texts under ``min_words`` words, take part in
nothing; a text with fewer words than a run has no runs and is left out;
repeated ids are one record (the first set by hash); order of the words matters
only within runs; no cap applies to the partners of a record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fernglass.session import materialize

BANDS = 64
#: Classes that share a band key and are paired in one join cell.
CELL = 1024
WORD = "[a-z0-9_]+"


def shingle_set(text: Column, words: int, min_words: int) -> Column:
    """Sorted distinct 32-bit hashes of the runs of ``words`` words; null if there are too few words."""
    w = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))

    def runs(ws: Column) -> Column:
        run = lambda i: F.hash(*[F.get(ws, i + j) for j in range(words)])
        return F.sort_array(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(ws) - words), run)))

    # transform over a one-element array binds the words once, so they are not extracted anew for each use
    return F.get(F.transform(F.array(w), lambda ws: F.when(F.size(ws) >= max(min_words, words), runs(ws))), F.lit(0))


def set_id(runs: Column) -> Column:
    """Identity of a set, 128 bits as text."""
    return F.concat(F.hex(F.xxhash64(runs)), F.hex(F.xxhash64(F.lit(1), runs)))


def band_keys(flat: np.ndarray, starts: np.ndarray, bands: int = BANDS, seed: int = 11) -> np.ndarray:
    """Band keys (sets x bands) of the sets ``flat[starts[i] : starts[i + 1]]``, none empty."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(0, 2**63, size=(2 * bands, 2), dtype=np.uint64)
    x = flat.astype(np.uint64)
    x ^= x >> np.uint64(15)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    out = np.empty((len(starts), bands), dtype=np.int64)
    for band in range(bands):
        key = np.full(len(starts), band + 1, dtype=np.uint64)
        for a, b in factors[2 * band : 2 * band + 2]:
            h = ((x * (a | np.uint64(1)) + b) >> np.uint64(32)).astype(np.uint32)
            both = (np.minimum.reduceat(h, starts).astype(np.uint64) << np.uint64(32)) | np.maximum.reduceat(h, starts)
            key = (key ^ both) * np.uint64(0x94D049BB133111EB)
            key ^= key >> np.uint64(31)
        out[:, band] = key.view(np.int64)
    return out


def _signatures(bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = batch.column("runs")
            offsets = sets.offsets.to_numpy()
            # short slices keep the working arrays in cache
            step = 512
            for lo in range(0, len(offsets) - 1, step):
                hi = min(lo + step, len(offsets) - 1)
                flat = sets.values.slice(offsets[lo], offsets[hi] - offsets[lo]).to_numpy(zero_copy_only=False).view(np.uint32)
                keys = band_keys(flat, offsets[lo:hi] - offsets[lo], bands)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (hi - lo) * bands + 1, bands, dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("class").slice(lo, hi - lo), batch.column("n").slice(lo, hi - lo), lists], names=["class", "n", "keys"])

    return run


def classes(records: DataFrame, words: int = 5, min_words: int = 0) -> tuple[DataFrame, DataFrame]:
    """(members, sets) of ``records`` (id, text): members is (id, class), sets is (class, n, runs).

    Both are written. ``class`` is a 64-bit number unique to each distinct set.
    Equal sets combine before they are shuffled.
    """
    sets = records.select("id", shingle_set(F.col("text"), words, min_words).alias("runs")).filter("id is not null and runs is not null and size(runs) > 0")
    # read twice, and the dear part
    sets = materialize(sets.select("id", set_id(F.col("runs")).alias("set"), "runs"))
    one = sets.groupBy("set").agg(F.first("runs").alias("runs"))
    known = materialize(one.select("set", F.monotonically_increasing_id().alias("class"), F.size("runs").alias("n"), "runs"))
    members = sets.groupBy("id").agg(F.min("set").alias("set")).join(known.select("set", "class"), "set").select("id", "class")
    return materialize(members), known.drop("set")


def candidate_pairs(sets: DataFrame, threshold: float, bands: int = BANDS, cell: int = CELL) -> DataFrame:
    """Pairs (a, b; a < b) of classes that share a band key and whose sizes allow the threshold.

    Keys of one class are dropped before anything is paired. The classes of a
    key are numbered and cut into stretches of ``cell``; each stretch meets each
    in a join cell of its own, so no task pairs more than ``cell`` squared at
    once, however many classes share a key.
    """
    keys = sets.select("class", "n", "runs").mapInArrow(_signatures(bands), "class bigint, n int, keys array<bigint>")
    keys = keys.select(F.explode("keys").alias("key"), "class", "n")
    own = Window.partitionBy("key")
    stretch, most = F.floor((F.col("nth") - 1) / cell).cast("int"), F.floor((F.col("m") - 1) / cell).cast("int")
    shared = keys.select("*", F.row_number().over(own.orderBy("class")).alias("nth"), F.count("*").over(own).alias("m")).filter("m > 1")
    shared = materialize(shared.select("key", "class", "n", stretch.alias("i"), most.alias("most")))
    # classes are numbered in order, so the lesser of a pair is in the same stretch or an earlier one
    a = shared.select("key", F.col("class").alias("a"), F.col("n").alias("na"), F.col("i").alias("x"), F.explode(F.sequence("i", "most")).alias("y"))
    b = shared.select("key", F.col("class").alias("b"), F.col("n").alias("nb"), F.explode(F.sequence(F.lit(0), F.col("i"))).alias("x"), F.col("i").alias("y"))
    fits = (F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9) & (F.col("a") < F.col("b"))
    return a.join(b, ["key", "x", "y"]).filter(fits).select("a", "b").distinct()


def similar_classes(sets: DataFrame, threshold: float, bands: int = BANDS) -> DataFrame:
    """(a, b, similarity) of every pair of classes at or above the threshold, checked on whole sets."""
    pairs = candidate_pairs(sets, threshold, bands)
    left = sets.select(F.col("class").alias("a"), F.col("runs").alias("ra"))
    right = sets.select(F.col("class").alias("b"), F.col("runs").alias("rb"))
    both = F.size(F.array_intersect("ra", "rb"))
    hit = pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("i"), (F.size("ra") + F.size("rb") - both).alias("u"))
    return hit.select("a", "b", (F.col("i") / F.col("u")).alias("similarity")).filter(F.col("similarity") >= threshold)


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, group): the least id of each node's connected component.

    Alternates large-star and small-star rounds on written edge tables until
    nothing changes; each round is a few joins, and their number grows with
    the logarithm of the longest chain.
    """
    both = lambda e: e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    edges = materialize(links.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        near = both(edges)
        low = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = near.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        edges = materialize(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    roots = edges.groupBy("u").agg(F.min("v").alias("group")).withColumnRenamed("u", "id")
    return nodes.select("id").distinct().join(roots, "id", "left").select("id", F.coalesce("group", "id").alias("group"))
