"""Filling fixed-capacity containers: bounded-space online best-fit.

Items arrive in lanes of about ``lane_size`` units each, by a hash of their id,
so lanes are alike whatever the order or skew of the input and each is packed
by one task while it streams past. A lane keeps at most ``open_bins`` bins open.
Their free spaces form a bitset (bit f set: some open bin has f units free), so
the best fit for an item of size s is the lowest set bit at or above s. When
nothing fits and all bins are in use, the fullest one is closed.

Defined results: an item larger than the capacity fills whole containers of
its own and only its remainder is packed; items of size 0 or null size go to
an open bin and take no space; a capacity below 1 is an error; repeated items
are packed as often as they occur; no items give no containers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN_BINS = 64
LANE_SIZE = 4_000_000
PACKED = "container string, lane bigint, bin int, item_id bigint, piece int, size bigint, start bigint"


class BestFit:
    """Packer of one lane for one capacity."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS):
        if capacity < 1:
            raise ValueError("capacity must be at least 1")
        self.capacity, self.most = capacity, open_bins
        self.bits, self.open, self.by_free, self.bins = 0, 0, {}, 0

    def _new(self) -> int:
        self.bins += 1
        return self.bins - 1

    def _take(self, free: int) -> int:
        ids = self.by_free[free]
        out = ids.pop()
        if not ids:
            self.bits &= ~(1 << free)
        self.open -= 1
        return out

    def _keep(self, bin_id: int, free: int) -> None:
        if free > 0:
            self.by_free.setdefault(free, []).append(bin_id)
            self.bits |= 1 << free
            self.open += 1

    def add(self, size: int) -> list[tuple[int, int, int, int]]:
        """Place one item: (bin, piece, size, start) for each of its pieces."""
        out, start = [], 0
        if size > self.capacity:
            while size - start >= self.capacity:
                out.append((self._new(), len(out), self.capacity, start))
                start += self.capacity
            if start == size:
                return out
        rest = size - start
        fits = self.bits >> rest
        if fits:
            free = rest + (fits & -fits).bit_length() - 1
            bin_id = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            bin_id, free = self._new(), self.capacity
        self._keep(bin_id, free - rest)
        out.append((bin_id, len(out), rest, start))
        return out


def pack(items: DataFrame, capacities: dict[str, int], *, open_bins: int = OPEN_BINS, lane_size: int = LANE_SIZE) -> DataFrame:
    """Pack ``items`` (item_id bigint, size bigint) into containers of every capacity.

    ``items`` is read twice (once for the total that sets the number of lanes),
    so it should be a written table. Only ids and sizes are shuffled.
    """
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.greatest(F.coalesce(F.col("size").cast("bigint"), F.lit(0)), F.lit(0)).alias("size"))
    total = items.agg(F.sum(F.col("size") + 1)).first()[0] or 0
    lanes = max(1, -(-total // lane_size))
    order = F.xxhash64(F.col("item_id"))
    spread = items.select("*", F.pmod(order, F.lit(lanes)).alias("lane"), order.alias("o"))
    parts = min(lanes, max(items.sparkSession.sparkContext.defaultParallelism, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    # lanes are dealt out in turn: a hash of their numbers would leave some tasks without any
    spread = spread.repartitionById(parts, F.pmod("lane", F.lit(parts)).cast("int")).sortWithinPartitions("lane", "o", "item_id", "size")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lane, packers = None, {}
        for pdf in batches:
            rows = []
            for item_id, size, at in zip(pdf.item_id.array, pdf["size"].array, pdf.lane.array, strict=True):
                if at != lane:
                    lane, packers = at, {k: BestFit(c, open_bins) for k, c in capacities.items()}
                item_id = None if pd.isna(item_id) else int(item_id)
                for name, p in packers.items():
                    rows += [(name, lane, b, item_id, piece, n, start) for b, piece, n, start in p.add(int(size))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PACKED.split(", ")]).astype({"item_id": "Int64"})

    return spread.select("item_id", "size", "lane").mapInPandas(run, PACKED)


def fill_report(packed: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """Per container kind: bins used, the least possible number, and the share of space filled."""
    capacity = F.create_map(*[F.lit(x) for kv in capacities.items() for x in kv])
    bins = packed.groupBy("container", "lane", "bin").agg(F.sum("size").alias("used"), F.count("*").alias("pieces"))
    out = bins.groupBy("container").agg(F.count("*").alias("n_bins"), F.sum("used").alias("n_tokens"), F.sum("pieces").alias("n_pieces"), F.max("used").alias("max_used"))
    out = out.withColumn("capacity", capacity[F.col("container")])
    return out.select("*", F.ceil(F.col("n_tokens") / F.col("capacity")).alias("least_bins"), (F.col("n_tokens") / (F.col("n_bins") * F.col("capacity"))).alias("fill"))
