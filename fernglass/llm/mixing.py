"""Mixing sources to target weights: Pfair block scheduling.

The mix is as large as the scarcest source allows: the total T is the least of
``max_repeats * available / share`` over the sources that have any tokens, the
shares taken relative to those sources. Each source's drawn documents are laid
end to end in hash order, pass after pass, and form blocks: a block is the
documents that begin in one stretch of T / ``BLOCKS`` tokens, so it is at least
one whole document, and there are at most ``BLOCKS`` blocks and one a source.
A block that takes the tokens from ``a`` to ``b`` of a source of weight ``w`` is
released at ``a / w`` tokens of the mix and due at ``b / w``; the mix takes the
block of earliest deadline among those released. So at any point of the mix,
within blocks too, no source is a whole block ahead of or behind its share of
what has been drawn, where a block is the longest of the schedule.

Defined results: sources without documents, and sources without a positive
target, are left out and reported with share 0; documents of unknown sources
are not drawn; a null text has no tokens; repeated rows are separate
documents; the last, partial pass takes documents up to the one nearest to
the target, so a source's total deviates by at most half a document from its
target.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fernglass.session import materialize

#: Stretches the mix is cut into, whatever the size of the corpus; with more documents than that, a block holds many.
BLOCKS = 1 << 14
#: Rows a prefix-sum bucket should hold.
BUCKET_ROWS = 20_000


@dataclass
class Plan:
    """What is drawn of one source."""

    source: str
    weight: float
    available: int
    max_repeats: int
    need: int
    full: int
    rest: int


def plan_mix(available: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> list[Plan]:
    live = {s: t for s, t in targets.items() if available.get(s, 0) > 0 and t[0] > 0 and t[1] > 0}
    share = sum(t[0] for t in live.values())
    if not live:
        return []
    most = min(available[s] * r / (w / share) for s, (w, r) in live.items())
    most = most if total is None else min(most, total)
    out = []
    for s, (w, r) in sorted(live.items()):
        need = min(int(round(most * w / share)), r * available[s])
        out.append(Plan(s, w / share, available[s], r, need, need // available[s], need % available[s]))
    return out


def schedule(blocks: dict[str, list[int]]) -> list[tuple[str, int]]:
    """(source, index) of every block in the order of the mix: earliest deadline first among released blocks.

    ``blocks`` has the tokens of each source's blocks in order; a source's weight is its part of all tokens.
    """
    total = {s: sum(b) for s, b in blocks.items()}
    every = sum(total.values())
    waiting, ready, out, now = [], [], [], 0
    ends = dict.fromkeys(blocks, 0)

    def release(s: str, i: int) -> None:
        """Times in tokens of the mix; a source of empty documents is due at once."""
        begin, ends[s] = ends[s], ends[s] + blocks[s][i]
        pace = every / total[s] if total[s] else 0.0
        heapq.heappush(waiting, (begin * pace, s, i, ends[s] * pace))

    for s in sorted(blocks):
        if blocks[s]:
            release(s, 0)
    while waiting or ready:
        while waiting and (waiting[0][0] <= now + 1e-6 or not ready):
            _, s, i, due = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s, i))
        _, s, i = heapq.heappop(ready)
        out.append((s, i))
        now += blocks[s][i]
        if i + 1 < len(blocks[s]):
            release(s, i + 1)
    return out


def draw(documents: DataFrame, plans: list[Plan], seed: int = 0, rows: int | None = None) -> DataFrame:
    """Documents drawn with repeats: (doc_id, source, n_tokens, repeats, position).

    ``documents`` (doc_id, source, n_tokens) should be a written table.
    ``position`` is the number of tokens of the source before the document in
    one pass. The running sums work in two levels: hash buckets are summed
    first, so even a source with a third of all rows is never in one task.
    """
    spark = documents.sparkSession
    rows = documents.count() if rows is None else rows
    bits = max(1, math.ceil(math.log2(max(2, rows / BUCKET_ROWS))))
    fields = "source string, full bigint, rest bigint, cap bigint"
    mix = spark.createDataFrame([(p.source, p.full, p.rest, p.max_repeats) for p in plans], fields)
    h = F.xxhash64(F.lit(seed), F.col("doc_id"))
    # one row per source of the target table, which is fixed
    docs = documents.select("doc_id", "source", "n_tokens", h.alias("h"), F.shiftrightunsigned(h, 64 - bits).alias("bucket")).join(F.broadcast(mix), "source")
    sums = docs.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t"))
    before = F.sum("t").over(Window.partitionBy("source").orderBy("bucket")) - F.col("t")
    sums = sums.select(F.col("source").alias("s2"), F.col("bucket").alias("b2"), before.alias("before"))
    docs = docs.join(sums, (F.col("source") == F.col("s2")) & (F.col("bucket") == F.col("b2")))
    w = Window.partitionBy("source", "bucket").orderBy(F.shiftrightunsigned("h", 1), "h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    docs = docs.select("*", (F.col("before") + F.sum("n_tokens").over(w) - F.col("n_tokens")).alias("position"))
    once_more = (F.col("full") < F.col("cap")) & (2 * F.col("position") + F.col("n_tokens") <= 2 * F.col("rest")) & (F.col("rest") > 0)
    return docs.select("doc_id", "source", "n_tokens", (F.col("full") + once_more.cast("int")).alias("repeats"), "position").filter("repeats > 0")


def interleave(drawn: DataFrame, plans: list[Plan], blocks: int = BLOCKS) -> DataFrame:
    """One row per use of a document, with the slot of the schedule its block has; the mix is in order of slot, at, doc_id.

    The blocks' sizes are all that reaches the driver, ``blocks`` and one a
    source at most; the schedule has as many rows, so it is broadcast.
    """
    spark = drawn.sparkSession
    stretch = max(1.0, sum(p.need for p in plans) / blocks)
    # one row per source of the fixed target table
    sizes = spark.createDataFrame([(p.source, p.available) for p in plans], "source string, available bigint")
    uses = drawn.join(F.broadcast(sizes), "source").select("*", F.explode(F.sequence(F.lit(0), (F.col("repeats") - 1).cast("int"))).alias("pass"))
    at = F.col("pass") * F.col("available") + F.col("position")
    uses = materialize(uses.select("doc_id", "source", "n_tokens", "repeats", "pass", at.alias("at"), F.floor(at / F.lit(stretch)).cast("bigint").alias("block")))
    filled: dict[str, list[tuple[int, int]]] = {p.source: [] for p in plans}
    for r in uses.groupBy("source", "block").agg(F.sum("n_tokens").alias("n")).collect():
        filled[r.source].append((r.block, r.n))
    ordered = {s: sorted(b) for s, b in filled.items()}
    order = schedule({s: [n for _, n in b] for s, b in ordered.items()})
    table = spark.createDataFrame([(s, ordered[s][i][0], t) for t, (s, i) in enumerate(order)], "source string, block bigint, slot bigint")
    return uses.join(F.broadcast(table), ["source", "block"]).select("slot", "at", "source", "doc_id", "pass", "n_tokens", "repeats")


def shares(drawn: DataFrame, targets: DataFrame, available: DataFrame) -> DataFrame:
    """Target against actual share of every source in ``targets``."""
    got = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("n_documents"), F.max("repeats").alias("most_repeats"))
    out = targets.join(available, "source", "left").join(got, "source", "left").na.fill(0)
    every = Window.partitionBy(F.lit(0))
    return out.select(
        "source", "target_share", "max_repeats", "available", "n_documents", "most_repeats", "tokens", F.when(F.sum("tokens").over(every) > 0, F.col("tokens") / F.sum("tokens").over(every)).otherwise(0.0).alias("actual_share")
    )
