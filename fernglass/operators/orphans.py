"""Referential integrity over time: rows that refer to records not there.

Children and parents are laid out in one long form (parent table, key, time)
and grouped by parent table and key. A group without any parent row is a plain
orphan key; in the other groups a running maximum over the time order tells
whether a parent was alive at the moment of each reference. Hot keys are split
into salts, to which only their few parent rows are copied.

Defined results for awkward input:

* null or empty reference: no reference, never reported
* reference at null time: reported as ``missing`` (nothing is known to be valid)
* parent with null start: never valid; null end: valid for ever
* repeated child rows: reported once; extra columns are ignored
* empty tables: no rows (children without parents are all reported)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A key counts as hot beyond this part of all references, so at most this many keys are hot.
HOT_PARTS = 512
SALTS = 32


@dataclass
class Reference:
    """One referring table: which column points at which parent table."""

    table_name: str
    rows: DataFrame
    row_id: Column
    key: Column
    at: Column
    parent: str


@dataclass
class Parent:
    name: str
    rows: DataFrame
    key: Column
    start: Column
    end: Column


def references_long(references: list[Reference]) -> DataFrame:
    out = None
    for r in references:
        key = r.key.cast("string")
        part = r.rows.select(
            F.lit(r.parent).alias("parent_table"),
            key.alias("key"),
            r.at.cast("timestamp").alias("at"),
            F.lit(r.table_name).alias("table_name"),
            r.row_id.cast("bigint").alias("row_id"),
        ).filter("key is not null and key <> ''")
        out = part if out is None else out.unionByName(part)
    return out


def parents_long(parents: list[Parent]) -> DataFrame:
    out = None
    for p in parents:
        part = p.rows.select(
            F.lit(p.name).alias("parent_table"),
            p.key.cast("string").alias("key"),
            p.start.cast("timestamp").alias("at"),
            F.coalesce(p.end.cast("timestamp"), F.lit("9999-12-31").cast("timestamp")).alias("until"),
        ).filter("key is not null and at is not null")
        out = part if out is None else out.unionByName(part)
    return out


def resolve_references(references: list[Reference], parents: list[Parent]) -> DataFrame:
    """Every reference row with its ``state``.

    ``valid``, ``missing`` (no such record), ``deleted`` (only earlier lives) or
    ``later`` (indexed only afterwards). Columns: table_name, row_id, key, at, state.
    """
    child, parent = references_long(references), parents_long(parents)
    total = child.count()
    # at most HOT_PARTS keys can each hold more than 1/HOT_PARTS of the rows: the broadcast is bounded by arithmetic
    hot = child.groupBy("parent_table", "key").count().filter(F.col("count") > max(total // HOT_PARTS, 10_000)).select("parent_table", "key", F.lit(True).alias("hot"))
    child = child.join(F.broadcast(hot), ["parent_table", "key"], "left").select(
        "*", F.when(F.col("hot"), F.pmod(F.xxhash64("table_name", "row_id"), F.lit(SALTS))).otherwise(0).cast("int").alias("salt"), F.lit(1).alias("side"), F.lit(None).cast("timestamp").alias("until")
    )
    parent = parent.join(F.broadcast(hot), ["parent_table", "key"], "left").select(
        "*",
        F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"),
        F.lit(0).alias("side"),
        F.lit(None).cast("string").alias("table_name"),
        F.lit(None).cast("bigint").alias("row_id"),
    )
    key = Window.partitionBy("parent_table", "key", "salt")
    before = key.orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    cover = F.max("until").over(before)
    known = F.max(F.col("side") == 0).over(key)
    state = F.when(F.col("cover") > F.col("at"), "valid").when(~F.col("known") | F.col("at").isNull(), "missing").when(F.col("cover").isNotNull(), "deleted").otherwise("later")
    return (
        child.unionByName(parent)
        .select("*", cover.alias("cover"), known.alias("known"))
        .filter("side = 1")
        .select("table_name", "row_id", "key", "at", state.alias("state"))
    )


def orphan_rows(references: list[Reference], parents: list[Parent]) -> DataFrame:
    """(table_name, row_id) of every reference without a valid target, once each."""
    return resolve_references(references, parents).filter("state <> 'valid'").select("table_name", "row_id").distinct()


def orphan_report(references: list[Reference], parents: list[Parent]) -> DataFrame:
    """Counts per referring table and UTC day of the reference."""
    rows = resolve_references(references, parents).dropDuplicates(["table_name", "row_id"])
    n = lambda s: F.count_if(F.col("state") == s).alias(f"n_{s}")
    return rows.groupBy("table_name", F.to_date("at").alias("day")).agg(F.count("*").alias("n_references"), n("missing"), n("deleted"), n("later"), F.count_if(F.col("state") != "valid").alias("n_orphans"))
