"""Sorted runs: positions, merges, bounds and look-ups, without a global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def shard_of(n: int, column: str = "key") -> Column:
    return F.pmod(F.col(column), F.lit(n)).cast("int")


def sorted_run(df: DataFrame, n: int, *tail: str) -> DataFrame:
    """Records with their shard and position (from 0) in its order by (key, value, tail)."""
    run = df.withColumn("shard", shard_of(n))
    return run.withColumn("pos", (F.row_number().over(Window.partitionBy("shard").orderBy("key", "value", *tail)) - 1).cast("long"))


def positions(df: DataFrame, *order: str, per_range: int = 1_000_000) -> DataFrame:
    """``df`` with ``pos``, its place in the whole table's order.

    The table is range-partitioned over all order columns into parts of about ``per_range`` rows,
    so a frequent first value is split as well, and written; the parts' counts, a row each, are added up as offsets.
    Rows that are equal in all order columns come to one part.
    """
    spark = df.sparkSession
    n = max(1, -(-df.count() // per_range))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = written(ranged.withColumn("_range", F.shiftright("_at", 33)), "ranges")
    counts = sorted(tuple(r) for r in placed.groupBy("_range").agg(F.count("*"), F.min("_at")).collect())
    before, offsets = 0, []
    for part, count, first in counts:
        offsets.append((part, before - first))
        before += count
    moved = spark.createDataFrame(offsets or [(0, 0)], "_range long, _by long")
    return placed.join(moved, "_range").withColumn("pos", F.col("_at") + F.col("_by")).drop("_range", "_at", "_by")


def merge(*runs: DataFrame) -> DataFrame:
    """Several runs as one, duplicates kept."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out


def lower_bound(run: DataFrame, probes: DataFrame) -> DataFrame:
    """For each (shard, x) of ``probes``: the first position of ``run`` with key >= x, null beyond the end.

    Probes and records are read once in the falling order of keys, each probe after the records of its key and with the last
    position so far, so that a row costs one step; no range join.
    """
    both = run.select("shard", F.col("key").alias("x"), F.lit(1).alias("_kind"), "pos").unionByName(probes.select("shard", "x", F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("pos")))
    w = Window.partitionBy("shard").orderBy(F.desc("x"), F.desc("_kind"), F.desc("pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("pos", F.last("pos", ignorenulls=True).over(w)).where(F.col("_kind") == 0).drop("_kind")


def record_at(run: DataFrame, wanted: DataFrame) -> DataFrame:
    """Records at (shard, pos)."""
    return run.join(wanted, ["shard", "pos"])
