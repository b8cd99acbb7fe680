"""Counts and rates over records with a level and a shard."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

#: Fixed value: bytes of a packed record (key 8, value 4, header 4, weight 8).
RECORD_BYTES = 24


def totals(df: DataFrame) -> DataFrame:
    """One row: records, tombstones, tagged, weight, largest weight, packed bytes."""
    return df.agg(
        F.count("*").alias("records"),
        F.count_if("is_tombstone").alias("tombstones"),
        F.count_if("is_deleted").alias("deleted"),
        F.coalesce(F.sum("weight"), F.lit(0)).alias("weight"),
        F.coalesce(F.max("weight"), F.lit(0)).alias("max_weight"),
        (F.count("*") * RECORD_BYTES).alias("bytes"),
    )


def by_level(df: DataFrame, buffer_cap: int, scale_factor: int, max_prop: float) -> DataFrame:
    """For each level: records, tombstones, shards, capacity, tombstones in millionths of it, and whether that is allowed."""
    capacity = (F.lit(buffer_cap) * F.pow(F.lit(scale_factor), F.col("level") + 1)).cast("long")
    rows = df.groupBy("level").agg(F.count("*").alias("records"), F.count_if("is_tombstone").alias("tombstones"), F.countDistinct("shard").alias("shards"))
    ppm = F.floor(F.col("tombstones") * 1_000_000 / F.col("capacity")).cast("long")
    return rows.withColumn("capacity", capacity).withColumn("ppm", ppm).withColumn("valid", F.col("tombstones") <= max_prop * F.col("capacity"))


def rejections(checks: DataFrame, floor: int = 1024) -> DataFrame:
    """Look-ups (level, rejected) as counts and a rate in millionths, 0 up to ``floor`` rejections."""
    rows = checks.groupBy("level").agg(F.count("*").alias("checks"), F.count_if("rejected").alias("rejections"))
    return rows.withColumn("rate_ppm", F.when(F.col("rejections") > floor, F.floor(F.col("rejections") * 1_000_000 / F.col("checks"))).otherwise(0).cast("long"))


def observed(df: DataFrame, name: str = "ops") -> tuple[DataFrame, Observation]:
    """``df`` (an op log) and an observation of it: counts that come with the first action, at no extra pass."""
    seen = Observation(name)
    return df.observe(seen, F.count("*").alias("ops"), F.count_if(F.col("op") == "I").alias("inserts"), F.count_if(F.col("op") != "I").alias("deletes"), F.sum("weight").alias("weight")), seen


def aux_bytes(tombstones: int) -> int:
    """Bytes of the Bloom filter that so many tombstones take; none without tombstones."""
    from .bloom import size_bits

    return size_bits(tombstones) // 8 if tombstones else 0
