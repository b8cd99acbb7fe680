"""Op logs for tests and benchmarks: inserts mixed with deletes of records that stand earlier in the log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rng import bits, unit


def mixed_log(inserts: DataFrame, permille: int, seed: int = 1, op: str = "T", after: int = 0) -> DataFrame:
    """``inserts`` (seq, key, value, weight) and, for ``permille`` thousandths of those from seq
    ``after`` on, chosen by hash, one delete each that comes right before the next insert. Each record
    is deleted once at most. Ops are numbered 2 * seq and 2 * seq + 1."""
    chosen = inserts.where((F.col("seq") >= after) & (bits(seed, F.col("seq")) % 1000 < permille))
    put = inserts.select((F.col("seq") * 2).alias("seq"), "key", "value", "weight", F.lit("I").alias("op"))
    gone = chosen.select((F.col("seq") * 2 + 1).alias("seq"), "key", "value", F.lit(0).cast("long").alias("weight"), F.lit(op).alias("op"))
    return put.unionByName(gone)


def key_range(bounds: DataFrame, permille: int, seed: int = 1) -> DataFrame:
    """A random key range that holds ``permille`` thousandths of the span in ``bounds`` (min_key, max_key)."""
    length = ((F.col("max_key") - F.col("min_key")) * permille / 1000).cast("long")
    low = F.col("min_key") + bits(seed, "range") % (F.col("max_key") - F.col("min_key") - length + 1)
    return bounds.select(low.alias("low"), (low + length).alias("high"))


def sampled_log(inserts: DataFrame, pool: int, seed: int = 1, op: str = "T") -> DataFrame:
    """``inserts`` (seq, key, value, weight) and one delete each of ``pool`` records that are drawn from them by
    weight, without replacement (at most the driver's top rows, as a benchmark's delete pool is). A record's delete comes before a random
    one of the inserts after it, or at the end. Ops are numbered 2 * seq and 2 * seq + 1; deletes that fall on one place are of different records."""
    race = -F.log(unit(seed, F.col("key"), F.col("value"))) / F.col("weight")
    last = inserts.agg(F.max("seq").alias("last"))
    chosen = inserts.where("weight > 0").withColumn("_race", race).orderBy("_race", "key", "value").limit(pool).crossJoin(F.broadcast(last))  # one row
    put = inserts.select((F.col("seq") * 2).alias("seq"), "key", "value", "weight", F.lit("I").alias("op"))
    at = F.col("seq") + bits(seed, "when", F.col("key"), F.col("value")) % (F.col("last") - F.col("seq") + 1)
    gone = chosen.select((at * 2 + 1).alias("seq"), "key", "value", F.lit(0).cast("long").alias("weight"), F.lit(op).alias("op"))
    return put.unionByName(gone)
