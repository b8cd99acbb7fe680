"""Bloom filters of tombstone keys, as an optional filter before an exact look-up."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ..functions.ship import ship
from ..sources.shared import written

RATE, HASHES = 0.01, 7


def size_bits(n: int, rate: float = RATE) -> int:
    """Bits for ``n`` keys at a false-positive rate: -n ln p / (ln 2)^2, rounded up to whole bytes."""
    return max(8, 8 * math.ceil(-n * math.log(rate) / math.log(2) ** 2 / 8))


def places(keys: np.ndarray, bits: int, hashes: int = HASHES) -> np.ndarray:
    """Bit places by double hashing, one row for each key."""
    with np.errstate(over="ignore"):
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        g = (h * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
        return ((h[:, None] + g[:, None] * np.arange(hashes, dtype=np.uint64)) >> np.uint64(7)) % np.uint64(bits)


#: Bits of one part of a filter at most.
PART_BITS = 8 << 20


def parts_of(n: int, rate: float = RATE, most: int = PART_BITS) -> tuple[int, int]:
    """Parts of a filter for ``n`` keys, and the bits of each: keys are dealt into parts by hash, so no task holds more than ``most`` bits."""
    parts = max(1, -(-size_bits(n, rate) // most))
    return parts, size_bits(-(-n // parts), rate)


def build(tombstones: DataFrame, n: int, rate: float = RATE, column: str = "key", most: int = PART_BITS, path: str | None = None) -> DataFrame:
    """The filter for about ``n`` keys as a table written to ``path``: part, parts, bits (packed). Null keys are not in it."""
    parts, bits = parts_of(n, rate, most)

    def fill(table: pa.Table) -> pa.Table:
        held = np.zeros(bits // 8, dtype=np.uint8)
        where = np.unique(places(table.column("key").to_numpy(), bits))
        np.bitwise_or.at(held, (where >> np.uint64(3)).astype(np.int64), np.left_shift(1, (where & np.uint64(7)).astype(np.int64)).astype(np.uint8))
        return pa.table([pa.array([table.column("part")[0].as_py()], pa.int64()), pa.array([parts], pa.int64()), pa.array([held.tobytes()], pa.binary())], names=["part", "parts", "bits"])

    ship(tombstones.sparkSession)
    keys = tombstones.select(F.col(column).cast("long").alias("key")).where("key is not null").distinct()
    return written(keys.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts))).groupBy("part").applyInArrow(fill, "part long, parts long, bits binary"), "bloom", path)


def may_hold(df: DataFrame, filter_: DataFrame, column: str = "key", salts: int = 8, source: str | None = None) -> DataFrame:
    """``df`` with ``may``: False only if the filter (of ``build``) proves that the key was not added.

    ``source``: a column of both tables that says which of several filters a row asks; all are asked in one job. Rows go
    to the part of the filter that their key belongs to, each part in ``salts`` copies, so that rows of one key take
    as many tasks; a task reads the part first and then the rows, one batch after the other. A null key is in no filter.
    """
    names = df.columns
    schema = StructType([*df.schema.fields, StructField("may", BooleanType())])
    where = names.index(column)
    row = F.struct(*names)
    own = F.col(source) if source else F.lit(0)
    sizes = filter_.groupBy(own.alias("source")).agg(F.max("parts").alias("parts"))  # a row for each filter
    rows = df.select(own.alias("source"), F.xxhash64(F.col(column).cast("long")).alias("hash"), F.pmod(F.xxhash64(*names), F.lit(salts)).alias("salt"), row.alias("row")).join(F.broadcast(sizes), "source", "left")
    asked = rows.select("source", F.pmod("hash", F.coalesce("parts", F.lit(1))).alias("part"), "salt", F.lit(None).cast("binary").alias("bits"), F.lit(1).alias("kind"), "row")
    told = filter_.select(own.alias("source"), "part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), "bits", F.lit(0).alias("kind"), F.lit(None).cast(asked.schema["row"].dataType).alias("row"))
    together = told.unionByName(asked).repartition("source", "part", "salt").sortWithinPartitions("source", "part", "salt", "kind")

    def test(batches):
        held: dict[tuple, np.ndarray] = {}
        for b in batches:
            source, part, bits, kind, row = (b.column(i) for i in (0, 1, 3, 4, 5))
            kind, part = kind.to_numpy(), part.to_numpy()
            which = source.dictionary_encode()
            code = which.indices.to_numpy(zero_copy_only=False)
            may = np.zeros(b.num_rows, dtype=bool)
            keys = row.field(where)
            valid = keys.is_valid().to_numpy(zero_copy_only=False)
            for c, p in dict.fromkeys(zip(code.tolist(), part.tolist())):
                here, name = (code == c) & (part == p), (which.dictionary[int(c)].as_py(), p)
                new = np.flatnonzero(here & (kind == 0))
                if len(new):
                    held = {name: np.frombuffer(bits[int(new[-1])].as_py(), dtype=np.uint8)}  # of the rows that follow
                some = np.flatnonzero(here & (kind == 1) & valid)
                if len(some) and name in held:
                    at = places(keys.take(pa.array(some)).to_numpy(zero_copy_only=False), len(held[name]) * 8)
                    may[some] = ((held[name][(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)
            rows = np.flatnonzero(kind == 1)
            if len(rows):
                back = row.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*(back.field(i) for i in range(len(names))), pa.array(may[rows])], [*names, "may"])

    ship(df.sparkSession)
    return together.mapInArrow(test, schema)


def gated_deleted(df: DataFrame, tombstones: DataFrame, n: int) -> DataFrame:
    """Records with ``deleted``: an exact semi join for those that pass the filter only."""
    gated = may_hold(df, build(tombstones, n))
    keys = tombstones.select("key", "value").distinct().withColumn("_t", F.lit(True))
    return gated.join(keys, ["key", "value"], "left").withColumn("deleted", F.col("may") & F.coalesce("_t", F.lit(False))).drop("_t", "may")
