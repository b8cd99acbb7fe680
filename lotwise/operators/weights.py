"""Weights of sources, cumulative intervals and alias tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ship import ship
from ..sources.shared import drop_written, written
from .shards import shard_of


def shard_weights(df: DataFrame, n: int) -> DataFrame:
    """Shards with weight, their counts and weights: at most ``n`` rows."""
    return df.groupBy(shard_of(n).alias("shard")).agg(F.count("*").alias("n"), F.sum("weight").alias("weight")).where("weight > 0")


def intervals(df: DataFrame, *by: str, tail: tuple[str, ...] = ()) -> DataFrame:
    """Each record with weight and its interval [lo, hi) in its group's order by (key, value, tail)."""
    w = Window.partitionBy(*by).orderBy("key", "value", *tail).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.where("weight > 0").withColumn("hi", F.sum("weight").over(w))
    return out.withColumn("lo", F.col("hi") - F.col("weight"))


#: Masses are whole numbers of up to 94 bits, in two parts: this many bits, and what is above them.
LIMB = 31
LOW = (1 << LIMB) - 1


def limbs(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same numbers with low parts from 0 to LOW."""
    return high + (low >> LIMB), low & LOW


def count_below(ordered: tuple[np.ndarray, np.ndarray], asked: tuple[np.ndarray, np.ndarray], equal: bool) -> np.ndarray:
    """How many of the ``ordered`` numbers are below each of ``asked``, or ``equal`` to it."""
    n = len(ordered[0])
    mine = np.repeat([0, 1] if equal else [1, 0], [n, len(asked[0])])
    order = np.lexsort((mine, *(np.concatenate(x) for x in zip(reversed(ordered), reversed(asked)))))
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(order < n)
    return out[n:]


def cuts(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An alias table in whole numbers: of each slot's mass, which is the total weight, what is its own, and the alias that has the rest.

    What small slots lack, one after the other, is laid against what large ones have to spare. A small slot's alias is the large one in
    whose stretch of the line of spare mass its lack begins. Where the lack ends beyond that stretch, the large slot becomes small itself,
    with the next large one as its alias. Sums reach the total times the number of slots, beyond 64 bits, and are exact.
    """
    w, n, total = weights.astype(np.int64), len(weights), int(weights.sum())
    off = limbs((w >> LIMB) * n - (total >> LIMB), (w & LOW) * n - (total & LOW))  # mass beyond the total, in two parts
    cut, alias = np.full(n, total, dtype=np.int64), np.arange(n)
    small, large = np.flatnonzero(off[0] < 0), np.flatnonzero(off[0] >= 0)
    if len(small):
        lack = limbs(np.cumsum(-off[0][small]), np.cumsum(-off[1][small]))
        spare = limbs(np.cumsum(off[0][large]), np.cumsum(off[1][large]))
        before = tuple(np.concatenate(([0], x[:-1])) for x in lack)
        cut[small] = w[small] * n
        alias[small] = large[count_below(spare, before, True)]
        begun = count_below(before, spare, False)  # 1 at least, unless nothing is spared up to there
        over = np.where(begun > 0, ((lack[0][begun - 1] - spare[0]) << LIMB) + lack[1][begun - 1] - spare[1], 0)
        cut[large] -= over
        alias[large[:-1]] = large[1:]
    return cut, alias


def table(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An alias table: each slot's own share, the alias that has the rest, and ``cuts``."""
    cut, alias = cuts(weights)
    total = int(weights.sum())
    return np.where(weights < total / len(weights), cut / total, 1 - (total - cut) / total), alias, cut


def vose(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An alias table by prefix sums: each slot's own share, and the alias that has the rest."""
    return table(weights)[:2]


def stretches(shard: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The shards of rows that are sorted by them, and where they are."""
    bounds = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
    for x, y in zip(bounds, bounds[1:]):
        if y > x:
            yield int(shard[x]), slice(x, y)


def mapped(df: DataFrame, f: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], schema: str, whole: bool = False) -> DataFrame:
    """What ``f`` makes of the numbers of each batch, or of a ``whole`` partition, and ``part``, the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = (pa.Table.from_batches([b]) for b in batches)
        if whole:
            tables = (pa.concat_tables(x) for x in [list(tables)] if x)
        part = TaskContext.get().partitionId()
        for t in tables:
            if t.num_rows:
                out = f({c: t.column(c).to_numpy() for c in t.column_names} | ({} if "part" in t.column_names else {"part": np.full(t.num_rows, part)}))
                yield from pa.table(out).to_batches(max_chunksize=100_000)

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def alias_tables(df: DataFrame, n: int, per_range: int = 500_000) -> DataFrame:
    """An alias table for each shard: shard, slot, key, value, weight, prob, alias, cut (``cuts``). Shards without weight have none."""
    line, finish = alias_line(df, n, per_range)
    return finish(line)


def alias_line(df: DataFrame, n: int, per_range: int = 500_000) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """All slots with shard, slot, key, value and weight, and what makes rows of ``alias_tables`` of any of them.

    What ``cuts`` finds in arrays of a shard is found in ranges of about ``per_range`` rows, whatever the size of a shard. Slots are the records in the order of (shard, key,
    value, weight); each range sums what its slots lack and have to spare. Then the slots are points on the line of mass: a small one where its lack begins, a
    large one where its spare mass ends. In the order of these, a slot's alias is the next large one, and how far a large one is used up is told
    by the small one before it. Ranges are joined by a few numbers of each, which the driver holds.
    """
    spark = df.sparkSession
    rows = df.where("weight > 0").select(shard_of(n).alias("shard"), "key", "value", "weight")
    sizes = {r.shard: (r.n, r.w) for r in rows.groupBy("shard").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}
    parts = max(1, -(-sum(x for x, _ in sizes.values()) // per_range))
    kinds = {"shard": np.int32} | dict.fromkeys(["key", "value", "weight", "part", "slot", "lack", "lack_low", "spare", "spare_low", "high", "low", "alias", "cut", "small_high", "small_low"], np.int64)

    def typed(x: dict[str, np.ndarray], *names: str) -> dict[str, np.ndarray]:
        return {c: np.asarray(x[c], dtype=kinds[c]) for c in names}

    def known(x: dict[str, np.ndarray], of: dict, *by: str) -> np.ndarray:
        """What ``of`` has for each row's shard, or shard and part, as columns."""
        code = x["shard"].astype(np.int64) << 32 | (x["part"] if by else 0)
        each, inverse = np.unique(code, return_inverse=True)
        return np.array([of[(c >> 32, c & 0xFFFFFFFF) if by else c >> 32] for c in each.tolist()], dtype=np.int64)[inverse].T

    def beyond(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Each slot's mass beyond the total, in two parts."""
        count, total = known(x, sizes)
        w = x["weight"]
        return limbs((w >> LIMB) * count - (total >> LIMB), (w & LOW) * count - (total & LOW))

    # 1. slots of each range, with sums up to each
    summed = ["lack", "lack_low", "spare", "spare_low"]

    def summing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, state = TaskContext.get().partitionId(), None, [0] * 5
        for b in batches:
            x = {c: b.column(c).to_numpy() for c in b.schema.names}
            x |= {c: np.empty(b.num_rows, dtype=np.int64) for c in ("slot", *summed)} | {"part": np.full(b.num_rows, part)}
            high, low = beyond(x)
            for shard, at in stretches(x["shard"]):
                if shard != last:
                    last, state = shard, [0] * 5
                h, m = high[at], low[at]
                x["slot"][at] = state[0] + np.arange(len(h))
                x["lack"][at], x["lack_low"][at] = limbs(state[1] + np.cumsum(np.where(h < 0, -h, 0)), state[2] + np.cumsum(np.where(h < 0, -m, 0)))
                x["spare"][at], x["spare_low"][at] = limbs(state[3] + np.cumsum(np.where(h < 0, 0, h)), state[4] + np.cumsum(np.where(h < 0, 0, m)))
                state = [state[0] + len(h), *(int(x[c][at.stop - 1]) for c in summed)]
            if b.num_rows:
                yield pa.RecordBatch.from_pydict(typed(x, "shard", "key", "value", "weight", "part", "slot", *summed))

    ship(spark)
    order = ["shard", "key", "value", "weight"]
    slots = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(summing, "shard int, key long, value long, weight long, part long, slot long, lack long, lack_low long, spare long, spare_low long")
    slots = written(slots, "slots")
    before: dict[tuple[int, int], list[int]] = {}
    sums: dict[int, list[int]] = {}
    for r in sorted(slots.groupBy("shard", "part").agg(F.max(F.struct("slot", *summed)).alias("x")).collect()):
        before[r.shard, r.part] = old = sums.get(r.shard, [0] * 5)
        lack, spare = (limbs(np.int64(old[i] + r.x[i]), np.int64(old[i + 1] + r.x[i + 1])) for i in (1, 3))
        sums[r.shard] = [old[0] + r.x.slot + 1, *map(int, lack), *map(int, spare)]

    # 2. points on the line, and of each range what it tells by itself: no alias (-1) after its last large slot, no small (-1) before its first one
    def place(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        old = known(x, before, "part")
        high, low = beyond(x)
        small = high < 0
        lack, spare = limbs(x["lack"] + old[1] + high, x["lack_low"] + old[2] + low), limbs(x["spare"] + old[3], x["spare_low"] + old[4])
        at = [np.where(small, p, q) for p, q in zip(lack, spare)]
        return typed(x | {"slot": x["slot"] + old[0], "high": at[0], "low": at[1]}, "shard", "key", "value", "weight", "slot", "high", "low") | {"small": small}

    def meet(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        count = len(x["shard"])
        x |= {c: np.full(count, -1, dtype=np.int64) for c in ("alias", "small_high", "small_low")}
        high, low = beyond(x)
        end = limbs(x["high"] - high, x["low"] - low)  # of a small slot's lack
        for _, at in stretches(x["shard"]):
            small, i = x["small"][at], np.arange(at.stop - at.start)
            after = np.append(np.minimum.accumulate(np.where(small, len(i), i)[::-1])[::-1][1:], len(i))
            x["alias"][at] = np.where(after < len(i), x["slot"][at][np.minimum(after, len(i) - 1)], -1)
            last = np.maximum.accumulate(np.where(small, i, -1))
            for c, y in zip(("small_high", "small_low"), end):
                x[c][at] = np.where(last >= 0, y[at][last], -1)
        return typed(x, "shard", "key", "value", "weight", "part", "slot", "high", "low", "alias", "small_high", "small_low") | {"small": x["small"]}

    record = "shard int, key long, value long, weight long"
    points = mapped(slots, place, f"{record}, slot long, high long, low long, small boolean")
    order = ["shard", "high", "low", "small", "slot"]
    line = mapped(points.repartitionByRange(parts, *order).sortWithinPartitions(*order), meet, f"{record}, part long, slot long, high long, low long, alias long, small_high long, small_low long, small boolean", whole=True)
    line = written(line, "line")
    drop_written(slots)

    # 3. what a range doesn't tell is told by those around it
    met = line.groupBy("shard", "part").agg(F.min(F.when(~F.col("small"), F.col("slot"))).alias("large"), F.max(F.when(F.col("small"), F.struct("small_high", "small_low"))).alias("small"))
    met = sorted(((r.shard, r.part, r.large, tuple(r.small) if r.small else None) for r in met.collect()), key=lambda r: r[:2])
    ends: dict[tuple[int, int], tuple[int, int, int]] = {}
    for k, (shard, part, _, _) in enumerate(met):
        same = k > 0 and met[k - 1][0] == shard
        ends[shard, part] = (-1, *((met[k - 1][3] or ends[shard, met[k - 1][1]][1:]) if same else (-1, -1)))
    for k in range(len(met) - 2, -1, -1):
        if met[k][0] == met[k + 1][0]:
            large = met[k + 1][2]
            ends[met[k][:2]] = (large if large is not None else ends[met[k + 1][:2]][0], *ends[met[k][:2]][1:])

    def finish(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        around = known(x, ends, "part")
        count, total = known(x, sizes)
        alias = np.where(x["alias"] < 0, around[0], x["alias"])
        alias = np.where(alias < 0, x["slot"], alias)
        high, low = (np.where(x["small_high"] < 0, y, x[c]) for c, y in (("small_high", around[1]), ("small_low", around[2])))
        over = np.where(high >= 0, ((high - x["high"]) << LIMB) + low - x["low"], 0)
        cut = np.where(x["small"], x["weight"] * np.where(x["small"], count, 0), total - over)
        prob = np.where(x["small"], cut / total, 1 - (total - cut) / total)
        return typed(x | {"alias": alias, "cut": cut}, "shard", "slot", "key", "value", "weight") | {"prob": prob, "alias": alias, "cut": cut}

    return line, lambda some: mapped(some.select(line.columns), finish, "shard int, slot long, key long, value long, weight long, prob double, alias long, cut long")


def alias_mass(tables: DataFrame) -> DataFrame:
    """What each record gets from its shard's alias table, as integer weight, summed exactly; null if it is no whole number.

    The table is right if it equals the weight.
    """
    totals = tables.groupBy("shard").agg(F.sum("weight").alias("total"), F.count("*").alias("slots"))  # a row for each shard
    part = lambda target, mass, *fields: F.struct(F.col(target).alias("target"), mass.cast("decimal(20,0)").alias("mass"), *fields)
    own = part("slot", F.col("cut"), "key", "value")
    given = part("alias", F.col("total") - F.col("cut"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("long").alias("value"))
    parts = tables.join(F.broadcast(totals), "shard").select("shard", "slots", F.explode(F.array(own, given)).alias("part")).select("shard", "slots", "part.*")
    mass = parts.groupBy("shard", "slots", "target").agg(F.sum("mass").alias("mass"), F.max("key").alias("key"), F.max("value").alias("value"))
    return mass.select("shard", "key", "value", F.when(F.col("mass") % F.col("slots") == 0, F.expr("mass div slots")).alias("weight"))
