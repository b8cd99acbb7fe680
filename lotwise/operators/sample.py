"""Weighted samples by hash draws and cumulative weights."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rng import below, unit
from ..functions.ship import ship
from ..sources.shared import written
from .shards import shard_of
from .weights import alias_line, intervals, shard_weights


#: A line of so many shards at most is broadcast, some 2 MB.
SMALL_LINE = 50_000


def offsets(df: DataFrame, n: int) -> tuple[list[tuple[int, int, int]], int]:
    """(shard, first, end) of each shard with weight on the line of all weight, and its length: at most ``n`` rows."""
    out, total = [], 0
    for r in sorted(shard_weights(df, n).collect()):
        out.append((r.shard, total, total + r.weight))
        total += r.weight
    return out, total


def drawn(df: DataFrame, k: int, total: int, seed: int) -> DataFrame:
    """``k`` draws (draw, r) from a line of length ``total``; none if that is 0."""
    return df.sparkSession.range(k if total else 0).select(F.col("id").alias("draw"), below(F.lit(max(1, total)), seed, F.col("id")).alias("r"))


def dealt(draws: DataFrame, line: list[tuple[int, int, int]]) -> DataFrame:
    """Draws (draw, r) with the shard that r falls into, the place in it and its width.

    The line is cut into as many equal cells as it has shards; a shard is a row for each cell it
    reaches into, twice as many rows as shards in all at most, and draws meet it by their cell: an equi-join of data, whatever
    the number of shards. An empty line holds no draws.
    """
    width = max(1, -(-line[-1][2] // len(line))) if line else 1
    cells = draws.sparkSession.createDataFrame([(cell, s, a, b) for s, a, b in line for cell in range(a // width, (b - 1) // width + 1)], "_cell long, shard int, _a long, _b long")
    if len(line) <= SMALL_LINE:
        cells = F.broadcast(cells)
    hit = (F.col("_a") <= F.col("r")) & (F.col("r") < F.col("_b"))
    return draws.withColumn("_cell", F.expr(f"r div {width}L")).join(cells, "_cell").where(hit).select("draw", "shard", (F.col("r") - F.col("_a")).alias("at"), (F.col("_b") - F.col("_a")).alias("width"))


def look_up(df: DataFrame, draws: DataFrame, by: list[str], tail: tuple[str, ...] = (), fields: tuple[str, ...] = ("key", "value", "weight")) -> DataFrame:
    """The record whose interval holds each draw's place ``at``, within the groups ``by``.

    Records (at the start of their interval) and draws are sorted together, and each draw takes
    the last record before it: a window, never a range join.
    """
    record = F.struct(*fields)
    starts = intervals(df, *by, tail=tail).select(*by, F.col("lo").alias("at"), F.lit(0).alias("_kind"), record.alias("_record"), F.lit(None).cast("long").alias("draw"))
    asked = draws.select(*by, "at", F.lit(1).alias("_kind"), F.lit(None).cast(starts.schema["_record"].dataType).alias("_record"), "draw")
    w = Window.partitionBy(*by).orderBy("at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = starts.unionByName(asked).withColumn("_record", F.last("_record", ignorenulls=True).over(w))
    return both.where("_kind = 1").select(*[b for b in by if b != "shard"], "draw", *[f"_record.{c}" for c in fields])


def sample(df: DataFrame, k: int, seed: int = 1, shards: int = 8, tail: tuple[str, ...] = ()) -> DataFrame:
    """``k`` independent draws with replacement, each record with probability weight / total: draw, key, value, weight.

    Draw d is the hash of (seed, d) modulo the total on the line of shards, so results don't
    depend on partitions or retries, as long as (key, value, ``tail``) orders the records. An input
    without weight gives no rows.
    """
    line, total = offsets(df, shards)
    if not total:
        return df.sparkSession.createDataFrame([], "draw long, key long, value long, weight long")
    return look_up(df.withColumn("shard", shard_of(shards)), dealt(drawn(df, k, total, seed), line), ["shard"], tail)


#: So many draws at most are sent to every task, some 24 MB.
SENT = 1_000_000


def numbered(rows: DataFrame, group: str) -> DataFrame:
    """Rows in the order of their ranges with the range, ``part``, and the weight before each in its range and group, ``lo``."""
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.LongType()), T.StructField("lo", T.LongType())])

    def number(batches):
        before, current = 0, None
        for b in batches:
            if b.num_rows:
                weight, piece = b.column("weight").to_numpy(), b.column(group).to_numpy()
                new = np.append(piece[0] != current, piece[1:] != piece[:-1])
                lo = before + np.cumsum(weight) - weight
                at = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
                lo = lo - np.where(at >= 0, lo[at], 0)
                before, current = int(lo[-1] + weight[-1]), piece[-1]
                part = np.full(len(lo), TaskContext.get().partitionId(), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part), pa.array(lo)], [*names, "part", "lo"])

    ship(rows.sparkSession)
    return rows.mapInArrow(number, schema)


def sent(placed: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Draws (draw, shard, at) as arrays in the order of shard and place."""
    told = placed.select("shard", "at", "draw").toArrow()
    shard, at, draw = (told.column(c).to_numpy() for c in ("shard", "at", "draw"))
    order = np.lexsort((at, shard))
    return shard[order], at[order], draw[order]


def fallen(rows: DataFrame, draws: Broadcast, fields: list[str]) -> DataFrame:
    """The records of ``rows`` (place, lo, weight and ``fields``) that draws (arrays as ``sent`` gives them) fall on: draw and the fields.

    Any task may have any of a place's records: each batch is met with the draws of its places by binary search, and every draw falls
    on the one record whose stretch [lo, lo + weight) holds it.
    """
    schema = T.StructType([T.StructField("draw", T.LongType()), *[rows.schema[c] for c in fields]])

    def find(batches):
        shard, at, draw = draws.value
        for b in batches:
            place, lo, weight = (b.column(c).to_numpy() for c in ("place", "lo", "weight"))
            for i in np.unique(place).tolist():
                mine = np.flatnonzero(place == i)
                mine = mine[np.argsort(lo[mine], kind="stable")]
                first, last = np.searchsorted(shard, [i, i + 1])
                asked = at[first:last]
                to = np.searchsorted(lo[mine], asked, side="right") - 1
                ok = (to >= 0) & (asked < (lo[mine] + weight[mine])[to])
                if ok.any():
                    records = b.take(pa.array(mine[to[ok]]))
                    yield pa.RecordBatch.from_arrays([pa.array(draw[first:last][ok]), *(records.column(c) for c in fields)], ["draw", *fields])

    ship(rows.sparkSession)
    return rows.where("weight > 0").select(*dict.fromkeys(["place", "lo", "weight", *fields])).mapInArrow(find, schema)


def sample_arrow(df: DataFrame, k: int, seed: int = 1, shards: int = 8, per_range: int = 1_000_000) -> DataFrame:
    """The same draws as ``sample``, looked up by binary search.

    The records are sorted into ranges of about ``per_range`` rows, written, whatever the size of a shard; a range's part of a shard is a
    place on the line, so the line has as many rows as ranges and shards. Up to ``SENT`` draws go to the records' tasks; more are
    looked up as ``sample`` does, a place at a time.
    """
    rows = df.where("weight > 0").select(shard_of(shards).alias("shard"), "key", "value", "weight")
    parts = max(1, -(-rows.count() // per_range))
    ranged = written(numbered(rows.repartitionByRange(parts, "shard", "key", "value").sortWithinPartitions("shard", "key", "value"), "shard"), "ranges")
    places, total = [], 0
    for r in ranged.groupBy("shard", "part").agg(F.sum("weight").alias("w")).orderBy("shard", "part").collect():
        places.append((r.shard, r.part, total, total + r.w))
        total += r.w
    placed = dealt(drawn(df, k, total, seed), [(i, a, b) for i, (_, _, a, b) in enumerate(places)])
    known = df.sparkSession.createDataFrame([(s, p, i) for i, (s, p, _, _) in enumerate(places)], "shard int, part long, place int")
    rows = ranged.join(F.broadcast(known) if len(places) <= SMALL_LINE else known, ["shard", "part"])
    if k > SENT:
        return look_up(rows.drop("shard").withColumnRenamed("place", "shard"), placed, ["shard"])
    return fallen(rows, df.sparkSession.sparkContext.broadcast(sent(placed)), ["key", "value", "weight"])


def source_counts(df: DataFrame, k: int, seed: int = 1, shards: int = 8) -> DataFrame:
    """How many of ``k`` draws fall to each shard; none without weight."""
    line, total = offsets(df, shards)
    draws = drawn(df, k, total, seed)
    return dealt(draws, line).groupBy("shard").agg(F.count("*").alias("n"))


def two_stage(df: DataFrame, k: int, seed: int = 1, shards: int = 8) -> DataFrame:
    """A shard by one hash, then a record in it by another; no rows without weight."""
    line, total = offsets(df, shards)
    inner = dealt(drawn(df, k, total, seed), line).select("draw", "shard", below(F.col("width"), seed, "inner", F.col("draw")).alias("at"))
    return look_up(df.withColumn("shard", shard_of(shards)), inner, ["shard"])


def sample_alias(df: DataFrame, k: int, seed: int = 1, shards: int = 8) -> DataFrame:
    """A shard by one hash, a slot by another, and the slot or its alias by a third: constant work for each draw. No rows without weight."""
    line, total = offsets(df, shards)
    table, finish = alias_line(df, shards)
    slots = df.where("weight > 0").groupBy(shard_of(shards).alias("shard")).agg(F.count("*").alias("slots"))
    first = dealt(drawn(df, k, total, seed), line).join(F.broadcast(slots), "shard").select("shard", "draw", below(F.col("slots"), seed, "slot", F.col("draw")).alias("slot"), unit(seed, "coin", F.col("draw")).alias("u"))
    few = F.broadcast if k <= SENT else lambda x: x  # so that the table isn't shuffled
    drawn_slots = finish(table.join(few(first.select("shard", "slot").distinct()), ["shard", "slot"], "left_semi")).select("shard", "slot", "prob", "alias")
    taken = first.join(drawn_slots, ["shard", "slot"]).select("shard", "draw", F.when(F.col("u") <= F.col("prob"), F.col("slot")).otherwise(F.col("alias")).alias("slot"))
    return table.select("shard", "slot", "key", "value", "weight").join(few(taken), ["shard", "slot"]).select("draw", "key", "value", "weight")


def sample_rejecting(buffer: DataFrame, k: int, seed: int = 1, attempts: int = 64) -> DataFrame:
    """Draws from a write buffer (bounded by its capacity): a uniform slot, accepted with probability
    weight / largest weight; the first accepted of ``attempts`` counts. Draws without one, as of very uneven weights, are
    looked up by cumulated weight: the same distribution, so ``k`` rows always come. Slots go by (key, value)."""
    b = buffer.agg(F.count("*").alias("n"), F.max("weight").alias("most"), F.sum("weight").alias("total")).first()
    if not b.n or not b.most:
        return buffer.sparkSession.createDataFrame([], "draw long, key long, value long, weight long")
    slots = buffer.withColumn("slot", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("key", "value")) - 1).cast("long"))  # one buffer
    draws = buffer.sparkSession.range(k).select(F.col("id").alias("draw"))
    tries = draws.select("draw", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))).alias("try"))
    tries = tries.select("draw", "try", below(F.lit(b.n), seed, F.col("draw"), F.col("try"), "slot").alias("slot"), below(F.lit(b.most), seed, F.col("draw"), F.col("try"), "coin").alias("coin"))
    kept = tries.join(slots, "slot").where(F.col("coin") < F.col("weight"))
    first = kept.groupBy("draw").agg(F.min_by(F.struct("key", "value", "weight"), "try").alias("x")).select("draw", "x.*")
    rest = draws.join(first, "draw", "left_anti").select("draw", F.lit(0).alias("shard"), below(F.lit(b.total), seed, F.col("draw"), "rest").alias("at"))
    return first.unionByName(look_up(buffer.withColumn("shard", F.lit(0)), rest, ["shard"]))


def sample_retrying(df: DataFrame, dead: Column, k: int, passes: int, seed: int = 1, shards: int = 8) -> DataFrame:
    """Draws over all records, dead ones rejected and drawn again in up to ``passes`` passes: draw, pass, key, value, weight.

    What is rejected in all of them is drawn from the live records alone, as pass ``passes``, so ``k``
    rows always come while anything with weight lives.
    """
    spark = df.sparkSession
    line, total = offsets(df, shards)
    none = spark.createDataFrame([], "draw long, pass int, key long, value long, weight long")
    if not total:
        return none
    draws = spark.range(k).select(F.col("id").alias("d"))
    tries = draws.select(F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass"), "d")
    coded = tries.select((F.col("d") * passes + F.col("pass")).alias("draw"), below(F.lit(total), seed, F.col("d"), F.col("pass")).alias("r"))
    got = look_up(df.withColumn("shard", shard_of(shards)), dealt(coded, line), ["shard"]).where(~dead)
    first = got.groupBy(F.floor(F.col("draw") / passes).alias("d")).agg(F.min(F.struct((F.col("draw") % passes).cast("int").alias("pass"), "key", "value", "weight")).alias("x"))
    first = first.select(F.col("d").alias("draw"), "x.*")
    alive = df.where(~dead)
    line, total = offsets(alive, shards)
    if not total:
        return none
    rest = draws.join(first, F.col("d") == F.col("draw"), "left_anti").select(F.col("d").alias("draw"), below(F.lit(total), seed, F.col("d"), "rest").alias("r"))
    last = look_up(alive.withColumn("shard", shard_of(shards)), dealt(rest, line), ["shard"])
    return first.unionByName(last.withColumn("pass", F.lit(passes)))


def sample_by_group(df: DataFrame, group: str, k: int, seed: int = 1, shards: int = 8) -> DataFrame:
    """``k`` draws within each group; a large group is spread over ``shards`` tasks like a whole table."""
    rows = df.where("weight > 0").withColumn("shard", shard_of(shards))
    sizes = rows.groupBy(group, "shard").agg(F.sum("weight").alias("w"))
    before = F.coalesce(F.sum("w").over(Window.partitionBy(group).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = sizes.withColumn("a", before).groupBy(group).agg(F.sum("w").alias("total"), F.collect_list(F.struct("shard", "a", "w")).alias("line"))
    draws = lines.select(group, "line", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))).alias("draw")).withColumn("r", below(F.col("total"), seed, F.col(group), F.col("draw")))
    hit = F.filter("line", lambda x: (x["a"] <= F.col("r")) & (F.col("r") < x["a"] + x["w"]))[0]
    asked = draws.withColumn("_hit", hit).select(group, F.col("_hit.shard").alias("shard"), (F.col("r") - F.col("_hit.a")).alias("at"), "draw")
    return look_up(rows, asked, [group, "shard"])


def sample_without(df: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """``k`` records without replacement: the smallest of -ln(u) / weight, u hashed from the key and value."""
    race = -F.log(unit(seed, F.col("key"), F.col("value"))) / F.col("weight")
    return df.where("weight > 0").withColumn("_race", race).orderBy("_race", "key", "value").limit(k).drop("_race")


def share_error(sampled: DataFrame, df: DataFrame, by: str) -> DataFrame:
    """Draws by class against what the weights lead to expect, in thousandths of all draws."""
    k = sampled.count()
    total = df.agg(F.sum("weight").alias("w")).first().w
    got = sampled.groupBy(by).agg(F.count("*").alias("n"))
    want = df.groupBy(by).agg(F.sum("weight").alias("w"))
    return want.join(got, by, "left").select(by, F.coalesce("n", F.lit(0)).alias("n"), F.floor(F.abs(F.coalesce("n", F.lit(0)) * 1000 / k - F.col("w") * 1000 / total)).cast("long").alias("off"))

