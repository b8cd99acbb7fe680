"""Which records live: tombstones, tag deletes and look-ups of both."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ship import ship
from ..sources.shared import written

#: Ops that are scanned at once, about: what a task holds of its range.
CHUNK = 100_000
#: What a part of the sorted log, a chunk of a range, says of each op's group: in it alone, before other parts are heard.
LOCAL = [T.StructField("_part", T.LongType()), T.StructField("_edge", T.BooleanType()), T.StructField("_head", T.BooleanType())] + [T.StructField(c, T.LongType()) for c in ("_n", "_run", "_ahead", "_behind", "_total", "_low")]


def scan(rows: pa.Table, by: list[int], op: int) -> list[np.ndarray]:
    """Edge, head, n, run, ahead, behind, total and low of ops sorted by group and seq.

    Inserts open and deletes close brackets. ``run`` is the balance of an op's group up to it, ``ahead`` the lowest
    from it on, ``behind`` the lowest before it (n + 1, which is above any, where nothing is), ``total`` and ``low`` the group's last and lowest;
    ``edge`` tells the first and the last group, which other parts may share, and ``head`` a group's first op.
    """
    n = rows.num_rows
    head = np.zeros(n, dtype=bool)
    head[0] = True
    for i in by:
        column = rows.column(i).combine_chunks()
        null = column.is_null().to_numpy(zero_copy_only=False)
        if null.any():
            column = column.drop_null().take(pa.array(np.maximum(np.cumsum(~null) - 1, 0))) if not null.all() else pa.array(np.zeros(n, dtype=np.int64))
        value = column.to_numpy(zero_copy_only=False)
        head[1:] |= (null[1:] != null[:-1]) | (value[1:] != value[:-1]) & ~null[1:]
    group = np.cumsum(head) - 1
    first = np.flatnonzero(head)
    sizes = np.diff(np.append(first, n))
    step = np.where(rows.column(op).to_numpy(zero_copy_only=False) == "I", 1, -1)
    run = np.cumsum(step)
    run -= (run[first] - step[first])[group]
    apart = group * (2 * n + 2)  # each group's balances lie below those of the group before, so one minimum along all serves each
    ahead = (np.minimum.accumulate((run + apart)[::-1])[::-1]) - apart
    lows = np.minimum.accumulate(run - apart) + apart
    behind = np.where(head, n + 1, np.append(0, lows[:-1]))
    last = first + sizes - 1
    edge = (group == 0) | (group == group[-1])
    return [edge, head, sizes[group], run, ahead, behind, run[last][group], lows[last][group]]


def brackets(log: DataFrame, parts: int | None = None, by: tuple[str, ...] = ("key", "value"), ordered: bool = False) -> DataFrame:
    """The op log with ``alive``: inserts that no later delete meets, and deletes that meet no insert.

    Within a (key, value), or what ``by`` names, inserts open and deletes close brackets in the order of seq. An insert
    lives if the balance never falls below its own afterwards; a delete is unmatched if it takes the balance to
    a new low below zero.

    The ops are exchanged once, into ``parts`` ranges (Spark's shuffle partitions if not given) of the order by ``by`` and seq, so that a (key, value) with
    much of the log takes many tasks. Each range is scanned in chunks of ``CHUNK`` ops, so a task holds no more of it; only a chunk's first and last group
    can go on in other chunks, and for these the pair (balance, lowest balance) is summed up along the chunks: two rows for each, broadcast. The scanned ranges are written
    to the shared folder, as both the sums and the ops are read from them. ``ordered``: nothing is written, both uses share the exchange, and rows come out
    in order, range by range; that is for logs that are plainly read from files, and an op whose range were not the one that was summed up stops the job.
    """
    spark, names = log.sparkSession, log.columns
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    where, op, most = [names.index(c) for c in by], names.index("op"), CHUNK

    def scanned(held: list[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        part = (rows.column("_range").to_numpy() << 32) + chunk
        rows = rows.select(names)
        for f, values in zip(LOCAL, [part, *scan(rows, where, op)]):
            rows = rows.append_column(f.name, pa.array(values))
        yield from rows.combine_chunks().to_batches(max_chunksize=10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, chunk = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                held.append(batch.slice(at, most))
                n += held[-1].num_rows
                if n >= most:
                    yield from scanned(held, chunk)
                    held, n, chunk = [], 0, chunk + 1
        if held:
            yield from scanned(held, chunk)

    ship(spark)
    # the range's number, not the task's: in a union that is another
    ranged = log.repartitionByRange(parts, *by, "seq").sortWithinPartitions(*by, "seq").withColumn("_range", F.spark_partition_id().cast("long"))
    local = ranged.mapInArrow(run, T.StructType([*log.schema.fields, *LOCAL]))
    if not ordered:
        local = written(local, "brackets")
    group = Window.partitionBy(*by)
    earlier, later = (group.orderBy(c).rowsBetween(Window.unboundedPreceding, -1) for c in (F.asc("_part"), F.desc("_part")))
    ends = local.where(F.col("_edge") & F.col("_head")).select(*by, "_part", "_n", "_total", "_low")
    ends = ends.withColumn("_before", F.coalesce(F.sum("_total").over(earlier), F.lit(0))).withColumn("_floor", F.col("_before") + F.col("_low"))
    ends = ends.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_part").alias("_p"), F.col("_n").alias("_m"), "_before", F.min("_floor").over(earlier).alias("_least"), F.min("_floor").over(later).alias("_next"))
    same = F.col("_part") == F.col("_p")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    told = local.join(F.broadcast(ends), same, "left")  # two rows for each chunk at most
    before = F.coalesce("_before", F.lit(0))
    balance = before + F.col("_run")
    ahead = F.least(before + F.col("_ahead"), F.col("_next"))  # nulls don't count
    behind = F.least(F.lit(0), before + F.col("_behind"), F.col("_least"))
    alive = F.when(F.col("op") == "I", ahead >= balance).otherwise(balance < behind)
    strange = F.col("_edge") & ~F.col("_n").eqNullSafe(F.col("_m"))
    return told.withColumn("alive", F.when(strange, F.raise_error(F.lit("the ranges of the log were read anew with other bounds")).cast("boolean")).otherwise(alive)).select(*names, "alive")


def live(log: DataFrame, parts: int | None = None, ordered: bool = False) -> DataFrame:
    """Inserts that live."""
    return brackets(log, parts, ordered=ordered).where((F.col("op") == "I") & F.col("alive")).drop("alive")


def unmatched(log: DataFrame) -> DataFrame:
    """Deletes that found nothing: a flush keeps them for older levels."""
    return brackets(log).where((F.col("op") != "I") & F.col("alive")).drop("alive")


def drop_tagged(df: DataFrame, tags: DataFrame, on: list[str]) -> DataFrame:
    """Records without a tag in ``tags``; Spark broadcasts the tags only if they are small."""
    return df.join(tags.select(*on).distinct(), on, "left_anti")


def found(requests: DataFrame, df: DataFrame, on: list[str]) -> DataFrame:
    """Delete requests with ``found``: 1 if a record is there, else 0."""
    there = df.select(*on).distinct().withColumn("_there", F.lit(1))
    return requests.join(there, on, "left").withColumn("found", F.coalesce("_there", F.lit(0))).drop("_there")


def met(requests: DataFrame, df: DataFrame) -> DataFrame:
    """Delete requests (seq, key, value) with ``found``: 1 if one meets a record of ``df`` (key, value, seq) of its own, as tombstones do."""
    columns = ("seq", "key", "value")
    both = df.select(*columns, F.lit("I").alias("op")).unionByName(requests.select(*columns, F.lit("T").alias("op")))
    return brackets(both).where("op = 'T'").select(*columns, (~F.col("alive")).cast("int").alias("found"))


def deleted_later(log: DataFrame) -> DataFrame:
    """Inserts with ``deleted``: whether a later tombstone has met them, as a sample checks it."""
    return brackets(log).where(F.col("op") == "I").withColumn("deleted", ~F.col("alive")).drop("alive")


def accept(log: DataFrame, size: int, cap: int) -> DataFrame:
    """Ops with ``accepted``: within each buffer of ``size`` ops, tombstones beyond ``cap`` are refused."""
    buffer = F.floor(F.col("seq") / size)
    nth = F.sum(F.when(F.col("op") == "T", 1).otherwise(0)).over(Window.partitionBy(buffer).orderBy("seq"))
    return log.withColumn("accepted", (F.col("op") != "T") | (nth <= cap))
