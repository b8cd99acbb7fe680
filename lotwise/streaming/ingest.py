"""Streams into an index, each micro-batch once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.rng import bits
from ..plans.store import Index

#: Places in the sequence that a micro-batch of lines takes: 512 partitions of 2^33 rows.
BATCH_BITS = 42


def started(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def ingest(stream: DataFrame, index: Index, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append each micro-batch of ops (seq, key, value, weight, op) to ``index``.

    The batch number goes into the manifest with the batch, so a replay after a failure changes
    nothing; seq comes from the source.
    """
    return started(stream, lambda df, batch: index.append(df, batch), checkpoint, once)


def ingest_lines(stream: DataFrame, index: Index, checkpoint: str, aside: str, once: bool = True) -> StreamingQuery:
    """Append each micro-batch of parsed lines (``tsv.record_stream``) to ``index`` as inserts, in the order of batches.

    Lines that don't parse are kept in the folder ``aside``, a folder for each batch (``aside``/batch=n: line); a batch that is
    replayed writes them again over the same.
    """

    def each(df: DataFrame, batch: int) -> None:
        # files may have more lines than their splits tell, so the lines are read once
        df = df.persist()
        try:
            df.where("key is null").select("line").write.mode("overwrite").parquet(f"{aside}/batch={batch}")
            seq = F.lit(batch << BATCH_BITS) + F.monotonically_increasing_id()
            few = df.where("key is not null").coalesce(1 << (BATCH_BITS - 33))
            index.append(few.select(seq.alias("seq"), "key", "value", "weight", F.lit("I").alias("op")), batch)
        finally:
            df.unpersist()

    return started(stream, each, checkpoint, once)


def interleave(stream: DataFrame, index: Index, checkpoint: str, deletes: int, batches_per_pool: int = 15, seed: int = 1, once: bool = True) -> StreamingQuery:
    """Append each micro-batch of inserts (seq, key, value, weight) with deletes of records that are drawn from what lives then.

    Every ``batches_per_pool`` batches, a pool of ``deletes`` * ``batches_per_pool`` draws is taken from the index as it is before the batch,
    each record once, and kept beside the index; each batch deletes its share of them. A delete comes right before a random insert of
    the batch. Inserts get seq 2 * seq, deletes odd ones. What a batch does follows from its number and the index before
    it, so a replay changes nothing.
    """

    def each(df: DataFrame, batch: int) -> None:
        if index._has(batch):
            return
        cycle, turn = divmod(batch, batches_per_pool)
        path = f"{index.path}/pool-{cycle}"
        if turn == 0:
            drawn = index.sample(deletes * batches_per_pool, seed + cycle)
            drawn.groupBy("key", "value", "weight").agg(F.min("draw").alias("draw")).write.mode("overwrite").parquet(path)
            index.handed = [h for h in index.handed if not h[0].startswith("pool-")] + [[f"pool-{cycle}", index.version + 1]]
        else:
            for h in index.handed:
                if h[0] == f"pool-{cycle}":
                    h[1] = index.version + 1  # still in use
        span = df.agg(F.min("seq").alias("a"), F.count("*").alias("n")).first()
        put = df.select((F.col("seq") * 2).alias("seq"), "key", "value", "weight", F.lit("I").alias("op"))
        if span.n:
            mine = index.spark.read.parquet(path).where(F.expr(f"draw div {deletes}") == turn)
            at = F.lit(span.a) + bits(seed, "when", batch, F.col("draw")) % span.n
            put = put.unionByName(mine.select((at * 2 - 1).alias("seq"), "key", "value", F.lit(0).cast("long").alias("weight"), F.lit("D" if index.config.deletes == "tag" else "T").alias("op")))
        index.append(put, batch)

    return started(stream, each, checkpoint, once)
