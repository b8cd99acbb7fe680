"""Tab-separated record files: value, key, weight."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import coordinate_key


def parsed(lines: DataFrame, coordinates: bool = False, column: str = "value") -> DataFrame:
    """Lines as key, value, weight and the line itself; all three are null where a line doesn't consist of three
    fields that parse. ``coordinates``: keys are degrees."""
    fields = F.split(column, "\t")
    key = coordinate_key(F.get(fields, F.lit(1)).try_cast("double")) if coordinates else F.get(fields, F.lit(1)).try_cast("long")
    out = lines.select(F.col(column).alias("line"), F.struct(key.alias("key"), F.get(fields, F.lit(0)).try_cast("long").alias("value"), F.get(fields, F.lit(2)).try_cast("long").alias("weight"), F.size(fields).alias("n")).alias("r"))
    good = (F.col("r.n") == 3) & F.col("r.key").isNotNull() & F.col("r.value").isNotNull() & F.col("r.weight").isNotNull()
    return out.select(*[F.when(good, F.col(f"r.{c}")).alias(c) for c in ("key", "value", "weight")], "line")


def read_records(spark: SparkSession, path: str, coordinates: bool = False, limit: int | None = None) -> DataFrame:
    """Records of the files at ``path``; lines that don't parse are left out (``malformed`` has them)."""
    out = parsed(spark.read.text(path), coordinates).where("key is not null").drop("line")
    return out.limit(limit) if limit is not None else out


def malformed(spark: SparkSession, path: str, coordinates: bool = False) -> DataFrame:
    """The lines of the files at ``path`` that don't parse; an empty line is one."""
    return parsed(spark.read.text(path), coordinates).where("key is null").select("line")


def write_records(df: DataFrame, path: str) -> None:
    df.select("value", "key", "weight").write.option("sep", "\t").csv(path)


def record_stream(spark: SparkSession, path: str, files_at_once: int = 1, coordinates: bool = False) -> DataFrame:
    """Files of records as a stream of micro-batches of ``files_at_once`` files: key, value, weight (null where malformed) and line."""
    return parsed(spark.readStream.option("maxFilesPerTrigger", files_at_once).text(path), coordinates)


def key_bounds(df: DataFrame) -> DataFrame:
    """One row: count, smallest and largest key."""
    return df.agg(F.count("*").alias("n"), F.min("key").alias("min_key"), F.max("key").alias("max_key"))


def batches(log: DataFrame, size: int) -> DataFrame:
    """An op log with the number of its batch of ``size`` ops."""
    return log.withColumn("batch", F.floor(F.col("seq") / size).cast("long"))


def pairs(df: DataFrame, with_value: bool = True) -> DataFrame:
    """Records as ((key, value), weight), or (key, weight), as tree baselines take them."""
    return df.select(F.struct("key", "value").alias("pair"), "weight") if with_value else df.select("key", "weight")


def table_stream(spark: SparkSession, path: str, schema, files_at_once: int = 1) -> DataFrame:
    """Parquet files as a stream of micro-batches."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)
