"""The record model: schemas, weight coercion, coordinate keys, and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType()}


def struct(ddl: str) -> T.StructType:
    """A schema from "name kind, ..."; unlike Spark's own parser, it needs no session."""
    return T.StructType([T.StructField(n, KINDS[k]) for n, k in (x.split() for x in ddl.split(","))])


OP = struct("seq long, key long, value long, weight long, op string")
RECORD = struct("key long, value long, weight long, seq long, is_tombstone boolean, is_deleted boolean")
SHARD = struct("key long, value long, weight long, seq long, is_tombstone boolean, is_deleted boolean, level int, shard int")
ALIAS = struct("level int, shard int, slot int, prob double, alias int")
SAMPLE = struct("draw long, key long, value long, weight long")


def coerce_weight(weight: Column, scale: int = 1) -> Column:
    """An exact integer weight: rounded at ``scale`` steps to the unit; negative, NaN and null weights stop the query."""
    scaled = F.round(weight.cast("double") * scale)
    bad = weight.isNull() | F.isnan(weight.cast("double")) | (weight.cast("double") < 0)
    return F.when(bad, F.raise_error(F.lit("weights must be numbers of 0 or more")).cast("long")).otherwise(scaled.cast("long"))


def coordinate_key(x: Column) -> Column:
    """A coordinate in degrees as a key: (x + 180) * 10^7, cut to an integer."""
    return ((x + F.lit(180.0)) * F.lit(1e7)).cast("long")


def records(df: DataFrame, key: str, value: str, weight: Column, *more: str) -> DataFrame:
    """Any table as (key, value, weight), with further columns kept."""
    return df.select(F.col(key).cast("long").alias("key"), F.col(value).cast("long").alias("value"), weight.alias("weight"), *more)


def op_log(df: DataFrame, seq: str, key: Column, value: Column, weight: Column, op: Column) -> DataFrame:
    """Any table as an op log: I inserts, T is a tombstone and D a tag delete; only inserts have weight."""
    return df.select(F.col(seq).cast("long").alias("seq"), key.cast("long").alias("key"), value.cast("long").alias("value"), F.when(op == "I", weight).otherwise(F.lit(0)).cast("long").alias("weight"), op.alias("op"))
