"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ship import ship

#: Lower-cases A-Z only.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a space.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: The white space of ``[\x20\x09-\x0D]``, which is also what bytes.split() splits at.
SPACES = b" \t\n\v\f\r"


def plain_words(raw: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes, A-Z lower-cased."""
    return raw.translate(LOWER).split()


def alnum_words(raw: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 bytes, A-Z lower-cased."""
    return raw.translate(ALNUM).split()


class WordHashes(dict):
    """64-bit hashes of words, kept for the words seen last."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > 500_000:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data by Spark's own reader, so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the id and the text, under fixed names; whatever else ``docs`` has can't clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def by_batch(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str, most: int = 1 << 30) -> DataFrame:
    """mapInArrow with a function that ``make`` builds once in each task, and that gets ``most`` rows at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                if (out := f(batch.slice(at, most))) is not None:
                    yield out

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, None for null."""
    return column.cast(pa.binary()).to_pylist()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, which driver and executors share.

    Where the setting is missing (a plain local session) a folder of the warehouse is used,
    which is shared wherever tables can be written at all.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: the lineage ends there and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete what ``stored`` wrote once nothing reads it any more."""
    spark = df.sparkSession
    for file in {re.sub(r"/[^/]*$", "", f) for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def attach(docs: DataFrame, name: str, make: Callable[[], Callable[[list[bytes | None]], dict[str, pa.Array]]], fields: str, text_col: str = "text") -> DataFrame:
    """``docs`` with one struct column ``name`` more, which a function of the batch's texts makes.

    ``make`` builds that function once in each task. All other columns go through untouched.
    """
    from pyspark.sql.types import StructField, StructType

    extra = StructType.fromDDL(fields)
    schema = StructType([*docs.schema.fields, StructField(name, extra)])
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            if batch.num_rows:
                made = f(raw_texts(batch.column(where)))
                struct = pa.StructArray.from_arrays([made[x.name] for x in extra.fields], [x.name for x in extra.fields])
                yield pa.RecordBatch.from_arrays([*batch.columns, struct], [*batch.schema.names, name])

    ship(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def new_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def held_out(id_col: Column, parts: int, at: int) -> Column:
    """Whether a row is never learned from: crc32 of the id as text modulo ``parts`` is ``at``; a null id counts as ''."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % parts == at


def by_task(df: DataFrame, make: Callable[[], tuple[Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], Callable[[], Iterator[pa.RecordBatch]]]], schema: str) -> DataFrame:
    """mapInArrow with state that lives as long as a task: ``make`` gives what takes a batch and what ends the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, finish = make()
        for batch in batches:
            if batch.num_rows:
                yield from add(batch)
        yield from finish()

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
