"""A corpus pipeline: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm.bpe_codec import encode_documents
from lotwise.llm.common import drop_stored, new_name, read_table, stored
from lotwise.llm.decontam import decontaminate
from lotwise.llm.line_dedup import dedup_lines
from lotwise.llm.ngram_join import keep_one
from lotwise.llm.toxicity import drop_toxic, fit


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learned from the labelled rows of ``docs``, calls toxic go."""
    return drop_toxic(docs, fit(docs, read_table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go, and documents of which nothing else is left; n_chars follows."""
    name = new_name(docs, "_lines")
    out = dedup_lines(docs, name=name).where((F.col(f"{name}.n_removed") == 0) | (F.col(f"{name}.n_removed") < F.col(f"{name}.n_lines"))).drop(name)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: five-word shingles, similarity 0.8."""
    return keep_one(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of ten words of a benchmark item go."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text that is left, and digests of ids and decoded text."""
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("decoded")


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("ngram_join", near_duplicates),
    ("decontamination", decontamination),
    ("bpe", bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, with a written table in the shared folder between any two."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
            if before is not None:
                drop_stored(before)
            before = docs
    return docs


#: Learning, near-duplicate classes and BPE can't be said in SQL; tests hold every stage against brute force.
ORACLE_SQL = None
