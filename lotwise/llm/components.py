"""Connected components of an edge table of any size, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of ``edges`` (u, v long): nodes share a label if they are connected.

    Each round, every node joins its smallest neighbour if that is smaller than itself, and the
    edges are redrawn between what remains. Node ids that are hashes make this halve the nodes
    in expectation, whatever the shape; stars around their smallest node take one round. All
    steps are aggregations with partial sums and joins whose large partitions can be split; each
    round's result is written to the shared folder.
    """
    pair = (F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    current = stored(edges.where("u != v").select(*pair).distinct(), "edges")
    labels = None
    while not current.isEmpty():
        both = current.select("u", "v").union(current.select(F.col("v"), F.col("u")))
        joins = stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("to")), "joins")
        merged = joins.select(F.col("u").alias("node"), F.col("to").alias("label")) if labels is None else labels.join(joins, labels["label"] == joins["u"], "left").select("node", F.coalesce("to", "label").alias("label"))
        new_labels = stored(merged, "labels")
        left = current.join(joins.select("u", F.col("to").alias("a")), "u").select("a", "v")
        redrawn = left.join(joins.select(F.col("u").alias("v"), F.col("to").alias("b")), "v").where("a != b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
        after = stored(redrawn, "edges")
        for old in (current, joins, labels):
            if old is not None:
                drop_stored(old)
        current, labels = after, new_labels
    if labels is None:
        return current.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels
