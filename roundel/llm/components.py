"""Connected components over edges that no machine could hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b); label is the smallest node of its component.

    Each round takes the smallest label among neighbours and then the label of that label, so the
    number of rounds follows the logarithm of the longest path in practice. Every round is a table in
    the shared folder. Null ends are ignored; repeated edges and loops change nothing.
    """
    edges = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    both = stored(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
    labels = stored(labels.select("node", F.least("node", "low").alias("label")), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("low"))
        near = labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "low").alias("label"))
        above = labels.select(F.col("node").alias("label"), F.col("label").alias("over"))
        moved = near.join(above, "label").select("node", F.least("label", "over").alias("label"), (F.least("label", "over") != F.col("old")).alias("moved"))
        moved = stored(moved, "labels")
        drop(labels)
        labels = moved.select("node", "label")
        labels._roundel_path = moved._roundel_path
        if moved.where("moved").isEmpty():
            drop(both)
            return labels
