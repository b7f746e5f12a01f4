"""Connected components of an edge table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, comp) for all nodes of the edges (a, b); comp is the smallest node of the component.

    Each round takes the smallest label among a node's neighbours, then the label of that label, until nothing changes: the
    number of rounds grows with the logarithm of the longest path.  Labels are combined before each shuffle and written to
    the shared folder, so lost executors cost one round at most.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = stored(both, "edges")
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("best"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("comp").alias("was"), F.least("comp", "best").alias("comp"))
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        new = step.join(up, "comp", "left").select("node", "was", F.least("comp", F.coalesce("top", "comp")).alias("comp"))
        new = stored(new, "labels")
        labels = new.select("node", "comp")
        if new.where("comp <> was").isEmpty():
            return labels
