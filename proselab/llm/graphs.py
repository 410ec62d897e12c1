"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proselab.llm.common import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) of all nodes of ``edges`` (a, b).

    Each round takes the smallest of a node's label, its neighbours' labels and the label of its label, so that
    long chains shorten by half or more. Minima are taken by partial aggregation and every join's inputs are
    plain exchanges, which Spark splits where one node has a large share of the edges.
    """
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("low"))
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        lower = labels.join(near, "node").join(far, "label").select("node", F.least("label", "low", "far").alias("next"), "label")
        moved = materialise(lower.select("node", F.col("next").alias("label"), (F.col("next") != F.col("label")).alias("changed")), "labels")
        done = moved.where("changed").isEmpty()
        discard(labels)
        labels = moved
        if done:
            discard(both)
            return labels.select("node", "label")
