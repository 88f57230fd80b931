"""Connected components of a graph given as rows, by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for the nodes of ``edges`` (a, b: bigint).

    Each round gives every node the least label among itself and its neighbours, then the label of that label, so
    the rounds grow with the logarithm of a path's length. Labels are written down each round; the driver sees one
    number. Messages to a node are reduced before the shuffle, and a node with very many edges is split by
    adaptive execution in the join.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "cc-edges")
    labels = written(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "cc-labels"
    )
    while True:
        sent = both.join(labels, both.a == labels.node).groupBy(F.col("b").alias("receiver")).agg(F.min("component").alias("heard"))
        heard = labels.join(sent, labels.node == sent.receiver).select(
            "node", F.col("component").alias("was"), F.least("component", "heard").alias("at")
        )
        roots = labels.select(F.col("node").alias("root"), F.col("component").alias("top"))
        # A label is a node of the graph, so it has a label of its own.
        new = written(
            heard.join(roots, heard["at"] == roots.root).select("node", "was", F.least("at", "top").alias("component")), "cc-labels"
        )
        labels = new.select("node", "component")
        if new.where("component <> was").isEmpty():
            return labels
