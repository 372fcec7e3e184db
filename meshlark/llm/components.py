"""Connected components of a graph of links, by DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``; a component is named by its smallest node.

    Every round takes the smallest label around a node, then the label's own
    label, so that chains shorten by powers of two.  A node's links are never
    gathered in one place: minima are taken on the map side first.
    """
    both = materialize(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("component")), "labels")
    while True:
        around = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        nearer = labels.join(around, "node").select("node", "component", F.least("component", "near").alias("near"))
        jump = labels.select(F.col("node").alias("j_node"), F.col("component").alias("jump"))
        step = nearer.join(jump, F.col("near") == F.col("j_node")).select("node", F.least("near", "jump").alias("component"), F.col("component").alias("before"))
        labels = materialize(step, "labels")
        if not labels.where("component <> before").limit(1).count():
            return labels.select("node", "component")
        labels = labels.select("node", "component")
