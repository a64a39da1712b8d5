"""Connected components of a link table, by smallest label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, component) of every node in links (a, b); component is its smallest node.

    Each round takes the smallest label among neighbours, then the label of that label, so chains
    shrink by more than half a round. Each round is written to the shared folder. A node with very
    many links costs no more than its links: minima are taken before the shuffle, and the
    lookups are joins whose skewed side Spark splits. No links give no nodes.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("c")).select("node", F.least("node", "c").alias("c")), "labels")
    for _ in range(most_rounds):
        around = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("c").alias("m"))
        nearer = labels.join(around, labels.node == around.a).select("node", F.col("c").alias("was"), F.least("c", "m").alias("c"))
        jump = labels.select(F.col("node").alias("at"), F.col("c").alias("next"))
        labels = written(nearer.join(jump, F.col("c") == F.col("at"), "left").select("node", "was", F.coalesce(F.least("c", "next"), "c").alias("c")), "labels")
        if not labels.filter("c <> was").limit(1).count():
            return labels.select("node", F.col("c").alias("component"))
        labels = labels.select("node", "c")
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
