"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, component)`` of every node in ``links (a, b)``; the component is its smallest node.

    Every round takes the least label of a node's neighbours and then jumps to
    that label's own label, so paths shorten by a factor each time. Each round
    is cut by a checkpoint; the driver sees one count.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("node"), "label"))
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("next"))
        jump = lower.select(F.col("node").alias("next"), F.col("next").alias("far"))
        new = cut(lower.join(jump, "next").select("node", F.least("next", "far").alias("new"), "label"))
        labels = new.select("node", F.col("new").alias("label"))
        if new.where("new <> label").isEmpty():
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
