"""Connected components as a DataFrame iteration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checkpoint import cut
from ..functions.joins import sorted_join


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links(src, dst) to (node, component): the smallest node that can be reached.

    Each round every node takes the smallest label around it, then its label's label.
    """
    both = cut(links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct())
    labels = cut(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("src"), F.min("dst")).alias("component")))
    for _ in range(rounds):
        near = sorted_join(both.select("src", F.col("dst").alias("node")), labels, ["node"]).groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        taken = sorted_join(labels, near, ["node"]).select("node", F.least("component", "near").alias("component"))
        above = taken.select(F.col("node").alias("component"), F.col("component").alias("top"))
        jumped = cut(sorted_join(taken, above, ["component"], "left").select("node", F.coalesce("top", "component").alias("component")))
        if sorted_join(jumped, labels.withColumnRenamed("component", "old"), ["node"]).where("component <> old").isEmpty():
            return jumped
        labels = jumped
    raise RuntimeError("components did not settle")
