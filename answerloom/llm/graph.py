"""Connected components over links, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle


def components(links: DataFrame) -> DataFrame:
    """node and component, the smallest node reachable, for every node of `links` (columns a, b; settled).

    Each round hands every node the least label among itself and its neighbours, then follows that label once
    (pointer jumping), so the rounds grow with the logarithm of the longest path. Runs jobs until nothing changes.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = settle(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near.withColumnRenamed("a", "node"), "node", "left").select(
            "node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        moved = settle(lower.join(jump, "label", "left").select("node", "old", F.coalesce("next", "label").alias("label")))
        labels = moved.select("node", "label")
        if moved.filter("label <> old").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
