"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (a, b): the smallest node that it is connected with.

    Rounds of two steps, until no label changes: a node takes the smallest label among its neighbours' and its own, and then the label of
    its label. Chains of labels halve every round. Each round's labels are a written table; only a count comes to the driver.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        taken = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("via"))
        step = taken.join(labels.select(F.col("node").alias("via"), F.col("component").alias("_far")), "via", "left").select("node", "old", F.least("via", F.coalesce("_far", "via")).alias("component"))
        step = written(step)
        if step.where("component <> old").isEmpty():
            return step.select("node", "component")
        labels = step.select("node", "component")
