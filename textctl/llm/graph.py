"""Connected components of a large sparse graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); the component is
    its smallest node.

    Each round gives a node the smallest label among its neighbours and
    itself, then follows the labels one step (which shortens chains
    geometrically). A round is written to the shared folder; only the number
    of changed labels comes to the driver. Hubs are harmless: the minimum is
    pre-aggregated before its shuffle, and a hub's joins are splittable.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
    both = saved(both.distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component"))
    labels = saved(labels.withColumn("changed", F.lit(True)), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("least"))
        step = labels.join(near, "node").select("node", F.least("component", "least").alias("to"), F.col("component").alias("was"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("beyond"))
        new = step.join(jump, "to", "left").select("node", F.least("to", "beyond").alias("component"), "was")
        labels = saved(new.select("node", "component", (F.col("component") < F.col("was")).alias("changed")), "labels")
        if not labels.agg(F.max(F.col("changed").cast("int")).alias("c")).first()["c"]:
            return labels.select("node", "component")
