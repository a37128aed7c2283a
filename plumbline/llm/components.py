"""Connected components of a graph that may have nodes with very many edges, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import discard, staged


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the least node reachable) for each node of the edges (two long columns).

    Each round takes the least label among neighbours and then the label of that label, so that long
    chains shrink by more than half; edges inside a component are dropped. Labels of a round are a
    written table: an executor lost in a round costs that round.
    """
    links = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b")
    links = staged(links.union(links.select("b", "a")), "links")
    at = staged(links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "node"), "labels")
    labels = at
    while True:
        near = links.join(labels.select(F.col("node").alias("b"), F.col("component").alias("other")), "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        least = labels.join(near, "node").select("node", "component", F.least("component", "other").alias("found"))
        up = labels.select(F.col("node").alias("found"), F.col("component").alias("above"))
        after = staged(least.join(up, "found").select("node", F.least("found", "above").alias("component"), (F.least("found", "above") < F.col("component")).alias("moved")), "labels")
        discard(at)
        at, labels = after, after.select("node", "component")
        if after.filter("moved").isEmpty():
            discard(links)
            return labels
