"""Connected components of links between ids, wholly in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, materialize, release

#: Labels that a broadcast may hold: 16 bytes each, 8 MB at most. Beyond it only those of components with more than one of so
#: many nodes are, which can't be more than this; the rest are joined by a shuffle, none of them large.
BROADCAST_NODES = 500_000


def _label_of_label(pulled: DataFrame, labels: DataFrame, nodes: int) -> DataFrame:
    """``pulled(node, before, component)`` with the label that its component has; a giant component isn't gathered in a task."""
    roots = labels.select(F.col("node").alias("component"), F.col("component").alias("root"))
    if nodes <= BROADCAST_NODES:
        return pulled.join(F.broadcast(roots), "component")
    pulled = materialize(pulled, "pulled")
    named = pulled.groupBy("component").count().join(roots, "component")
    large = F.col("count") * BROADCAST_NODES > nodes
    marked = pulled.join(F.broadcast(named.filter(large).drop("count")), "component", "left")
    rest = marked.filter("root IS NULL").drop("root").join(named.filter(~large).drop("count"), "component")
    return marked.filter("root IS NOT NULL").unionByName(rest)


def connected_components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` (materialised) -> ``(node, component)``: the smallest id that each linked id reaches.

    Each round takes the smallest label among neighbours (a partial aggregate, so a hub with very many links is
    summed before the shuffle) and then the label of the label, until no label changes. Ids without links don't occur.
    """
    edges = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("component")), "labels")
    nodes = labels.count()
    while True:
        known = labels.withColumnRenamed("node", "b")
        near = edges.join(F.broadcast(known) if nodes <= BROADCAST_NODES else known, "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("low"))
        pulled = labels.join(near, "node").select("node", F.col("component").alias("before"), F.least("component", "low").alias("component"))
        new = materialize(_label_of_label(pulled, labels, nodes).select("node", "before", F.col("root").alias("component")), "labels")
        drop_scratch(labels)
        labels = new.select("node", "component")
        if not new.filter("component < before").count():
            release(links.sparkSession)
            return labels
