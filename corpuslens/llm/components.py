"""Connected components of an edge table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): every node of ``edges`` with the least node of its component.

    Each round takes the least label among a node's neighbours (pre-aggregated) and then the label's own
    label; the rounds grow with the logarithm of the longest chain. A node of very many edges, or a label of
    very many nodes, is joined apart from the others (``hot_join``). Labels are written to the shared
    folder each round. Null ends and loops are ignored; an empty table has no components.
    """
    good = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    both = written(good.select(F.col(a).alias("node"), F.col(b).alias("other")).unionByName(
        good.select(F.col(b).alias("node"), F.col(a).alias("other"))).distinct(), "edges")
    labels = written(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")),
                     "labels")
    while True:
        near = hot_join(both, labels.select(F.col("node").alias("other"), "label"), "other")
        # Neighbours tell a node their label, and a node's own label learns it as well.
        told = near.groupBy("node").agg(F.min("label").alias("seen")).join(labels, "node").select(
            "node", "label", F.least("seen", "label").alias("new"))
        hooked = written(told.select("node", "new").unionByName(
            told.select(F.col("label").alias("node"), "new")).groupBy("node").agg(
            F.min("new").alias("new")), "hooked")
        up = hooked.select(F.col("node").alias("new"), F.col("new").alias("top"))
        after = written(hot_join(hooked, up, "new", "left").select(
            "node", F.least("new", F.coalesce("top", "new")).alias("label")), "labels")
        moved = after.join(labels.withColumnRenamed("label", "old"), "node").where(
            "label <> old").limit(1).count()
        labels = after
        if not moved:
            return labels


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) after more ``links`` (a, b): only components are linked anew, not their
    nodes. Nodes that no link has touched have no row."""
    if labels is None:
        return components(links)
    for side in ("a", "b"):
        links = hot_join(links, labels.select(F.col("node").alias(side), F.col("label").alias(f"_{side}")),
                         side, "left").withColumn(side, F.coalesce(f"_{side}", side)).drop(f"_{side}")
        links = written(links, "contracted")
    found = components(links)
    moved = hot_join(labels, found.select(F.col("node").alias("label"), F.col("label").alias("_to")), "label",
                     "left").select("node", F.coalesce("_to", "label").alias("label"))
    # A component's label is one of its nodes, so what isn't in ``labels`` yet is a node by itself.
    return written(moved.unionByName(found.join(labels.select("node"), "node", "left_anti")), "labels")
