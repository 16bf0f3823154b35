"""Connected components of an edge table, kept in tables throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidegauge.llm.common import stored


def components(edges: DataFrame, root: str, name: str) -> DataFrame:
    """``(node, component)``: each node of ``edges`` ``(a, b)`` with the smallest node it reaches.

    Every round takes the smallest label among the neighbours and then the label's own label, so labels travel twice as
    far each time. A node with very many edges is met by joins, which adaptive execution splits, and by sums that are
    partly made before the shuffle. Each round's labels are written to the shared folder; only their count of changes
    comes to the driver. Loops are ignored; no edges give no rows.
    """
    # A node with several neighbours points to the least of them, and so do they: fewer distinct edges, the same components.
    links = stored(edges.where("a <> b").select("a", "b").distinct(), root, f"{name}-edges")
    least = links.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    links = links.join(least, "a")
    links = links.select(F.col("b").alias("a"), F.col("m").alias("b")).union(links.select("a", F.col("m").alias("b")))
    links = links.where("a <> b").distinct()
    links = stored(links.union(links.select("b", "a")).distinct(), root, f"{name}-links")
    labels = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
    labels = stored(labels.select("node", F.least("node", "label").alias("label")), root, f"{name}-0")
    turn = 0
    while True:
        turn += 1
        near = (
            links.join(labels, links["b"] == labels["node"])
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        step = labels.join(near, "node").select(
            "node", F.col("label").alias("was"), F.least("label", "near").alias("label")
        )
        above = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        labels = stored(
            step.join(above, "label").select(
                "node", F.least("label", "above").alias("label"), (F.least("label", "above") != F.col("was")).alias("moved")
            ),
            root,
            f"{name}-{turn}",
        )
        if labels.where("moved").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
        labels = labels.select("node", "label")
