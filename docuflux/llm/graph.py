"""Connected components of an edge table, by label passing with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def components(edges: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """(node, label) for every node of `edges` (u, v); label is the component's least node.

    Each round takes the least label among the neighbours and then jumps to that label's own
    label; rounds grow with the logarithm of a component's diameter. Each round is written to
    the shared folder, which cuts the lineage. Empty edges give an empty table.
    """
    both = ws.save(
        edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(),
        f"{name}-edges",
    )
    labels = ws.save(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("label")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = (
            both.join(labels, both.v == labels.node)
            .groupBy(F.col("u").alias("n"))
            .agg(F.min("label").alias("m"))
        )
        pulled = labels.join(near, labels.node == near.n, "left").select(
            "node", F.col("label").alias("was"), F.least("label", F.coalesce("m", "label")).alias("label")
        )
        target = labels.select(F.col("node").alias("t"), F.col("label").alias("tl"))
        jumped = pulled.join(target, pulled.label == target.t, "left").select(
            "node", "was", F.least("label", F.coalesce("tl", "label")).alias("label")
        )
        new = ws.save(jumped, f"{name}-{step}")
        moved = new.filter("label <> was").limit(1).count()
        ws.drop(f"{name}-{step - 1}")
        labels = new.select("node", "label")
        if not moved:
            ws.drop(f"{name}-edges")
            return labels
