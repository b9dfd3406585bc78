"""Connected components by minimum-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriscope.session import staged


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) for every node of ``edges`` (u, v): the least node of its component.

    Each round takes the least label among a node and its neighbours and then the label of that label, so chains shrink
    by a constant factor a round. The labels are written to the shared folder after each round; nothing but the number
    of changes reaches the driver. A hot node's edges are many rows of one key on the streamed side of the join, which
    adaptive execution splits; minima are combined before they are shuffled.
    """
    both = staged(edges.select("u", "v").where("u <> v").union(edges.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    alone = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    labels = staged(alone.join(both.groupBy("u").agg(F.min("v").alias("m")), alone.node == F.col("u"), "left").select("node", F.least("node", "m").alias("label")), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("m"))
        met = labels.join(near, F.col("node") == F.col("u"), "left").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("far"))
        following = staged(met.join(jump, met.label == F.col("at"), "left").select("node", "old", F.least("label", "far").alias("label")), "labels")
        changed = following.where("label <> old").limit(1).count()
        labels = following.select("node", "label")
        if not changed:
            return labels
    raise RuntimeError(f"labels still changed after {rounds} rounds")
