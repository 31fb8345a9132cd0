"""Connected components by min-label rounds with pointer jumping, all in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch

#: Parts that the members of one label are dealt over.
SALTS = 16


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node reachable.

    Each round takes the smallest label among a node and its neighbours, then the label of
    that label, so a chain of length n needs about log n rounds. An edge whose ends already
    agree is dropped: the rounds work on what is left. No edges give no rows.
    """
    live = scratch.write(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = scratch.write(live.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")))
    while True:
        at_b = live.join(labels.select(F.col("node").alias("b"), F.col("component").alias("label_b")), "b")
        offers = at_b.groupBy(F.col("a").alias("node")).agg(F.min("label_b").alias("offer"))
        # An offer also goes to the node's present label, which may stand for many nodes.
        hooked = labels.join(offers, "node")
        roots = hooked.groupBy(F.col("component").alias("node")).agg(F.min(F.least("offer", "component")).alias("root_offer"))
        lowered = scratch.write(labels.join(roots, "node", "left").join(offers, "node", "left").select(
            "node", F.least("component", "root_offer", "offer").alias("component")))  # least() skips nulls
        # Only nodes that are labels have a label to go on to, and of those only the ones that moved. A label may stand for
        # a third of all nodes: its members are dealt over SALTS parts, and the few labels go to each.
        held = lowered.select(F.col("component").alias("node")).distinct()
        up = lowered.join(held, "node", "left_semi").filter("component < node")
        up = up.select(F.col("node").alias("component"), F.col("component").alias("up"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        salted = lowered.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        jumped = scratch.write(salted.join(up, ["component", "salt"], "left").select("node", F.coalesce("up", "component").alias("component")))
        scratch.drop(lowered)
        moved = jumped.join(labels.withColumnRenamed("component", "was"), "node").filter("component < was").limit(1).count()
        scratch.drop(labels)
        labels = jumped
        if not moved:
            scratch.drop(live)
            return labels
