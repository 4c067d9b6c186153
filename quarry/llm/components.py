"""Connected components of links between integer ids, kept distributed throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, materialize


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of links(a, b); component is the smallest node reachable.

    Each round gives every node the smallest label among itself and its neighbours, then follows the label's own
    label (pointer jumping), so a chain of n links takes about log n rounds. Labels live in a written table;
    nothing is collected but the count of changes. Links are few a node where their maker hands over
    spanning trees; joins on a label many nodes share are plain joins that adaptive execution can split.
    """
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "links")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        hooked = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        hooked = materialize(hooked, "labels")
        jump = hooked.select(F.col("node").alias("via"), F.col("label").alias("far"))
        after = materialize(hooked.join(jump, hooked.label == jump.via, "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        changed = after.where("label != old").limit(1).count()
        discard(labels, hooked)
        labels = after
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    discard(both)
    return labels.select("node", F.col("label").alias("component"))
