"""Connected components by smallest label, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiresift.scratch import drop, keep

#: Rounds after which something is wrong; each about halves the depth of what is left.
MOST_ROUNDS = 64


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that can be reached over ``edges``, of each node that has one.

    Null ends and loops are no edges. Each round takes the smallest label of
    all neighbours and then the label of that label, so long chains fold in a
    logarithmic number of rounds; its table is written to the shared folder.
    """
    one = edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    both = keep(one.union(one.select("dst", "src")).distinct(), "component-edges")
    held = keep(both.groupBy("src").agg(F.min("dst").alias("least")).select(F.col("src").alias("node"), F.least("src", "least").alias("label")), "component-labels")
    for _ in range(MOST_ROUNDS):
        labels = held.select("node", "label")
        near = both.join(labels.select(F.col("node").alias("dst"), "label"), "dst").groupBy("src").agg(F.min("label").alias("least"))
        hooked = labels.join(near, F.col("node") == F.col("src")).select("node", "label", F.least("label", "least").alias("hooked"))
        above = labels.select(F.col("node").alias("up"), F.col("label").alias("up_label"))
        moved = keep(hooked.join(above, F.col("hooked") == F.col("up"), "left").select("node", F.least("hooked", "up_label").alias("label"), (F.least("hooked", "up_label") < F.col("label")).alias("changed")), "component-labels")
        drop(held)
        held = moved
        if moved.where("changed").isEmpty():
            drop(both)
            return moved.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"components: still changing after {MOST_ROUNDS} rounds")
