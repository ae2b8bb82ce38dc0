"""Connected components by the least label, over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.session import cut, drop_cut

MOST_ROUNDS = 40


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (src, dst): component is the least node that can be reached.

    Every round takes the least label among the neighbours and then jumps to that label's own label, so chains halve.
    Each round's table is written once and the one before deleted.
    """
    both = cut(edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = cut(both.groupBy("src").agg(F.min("dst").alias("_m")).select(F.col("src").alias("node"), F.least("src", "_m").alias("component")))
    for _ in range(MOST_ROUNDS):
        near = both.join(labels, both["dst"] == labels["node"]).groupBy("src").agg(F.min("component").alias("_n"))
        best = labels.join(near, labels["node"] == near["src"]).select("node", F.least("component", "_n").alias("component"), (F.col("_n") < F.col("component")).alias("_moved"))
        jump = best.select(F.col("node").alias("_j"), F.col("component").alias("_f"))
        new = cut(best.join(jump, best["component"] == jump["_j"], "left").select("node", F.least("component", "_f").alias("component"), "_moved"))
        moved = new.where("_moved").limit(1).count()
        drop_cut(labels)
        labels = new.select("node", "component")
        if not moved:
            drop_cut(both)
            return labels
    raise RuntimeError("the components did not settle")
