"""Connected components of an edge table, by label spreading with pointer jumping.

Labels and edges stay in Spark tables; each round is written to the shared folder, so lineage stays short and a lost
executor costs one round.  Rounds grow with the logarithm of the longest path, as every round also replaces a label
by the label's own label.  Labels of hubs and labels of many nodes are broadcast, so no node's edges meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hot_bound, join_unique


def components(edges: DataFrame, scratch: Scratch, name: str = "labels") -> DataFrame:
    """(node, component) for every end of an edge (a, b); component is the least node that can be reached.

    Null ends and loops are ignored; repeated edges do no harm; no edges give no rows.
    """
    both = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    both = scratch.save(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    bound = hot_bound(both.count())
    hubs = scratch.save(both.groupBy("b").count().where(F.col("count") > bound).select("b"), f"{name}-hubs")
    now = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-0")
    step = 0
    while True:
        step += 1
        labels = now.select(F.col("node").alias("b"), "label")
        near = join_unique(both, labels, labels.join(F.broadcast(hubs), "b", "left_semi"), ["b"], ["a"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        spread = scratch.save(near.join(now, "node").select("node", "label", F.least("near", "label").alias("best")), f"{name}-spread-{step}")
        # many nodes may have one label by now
        popular = spread.groupBy("best").count().where(F.col("count") > bound).select("best")
        jump = now.select(F.col("node").alias("best"), F.col("label").alias("further"))
        further = join_unique(spread, jump, jump.join(F.broadcast(popular), "best", "left_semi"), ["best"], ["node"])
        least = F.least("best", F.coalesce("further", "best"))
        nxt = scratch.save(further.select("node", least.alias("label"), (least < F.col("label")).alias("moved")), f"{name}-{step}")
        moved = nxt.where("moved").limit(1).count()
        scratch.drop(f"{name}-spread-{step}")
        scratch.drop(f"{name}-{step - 1}")
        now = nxt.select("node", "label")
        if not moved:
            scratch.drop(f"{name}-edges")
            scratch.drop(f"{name}-hubs")
            return now.withColumnRenamed("label", "component")
