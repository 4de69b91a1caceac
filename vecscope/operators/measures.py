"""Other measures of query difficulty: aggregates over the distances of a neighbour list.

gt holds (q_id, rank, id, dist) with squared distances; `d[j]` below is the distance at rank j + 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V

TINY = 1e-5
HUGE = 1e5


def _at(rank: int, dist: str = "dist") -> Column:
    return F.max(F.when(F.col("rank") == rank, F.col(dist)))


def _ratios(gt: DataFrame, k: int) -> DataFrame:
    """The first k ranks with dk, the distance of the last of them, of fewer where a list is shorter."""
    first = gt.where(F.col("rank") <= k)
    return first.join(first.groupBy("q_id").agg(F.max_by("dist", "rank").alias("dk")), "q_id")


def lid_mle(gt: DataFrame, k: int) -> DataFrame:
    """(q_id, lid): -1 / mean(ln(d / d[k-1])) over the first k; zeros count as 1e-5, a zero mean gives 1e5."""
    safe = F.when(F.col("dist") == 0, F.lit(TINY)).otherwise(F.col("dist"))
    mean = F.avg(F.log(safe / F.when(F.col("dk") == 0, F.lit(TINY)).otherwise(F.col("dk"))))
    return _ratios(gt, k).groupBy("q_id").agg(mean.alias("m")).select("q_id", F.when(F.col("m") == 0, F.lit(HUGE)).otherwise(-1.0 / F.nullif("m", F.lit(0.0))).alias("lid"))


def lid_stable(gt: DataFrame, k: int) -> DataFrame:
    """(q_id, lid): the same estimate without distances up to 1e-5, near and far halves summed apart."""
    d, w = F.col("dist"), F.col("dk")
    term = F.when(d < w / 2, F.log(d / w)).otherwise(F.log1p((d - w) / w))
    return _ratios(gt, k).where(d > TINY).groupBy("q_id").agg((-F.count("*") / F.nullif(F.sum(term), F.lit(0.0))).alias("lid"))


def lid_exp(gt: DataFrame, k: int) -> DataFrame:
    """(q_id, value): exp(20 * product of d / d[k-1])."""
    logs = F.sum(F.log(F.nullif(F.col("dist"), F.lit(0.0)) / F.col("dk")))
    zero = F.count_if(F.col("dist") == 0) > 0
    return _ratios(gt, k).groupBy("q_id").agg(F.exp(20.0 * F.when(zero, F.lit(0.0)).otherwise(F.exp(logs))).alias("value"))


def lid_linear(gt: DataFrame, k: int) -> DataFrame:
    """(q_id, value): sum of d / d[k-1] over k."""
    return _ratios(gt, k).groupBy("q_id").agg((F.sum(F.col("dist") / F.col("dk")) / k).alias("value"))


def expansion(gt: DataFrame, k: int, rooted: bool = False) -> DataFrame:
    """(q_id, value): d[2k] / d[k], or 0 where d[k] is up to 1e-3."""
    root = (lambda c: F.sqrt(c)) if rooted else (lambda c: c)
    both = gt.groupBy("q_id").agg(root(_at(k + 1)).alias("near"), root(_at(2 * k + 1)).alias("far"))
    return both.select("q_id", F.when(F.col("near") <= 1e-3, F.lit(0.0)).otherwise(F.col("far") / F.col("near")).alias("value"))


def epsilon_hardness(gt: DataFrame, k: int, eps: float = 1.0) -> DataFrame:
    """(q_id, value): the first index whose distance exceeds (1 + eps) * d[k], else the last."""
    kth = gt.groupBy("q_id").agg(_at(k + 1).alias("dk"))
    inside = F.count_if(F.col("dist") <= (1 + eps) * F.col("dk"))
    return gt.join(kth, "q_id").groupBy("q_id").agg(F.least(inside, F.count("*") - 1).alias("value"))


def relative_contrast(gt: DataFrame, k: int, rooted: bool = False, means: DataFrame | None = None) -> DataFrame:
    """(q_id, value): mean distance over d[k]; means(q_id, mean) are over the whole base, without them gt holds it."""
    d = F.sqrt("dist") if rooted else F.col("dist")
    if means is not None:
        return gt.withColumn("x", d).groupBy("q_id").agg(_at(k + 1, "x").alias("dk")).join(means, "q_id").select("q_id", (F.col("mean") / F.col("dk")).alias("value"))
    return gt.withColumn("x", d).groupBy("q_id").agg((F.avg("x") / _at(k + 1, "x")).alias("value"))


def pairwise_distance(gt: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """(q_id, value): mean squared distance between the first k neighbours."""
    n = gt.where(F.col("rank") <= k).join(base.select(F.col("vec_id").alias("id"), "v"), "id").select("q_id", "rank", "v")
    # k vectors at most for each query
    lists = n.groupBy("q_id").agg(F.collect_list("v").alias("vs"))
    pairs = F.flatten(F.transform("vs", lambda a, i: F.transform(F.slice("vs", i + 2, F.lit(k)), lambda b: V.l2sq(a, b))))
    return lists.select("q_id", pairs.alias("d")).select("q_id", (F.aggregate("d", F.lit(0.0), lambda s, x: s + x) / F.size("d")).alias("value"))


def k_occurrence(gt: DataFrame, in_degrees: DataFrame, k: int = 50) -> DataFrame:
    """(q_id, value): mean in-degree of the first k neighbours; in_degrees(node, degree)."""
    return gt.where(F.col("rank") <= k).join(in_degrees.select(F.col("node").alias("id"), "degree"), "id").groupBy("q_id").agg(F.avg("degree").alias("value"))
