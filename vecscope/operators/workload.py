"""Workloads: mixture models of the base, samples from them, and query sets with evenly spread hardness."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from .graphs import mixed


@dataclass(frozen=True)
class Mixture:
    """Weights, means and covariances of a fitted model."""

    weights: np.ndarray
    means: np.ndarray
    covs: np.ndarray

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, float(w), m.tolist(), c.ravel().tolist()) for i, (w, m, c) in enumerate(zip(self.weights, self.means, self.covs, strict=True))]
        spark.createDataFrame(rows, "component int, weight double, mean array<double>, cov array<double>").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Mixture:
        rows = spark.read.parquet(path).orderBy("component").collect()
        d = len(rows[0]["mean"])
        return cls(np.array([r["weight"] for r in rows]), np.array([r["mean"] for r in rows]), np.array([r["cov"] for r in rows]).reshape(-1, d, d))


def fit_mixture(base: DataFrame, components: int = 4, seed: int = 7, rounds: int = 30, normalized: bool = True) -> Mixture:
    """A full-covariance Gaussian mixture, fitted by Spark ML on the (normalised) base."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector

    v = V.normalize(F.col("v")) if normalized else V.as_double(F.col("v"))
    m = GaussianMixture(k=components, seed=seed, maxIter=rounds).fit(base.select(array_to_vector(v).alias("features")))
    rows = m.gaussiansDF.collect()  # one row for each component
    return Mixture(np.array(m.weights), np.array([r["mean"].toArray() for r in rows]), np.array([r["cov"].toArray() for r in rows]))


def sample_mixture(spark: SparkSession, model: Mixture, n: int, seed: int = 7, slices: int = 64, normalized: bool = True) -> DataFrame:
    """query(q_id, v): n draws.  A fixed number of slices each have a seed of their own, so retries repeat them."""
    roots = np.array([np.linalg.cholesky(c + 1e-9 * np.eye(len(c))) for c in model.covs])
    sent = spark.sparkContext.broadcast((np.cumsum(model.weights / model.weights.sum()), model.means, roots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cum, means, roots = sent.value
        for b in batches:
            for s in b.column(0).to_pylist():
                rng = np.random.default_rng([seed, s])
                lo, hi = s * n // slices, (s + 1) * n // slices
                for at in range(lo, hi, 4096):
                    size = min(4096, hi - at)
                    c = np.minimum(np.searchsorted(cum, rng.random(size)), len(cum) - 1)
                    x = means[c] + np.einsum("ijk,ik->ij", roots[c], rng.normal(size=(size, means.shape[1])))
                    if normalized:
                        x /= np.maximum(np.linalg.norm(x, axis=1), V.ZERO_NORM)[:, None]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + size)), pa.array(x.tolist(), pa.list_(pa.float64()))], ["q_id", "v"])

    return spark.range(slices).repartition(min(slices, 64)).mapInArrow(run, "q_id long, v array<double>")


def trimmed(hardness: DataFrame, col: str = "me", low: int = 10, high: int = 800) -> DataFrame:
    """hardness without its `low` least and `high` greatest rows; ties by query."""
    n = hardness.count()
    order = [F.col(col).asc(), F.col("q_id").asc()]
    # only the two ends are sorted: both are of stated size
    first = hardness.orderBy(*order).limit(low).select("q_id")
    last = hardness.orderBy(*[F.col(col).desc(), F.col("q_id").desc()]).limit(min(high, max(0, n - low))).select("q_id")
    return hardness.join(F.broadcast(first.union(last)), "q_id", "left_anti")


def with_bins(hardness: DataFrame, col: str = "me", bins: int = 50) -> DataFrame:
    """hardness with `bin` from 1: equal widths over [min, max], each open below except the first."""
    lim = hardness.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi"))
    edges = F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda j: F.col("lo") + j * (F.col("hi") - F.col("lo")) / bins) if bins > 1 else F.array().cast("array<double>")
    lim = lim.select(edges.alias("edges_"))
    return hardness.crossJoin(F.broadcast(lim)).withColumn("bin", F.size(F.filter("edges_", lambda e: e < F.col(col))) + 1).drop("edges_")


def stratified(hardness: DataFrame, col: str = "me", size: int = 10_000, bins: int = 50, low: int = 10, high: int = 800, seed: int = 3) -> DataFrame:
    """(q_id, col, bin): after trimming, size // bins queries of each bin without replacement, all of a smaller bin."""
    binned = with_bins(trimmed(hardness.select("q_id", col), col, low, high), col, bins)
    w = Window.partitionBy("bin").orderBy(mixed("q_id", seed), "q_id")
    return binned.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= size // bins).drop("nth")


def carry_gt(gt: DataFrame, chosen: DataFrame) -> DataFrame:
    """The neighbour lists of the chosen queries."""
    return gt.join(chosen.select("q_id"), "q_id", "left_semi")


def without_outliers(hardness: DataFrame, col: str = "me", most: float = 70_000) -> DataFrame:
    return hardness.where(F.col(col) < most)


def random_subset(rows: DataFrame, key: str, n: int, seed: int = 3) -> DataFrame:
    """n rows without replacement, by a pseudo-random order of the key."""
    return rows.orderBy(mixed(key, seed), key).limit(n)
