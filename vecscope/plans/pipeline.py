"""The three workflows as one plan each: preprocess, hardness of given queries, and an evenly hard workload."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import effort, graphs, workload
from ..operators.search import count_target


@dataclass(frozen=True)
class Settings:
    k: int = 50
    recall: float = 0.98
    prob: float = 0.98
    k_cand: int = 2047
    method: str = "mrng"
    gt_depth: int = 50_000
    components: int = 4
    n_queries: int = 50_000
    size: int = 10_000
    bins: int = 50
    trim_low: int = 10
    trim_high: int = 800
    normalized: bool = True
    seed: int = 7

    @property
    def r(self) -> int:
        return count_target(self.recall, self.k)

    @property
    def p(self) -> int:
        return count_target(self.prob, self.k)

    def but(self, **changes) -> Settings:
        return replace(self, **changes)


def preprocess(base: DataFrame, s: Settings) -> tuple[DataFrame, workload.Mixture]:
    """The pruned graph of the base, and a mixture fitted on it."""
    return graphs.build_graph(base, s.method, s.k_cand), workload.fit_mixture(base, s.components, s.seed, normalized=s.normalized)


def query_hardness(base: DataFrame, query: DataFrame, edges: DataFrame, s: Settings) -> DataFrame:
    """(q_id, delta0, me) of each query."""
    ranks = (*[n for n in effort.RANKS if n and n < s.gt_depth], s.gt_depth)
    return effort.hardness(effort.Lists(base, query, s.gt_depth), edges, s.k, s.r, s.p, ranks=ranks)


def benchmark(spark: SparkSession, base: DataFrame, edges: DataFrame, model: workload.Mixture, s: Settings) -> DataFrame:
    """(q_id, me, bin, v): an evenly hard choice among samples of the model; one sample serves all steps."""
    sample = workload.sample_mixture(spark, model, s.n_queries, s.seed, normalized=s.normalized)
    seen = base.select("vec_id", V.normalize(F.col("v")).alias("v")) if s.normalized else base
    hard = query_hardness(seen, sample, edges, s)
    return workload.stratified(hard, "me", s.size, s.bins, s.trim_low, s.trim_high).join(sample, "q_id")
