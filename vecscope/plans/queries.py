"""The registered queries: every operator over the whole embeddings table, at parameters that suit it.

Base vectors are those whose id is not a multiple of ten, queries the others; k is 10, and 9 of 10 is both targets.
Values that are not counts are rounded to six decimals.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import effort, graphs, knn, measures, search, stats, workload
from ..sources import formats
from .tables import base_query, delete, embeddings, shared_dir

K, R, P = 10, 9, 9
CAND = 32
DEPTH = 60

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r6(c: Column | str, name: str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


def _gt(s: SparkSession, d: str, k: int = DEPTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    b, q = base_query(s, d)
    return b, q, knn.exact_knn(b, q, k)


def _edges(s: SparkSession, d: str, method: str = "mrng") -> tuple[DataFrame, DataFrame]:
    b, _ = base_query(s, d)
    return b, graphs.build_graph(b, method, CAND)


def _lists(s: SparkSession, d: str) -> tuple[effort.Lists, DataFrame]:
    """Neighbour lists over the whole base, and the pruned graph."""
    b, q = base_query(s, d)
    return effort.Lists(b, q), graphs.build_graph(b, "mrng", CAND)


def _graph_gt(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    b, q, gt = _gt(s, d, K)
    return b, q, gt, graphs.build_graph(b, "mrng", CAND)


def _hard(s: SparkSession, d: str, **how) -> DataFrame:
    gt, e = _lists(s, d)
    return effort.hardness(gt, e, K, R, P, **how)


# -- vector functions and neighbours --------------------------------------------------------------------------------
def _pair_values(s: SparkSession, d: str, value: Column) -> DataFrame:
    b, q, gt = _gt(s, d, 5)
    rows = knn.gather(gt, b).join(q.select("q_id", F.col("v").alias("qv")), "q_id")
    return rows.select("q_id", "id", r6(value, "value"))


@query
def exact_knn(s, d):
    _, _, gt = _gt(s, d)
    return gt.select("q_id", F.col("rank").cast("long").alias("rank"), "id", r6("dist", "dist"))


@query
def exact_knn_expressions(s, d):
    b, q = base_query(s, d)
    return knn.exact_knn(b, q, K, engine="sql_bounded").select("q_id", F.col("rank").cast("long").alias("rank"), "id", r6("dist", "dist"))


@query
def knn_graph(s, d):
    b, _ = base_query(s, d)
    return knn.knn_graph(b, K).select("src", F.col("pos").cast("long").alias("pos"), "dst")


@query
def mips_knn(s, d):
    b, q = base_query(s, d)
    return knn.mips_knn(b, q, K).select("q_id", F.col("rank").cast("long").alias("rank"), "id")


@query
def l2_pairs(s, d):
    return _pair_values(s, d, V.l2sq(F.col("qv"), F.col("v")))


@query
def l2_by_norms(s, d):
    return _pair_values(s, d, V.l2sq_by_norms(F.col("qv"), F.col("v")))


@query
def l2_int8(s, d):
    small = lambda c: F.transform(F.col(c), lambda x: F.round(x * 127).cast("tinyint"))
    return _pair_values(s, d, V.l2sq_int(small("qv"), small("v")).cast("double"))


@query
def inner_product(s, d):
    return _pair_values(s, d, V.inner(F.col("qv"), F.col("v")))


@query
def ip_distance(s, d):
    return _pair_values(s, d, V.ip_distance(F.col("qv"), F.col("v")))


@query
def cosine(s, d):
    return _pair_values(s, d, V.cosine(F.col("qv"), F.col("v")))


@query
def early_abandoned(s, d):
    b, q, gt = _gt(s, d, 40)
    far = gt.where("rank = 5").select("q_id", F.col("dist").alias("far"))
    rows = knn.gather(gt, b).join(q.select("q_id", F.col("v").alias("qv")), "q_id").join(far, "q_id")
    return rows.select("q_id", "id", r6(V.early_abandoned(F.col("qv"), F.col("v"), F.col("far"), 16, 0.2), "value"))


@query
def norms(s, d):
    return embeddings(s, d).select("vec_id", r6(V.norm2(F.col("v")), "norm2"))


@query
def normalized(s, d):
    return embeddings(s, d).select("vec_id", F.posexplode(V.normalize(F.col("v"))).alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), r6("x", "x"))


@query
def segment_means(s, d):
    return embeddings(s, d).select("vec_id", F.posexplode(V.segment_means(F.col("v"), 8)).alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), r6("x", "x"))


@query
def centred_length(s, d):
    b, q = base_query(s, d)
    return knn.centred_length(b, q, "q_id").select("q_id", r6("length", "length"))


@query
def neighbour_products(s, d):
    b, q, gt = _gt(s, d, K)
    return knn.neighbour_products(gt, b, q).select("q_id", F.col("rank").cast("long").alias("rank"), "id", r6("ip", "ip"))


@query
def upsert_remove(s, d):
    b, q = base_query(s, d)
    changed = q.select(F.col("q_id").alias("vec_id"), "v").union(b.where("vec_id % 7 = 1").select("vec_id", F.transform("v", lambda x: -x).alias("v")))
    gone = b.where("vec_id % 5 = 2")
    return knn.exact_knn(knn.remove(knn.upsert(b, changed), gone), q, K).select("q_id", F.col("rank").cast("long").alias("rank"), "id")


@query
def rescore(s, d):
    b, q, gt = _gt(s, d)
    shuffled = gt.where("rank <= 20").select("q_id", F.when(F.col("rank") > K, F.col("rank") - K).otherwise(F.col("rank") + K).alias("rank"), "id")
    return knn.rescore(shuffled, b, q, K).select("q_id", F.col("rank").cast("long").alias("rank"), "id", r6("dist", "dist"))


@query
def vecfile_roundtrip(s, d):
    path = f"{shared_dir(s)}/roundtrip-{uuid.uuid4().hex}"
    atexit.register(delete, s, path)
    formats.write(embeddings(s, d), path, "fvecs", 4)
    return formats.read(s, path, "fvecs").select("vec_id", F.posexplode("v").alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), r6(F.col("x").cast("double"), "x"))


# -- graphs -----------------------------------------------------------------------------------------------------------
def _graph(method: str) -> Query:
    return lambda s, d: _edges(s, d, method)[1].select("src", F.col("pos").cast("long").alias("pos"), "dst")


QUERIES |= {f"{m}_edges": _graph(m) for m in graphs.METHODS}


@query
def reverse_graph(s, d):
    return graphs.reverse(_edges(s, d)[1]).select("src", F.col("pos").cast("long").alias("pos"), "dst")


@query
def in_degree(s, d):
    b, e = _edges(s, d)
    return stats.in_degree(e, b)


@query
def out_degree(s, d):
    b, e = _edges(s, d)
    return stats.out_degree(e, b)


@query
def graph_summary(s, d):
    b, e = _edges(s, d)
    return stats.graph_summary(e, b).select("edges", "nodes", r6("avg_degree", "avg_degree"), "max_degree")


@query
def graph_quality(s, d):
    b, e = _edges(s, d)
    return stats.graph_quality(e, knn.knn_graph(b, CAND), K).select("edges", "exact_edges", r6("quality", "quality"))


@query
def node_quality(s, d):
    b, e = _edges(s, d)
    return stats.node_quality(e, knn.knn_graph(b, CAND), K)


@query
def edge_positions(s, d):
    b, e = _edges(s, d)
    return stats.edge_positions(e, knn.knn_graph(b, CAND)).select("src", "dst", F.col("position").cast("long").alias("position"))


@query
def edge_distances(s, d):
    b, e = _edges(s, d)
    return knn.edge_distances(e, b).select("src", "dst", r6("dist", "dist"))


@query
def hub_density(s, d):
    b, e = _edges(s, d)
    return stats.hub_density(e, b, 0.1).select("hubs", "links", "inner_links", r6("density", "density"))


@query
def degree_histogram(s, d):
    b, e = _edges(s, d)
    return stats.degree_histogram(stats.in_degree(e, b), 10).select(F.col("bin").cast("long").alias("bin"), "n")


@query
def degree_skewness(s, d):
    b, e = _edges(s, d)
    return stats.skewness(stats.in_degree(e, b), "degree").select(r6("skewness", "skewness"))


@query
def graph_integrity(s, d):
    b, e = _edges(s, d)
    return stats.integrity(e, b)


@query
def csr_rows(s, d):
    b, e = _edges(s, d)
    return graphs.csr(e, b).select("src", F.col("first").cast("long").alias("first"), "degree")


@query
def padded_graph(s, d):
    b, e = _edges(s, d)
    return graphs.padded(e, b, 24).select("src", F.posexplode("ids").alias("pos", "dst")).select("src", F.col("pos").cast("long").alias("pos"), "dst")


@query
def shuffled_ids(s, d):
    return graphs.shuffle_ids(embeddings(s, d))


@query
def shuffled_gt(s, d):
    b, _, gt = _gt(s, d, K)
    return graphs.shuffle_gt(gt, graphs.shuffle_ids(b)).select("q_id", F.col("rank").cast("long").alias("rank"), "id")


@query
def bfs_hops(s, d):
    return stats.bfs_distances(_edges(s, d)[1], 1).select("node", F.col("hops").cast("long").alias("hops"))


@query
def pagerank(s, d):
    b, e = _edges(s, d)
    return stats.pagerank(e, b, rounds=10).select("node", r6("rank", "rank"))


@query
def nsw_edges(s, d):
    return graphs.nsw_graph(base_query(s, d)[0])


@query
def hnsw_edges(s, d):
    return graphs.hnsw_graph(base_query(s, d)[0])


@query
def plain_hnsw_edges(s, d):
    return graphs.hnsw_graph(base_query(s, d)[0], plain=True)


# -- effort -----------------------------------------------------------------------------------------------------------
@query
def delta0(s, d):
    gt, e = _lists(s, d)
    return effort.delta0(gt, e, K, R, P)


@query
def hardness(s, d):
    return _hard(s, d)


@query
def me_touched(s, d):
    return _hard(s, d, expand=False)


@query
def me_fixed_delta(s, d):
    gt, e = _lists(s, d)
    return effort.effort_fixed_delta(gt, e, K, R, P, 30)


@query
def me_bfs(s, d):
    return _hard(s, d, path="bfs")


@query
def me_max(s, d):
    return _hard(s, d, agg="max")


@query
def me_overlap(s, d):
    return _hard(s, d, overlap=True)


@query
def me_tree(s, d):
    return _hard(s, d, path="tree")


@query
def me_flow(s, d):
    return _hard(s, d, path="flow")


@query
def me_unbounded(s, d):
    gt, e = _lists(s, d)
    return effort.effort_unbounded(gt, e, K, R, P)


@query
def k0(s, d):
    b, _, gt = _gt(s, d, 2 * K)
    return effort.k0(gt, knn.knn_graph(b, CAND), K, R, P)


# -- search -----------------------------------------------------------------------------------------------------------
@query
def beam_search(s, d):
    b, q, _, e = _graph_gt(s, d)
    return search.beam_search(q, e, b, K, 40).select("q_id", "rank", "id", r6("dist", "dist"), "ndc", "hops")


@query
def step_search(s, d):
    b, q, _, e = _graph_gt(s, d)
    return search.beam_search(q, e, b, K, 6).select("q_id", "rank", "id", r6("dist", "dist"), "ndc", "hops")


@query
def deleted_search(s, d):
    b, q, _, e = _graph_gt(s, d)
    return search.beam_search(q, e, b, K, 40, deleted=b.where("vec_id % 3 = 0")).select("q_id", "rank", "id", r6("dist", "dist"), "ndc", "hops")


@query
def hnsw_search(s, d):
    b, q = base_query(s, d)
    return search.hnsw_search(q, b, K, 40).select("q_id", "rank", "id", r6("dist", "dist"), "ndc", "hops")


@query
def recall_at_budget(s, d):
    b, q, gt, e = _graph_gt(s, d)
    return search.recall_at_budget(q, e, b, gt, K, (50, 100, 200, 400))


@query
def ef_sweep(s, d):
    b, q, gt, e = _graph_gt(s, d)
    return search.ef_sweep(q, e, b, gt, K)


@query
def least_ndc(s, d):
    b, q, gt, e = _graph_gt(s, d)
    return search.least_ndc(q, e, b, gt, K, (0.8, 0.9, 1.0))


@query
def search_trace(s, d):
    b, q, _, e = _graph_gt(s, d)
    return search.search_trace(q, e, b, K, 20)


@query
def recall_of_prefix(s, d):
    b, q, gt = _gt(s, d)
    short = lambda df: df.withColumn("v", F.slice("v", 1, 16))
    return search.recall(knn.exact_knn(short(b), short(q), K), gt, K)


@query
def result_confusion(s, d):
    b, q, gt = _gt(s, d)
    short = lambda df: df.withColumn("v", F.slice("v", 1, 16))
    return stats.result_confusion(knn.exact_knn(short(b), short(q), K), gt, K)


# -- other measures ---------------------------------------------------------------------------------------------------
def _measure(name: str, build: Callable[[DataFrame], DataFrame]) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        out = build(_gt(s, d)[2])
        return out.select("q_id", r6(F.col(out.columns[1]).cast("double"), "value"))

    run.__name__ = name
    return query(run)


_measure("lid_mle", lambda gt: measures.lid_mle(gt, K))
_measure("lid_stable", lambda gt: measures.lid_stable(gt, K))
_measure("lid_exp", lambda gt: measures.lid_exp(gt, K).select("q_id", F.round("value", 3)))  # values in the hundred thousands
_measure("lid_linear", lambda gt: measures.lid_linear(gt, K))
_measure("expansion", lambda gt: measures.expansion(gt, K))
_measure("epsilon_hardness", lambda gt: measures.epsilon_hardness(gt, K, 0.1))


@query
def relative_contrast(s, d):
    b, q, gt = _gt(s, d, K + 1)
    return measures.relative_contrast(gt, K, means=knn.mean_distance(b, q)).select("q_id", r6("value", "value"))


@query
def pairwise_distance(s, d):
    b, _, gt = _gt(s, d)
    return measures.pairwise_distance(gt, b, K).select("q_id", r6("value", "value"))


@query
def k_occurrence(s, d):
    b, _, gt = _gt(s, d)
    degrees = stats.in_degree(knn.knn_graph(b, K), b)
    return measures.k_occurrence(gt, degrees, 50).select("q_id", r6("value", "value"))


@query
def mahalanobis(s, d):
    b, q = base_query(s, d)
    mu, cov, _ = stats.covariance(b)
    return stats.mahalanobis(q, "q_id", mu, cov).select("q_id", r6("dist", "dist"))


@query
def mahalanobis_nearest(s, d):
    b, q, gt = _gt(s, d, 1)
    _, cov, _ = stats.covariance(b)
    return stats.mahalanobis_nearest(gt, b, q, cov).select("q_id", r6("dist", "dist"))


# -- reports and workloads --------------------------------------------------------------------------------------------
@query
def hardness_correlation(s, d):
    gt = _gt(s, d, K)[2]
    return stats.correlation(_hard(s, d), measures.lid_stable(gt, K), "me", "lid").select(r6("corr", "corr"))


@query
def effort_correlation(s, d):
    b, q, gt, e = _graph_gt(s, d)
    return stats.correlation(_hard(s, d), search.least_ndc(q, e, b, gt, K), "me", "ndc").select(r6("corr", "corr"))


@query
def hardness_report(s, d):
    return stats.report(_hard(s, d), "me").select(*[r6(c, c) for c in ("lo", "hi", "mean", "p99")])


@query
def hardness_boxes(s, d):
    by = _hard(s, d).withColumn("part", F.col("q_id") % 20)
    return stats.box_summary(by, "me", ["part"]).select("part", *[r6(c, c) for c in ("q1", "median", "q3", "low", "high")], "outliers")


@query
def hardness_grid(s, d):
    return stats.density_grid(_hard(s, d), "delta0", "me", 5).select(F.col("bx").cast("long").alias("bx"), F.col("by").cast("long").alias("by"), "n")


@query
def workload_bins(s, d):
    return workload.with_bins(workload.trimmed(_hard(s, d), "me", 2, 2), "me", 5).select("q_id", "me", F.col("bin").cast("long").alias("bin"))


@query
def workload_sample(s, d):
    return workload.stratified(_hard(s, d), "me", 20, 5, 2, 2).select("q_id", "me", F.col("bin").cast("long").alias("bin"))


@query
def random_subset(s, d):
    return workload.random_subset(embeddings(s, d).select("vec_id"), "vec_id", 100)


@query
def gmm_workload(s, d):
    """Each sampled query with its dimension, its length, and its distance from the nearest base vector."""
    b, _ = base_query(s, d)
    model = workload.fit_mixture(b, 2, rounds=5)
    q = workload.sample_mixture(s, model, 200)
    near = knn.exact_knn(b, q, 1).select("q_id", F.col("dist").alias("nearest"))
    return q.join(near, "q_id").select("q_id", F.size("v").cast("long").alias("dims"), r6(V.norm2(F.col("v")), "norm2"), r6("nearest", "nearest"))
