"""Statistics of graphs, results and measures: degrees, quality, hubs, PageRank, distances, moments, quantiles."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import shared_dir


def in_degree(edges: DataFrame, nodes: DataFrame, skip_self: bool = False) -> DataFrame:
    """(node, degree) for every node, 0 included."""
    e = edges.where("src <> dst") if skip_self else edges
    return nodes.select(F.col("vec_id").alias("node")).join(e.groupBy(F.col("dst").alias("node")).count(), "node", "left").select("node", F.coalesce("count", F.lit(0)).alias("degree"))


def out_degree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("vec_id").alias("node")).join(edges.groupBy(F.col("src").alias("node")).count(), "node", "left").select("node", F.coalesce("count", F.lit(0)).alias("degree"))


def graph_summary(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(edges, nodes, avg_degree, max_degree)."""
    return out_degree(edges, nodes).agg(F.sum("degree").alias("edges"), F.count("*").alias("nodes"), F.avg("degree").alias("avg_degree"), F.max("degree").alias("max_degree"))


def graph_quality(edges: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """(edges, exact_edges, quality): edges that lead to one of the k exact nearest; exact(src, pos, dst)."""
    hit = edges.select("src", "dst").distinct().join(exact.where(F.col("pos") < k).select("src", "dst"), ["src", "dst"], "left_semi")
    return edges.agg(F.count("*").alias("edges")).crossJoin(hit.agg(F.count("*").alias("exact_edges"))).select("edges", "exact_edges", (F.col("exact_edges") / F.col("edges")).alias("quality"))


def node_quality(edges: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """(src, exact_edges) for each node with edges."""
    good = exact.where(F.col("pos") < k).select("src", "dst", F.lit(1).alias("ok"))
    return edges.select("src", "dst").distinct().join(good, ["src", "dst"], "left").groupBy("src").agg(F.count("ok").alias("exact_edges"))


def edge_positions(edges: DataFrame, exact: DataFrame) -> DataFrame:
    """(src, pos, dst, position): where each edge stands in its source's exact neighbour list, from 1."""
    return edges.select("src", "pos", "dst").join(exact.select("src", "dst", (F.col("pos") + 1).alias("position")), ["src", "dst"]).select("src", "pos", "dst", "position")


def hub_density(edges: DataFrame, nodes: DataFrame, share: float) -> DataFrame:
    """(hubs, links, inner_links, density): links of the top share of nodes by in-degree that stay among them.

    Ties at the border go to the lesser id.  The border comes from counts by degree; only the nodes on it are put in
    order, ranges of ids first.
    """
    d = in_degree(edges, nodes)
    n = nodes.count()
    want = max(1, int(n * share))
    counts = d.groupBy("degree").count().withColumn("above", F.coalesce(F.sum("count").over(Window.orderBy(F.desc("degree")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    border = counts.where(F.col("above") < want).orderBy("degree").first()  # one row for each degree
    if border is None:
        hubs = d.select("node").limit(0)
    else:
        tied, left = d.where(F.col("degree") == border["degree"]).select("node"), want - border["above"]
        part = F.floor(F.col("node") / 65_536)
        sizes = tied.groupBy(part.alias("part")).count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        placed = tied.withColumn("part", part).withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy("node"))).join(sizes, "part")
        hubs = d.where(F.col("degree") > border["degree"]).select("node").union(placed.where(F.col("before") + F.col("nth") <= left).select("node"))
    out = edges.join(hubs.withColumnRenamed("node", "src"), "src", "left_semi")
    inner = out.join(hubs.withColumnRenamed("node", "dst"), "dst", "left_semi")
    counts = hubs.agg(F.count("*").alias("hubs")).crossJoin(out.agg(F.count("*").alias("links"))).crossJoin(inner.agg(F.count("*").alias("inner_links")))
    return counts.select("*", (F.col("inner_links") / F.nullif(F.col("links"), F.lit(0))).alias("density"))


def degree_histogram(degrees: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n): bins of equal width over [min, max]; the last includes the largest."""
    lim = degrees.agg(F.min("degree").alias("lo"), F.max("degree").alias("hi"))
    b = F.when(F.col("hi") == F.col("lo"), F.lit(1)).otherwise(F.least(F.floor((F.col("degree") - F.col("lo")) * bins / F.nullif(F.col("hi") - F.col("lo"), F.lit(0))).cast("int") + 1, F.lit(bins)))
    return degrees.crossJoin(F.broadcast(lim)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def skewness(df: DataFrame, col: str) -> DataFrame:
    """Population skewness as moments in two passes."""
    m = df.agg(F.avg(col).alias("mu"))
    x = F.col(col) - F.col("mu")
    return df.crossJoin(F.broadcast(m)).agg((F.avg(x * x * x) / F.pow(F.avg(x * x), F.lit(1.5))).alias("skewness"))


def pagerank(edges: DataFrame, nodes: DataFrame, alpha: float = 0.85, rounds: int = 20, every: int = 5) -> DataFrame:
    """(node, rank) after a fixed number of rounds; lineage is cut by a checkpoint every few rounds."""
    n = nodes.count()
    edges = _cut(edges.select("src", "dst"))
    deg = edges.groupBy("src").agg(F.count("*").alias("deg"))
    links = _cut(edges.select("src", "dst").join(deg, "src"))
    ids = _cut(nodes.select(F.col("vec_id").alias("node")))
    sinks = _cut(ids.join(deg.select(F.col("src").alias("node")), "node", "left_anti"))
    ranks = ids.withColumn("rank", F.lit(1.0 / max(1, n)))
    for step in range(rounds):
        lost = ranks.join(sinks, "node", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        given = links.join(ranks.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("deg")).alias("got"))
        ranks = ids.join(given, "node", "left").crossJoin(F.broadcast(lost)).select("node", ((1 - alpha) / n + alpha * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))
        if (step + 1) % every == 0 or step == rounds - 1:
            ranks = _cut(ranks)
    return ranks


def _cut(df: DataFrame) -> DataFrame:
    """df, computed and stored once in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def bfs_distances(edges: DataFrame, start: int, limit: int | None = None) -> DataFrame:
    """(node, hops) from one node, by frontiers until none is left, or up to a limit; each frontier is checkpointed."""
    spark = edges.sparkSession
    seen = _cut(spark.createDataFrame([(start, 0)], "node long, hops int"))
    front = seen
    for hop in count(1) if limit is None else range(1, limit + 1):
        nxt = edges.join(front.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        front = _cut(nxt.withColumn("hops", F.lit(hop)))
        if not front.limit(1).count():
            break
        seen = seen.union(front)
        if hop % 16 == 0:  # a long path would make a long plan
            seen = _cut(seen.coalesce(spark.sparkContext.defaultParallelism))
    return seen


def result_confusion(result: DataFrame, gt: DataFrame, k: int, values: DataFrame | None = None) -> DataFrame:
    """(q_id, tp, fp, fn) of a result against the first k; with values(id, value) their sums for each class too."""
    true = gt.where(F.col("rank") <= k).select("q_id", "id", F.lit(1).alias("t"))
    both = result.select("q_id", "id", F.lit(1).alias("r")).join(true, ["q_id", "id"], "full_outer")
    kinds = {"tp": F.col("r").isNotNull() & F.col("t").isNotNull(), "fp": F.col("t").isNull(), "fn": F.col("r").isNull()}
    aggs = [F.count_if(c).alias(n) for n, c in kinds.items()]
    if values is not None:
        both = both.join(values.select("id", "value"), "id", "left")
        aggs += [F.coalesce(F.sum(F.when(c, F.col("value"))), F.lit(0)).alias(f"{n}_value") for n, c in kinds.items()]
    return both.groupBy("q_id").agg(*aggs)


def integrity(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(unknown, loops, repeats, unreached): counts of what a sound graph has none of."""
    known = nodes.select(F.col("vec_id").alias("dst"), F.lit(1).alias("ok"))
    bad = edges.join(known, "dst", "left").agg(F.count_if(F.col("ok").isNull()).alias("unknown"), F.count_if(F.col("src") == F.col("dst")).alias("loops"))
    rep = edges.groupBy("src", "dst").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("repeats"))
    return bad.crossJoin(rep).crossJoin(in_degree(edges, nodes).agg(F.count_if(F.col("degree") == 0).alias("unreached")))


def correlation(a: DataFrame, b: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson correlation of two per-query measures."""
    return a.select("q_id", x).join(b.select("q_id", y), "q_id").agg(F.corr(x, y).alias("corr"))


def mean_over_builds(runs: DataFrame, least: bool = False) -> DataFrame:
    """(q_id, effort) over several insertion orders: their mean, or their least."""
    return runs.groupBy("q_id").agg((F.min("ndc") if least else F.avg("ndc")).alias("effort"))


def report(df: DataFrame, col: str) -> DataFrame:
    """(lo, hi, mean, p99); equal values are counted first, so the last step takes as much memory as there are values."""
    x = df.groupBy(F.col(col).cast("double").alias("x")).agg(F.count("*").alias("n")).where("x IS NOT NULL")
    return x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mean"), F.percentile("x", F.lit(0.99), F.col("n")).alias("p99"))


def box_summary(df: DataFrame, col: str, by: list[str] | None = None) -> DataFrame:
    """Quartiles and whiskers, the extreme values within 1.5 times the quartile distance, for each group."""
    by = by or []
    c = F.col(col).cast("double")
    # equal values are counted first, so a group takes as much memory as it has values
    q = df.groupBy(*by, c.alias("x_")).agg(F.count("*").alias("n_")).groupBy(*by).agg(F.percentile("x_", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n_")).alias("q"))
    q = q.select(*by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    joined = df.join(q, by) if by else df.crossJoin(F.broadcast(q))
    gap = 1.5 * (F.col("q3") - F.col("q1"))
    inside = c.between(F.col("q1") - gap, F.col("q3") + gap)
    return joined.groupBy(*by, "q1", "median", "q3").agg(F.min(F.when(inside, c)).alias("low"), F.max(F.when(inside, c)).alias("high"), F.count_if(~inside).alias("outliers"))


def density_grid(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """(bx, by, n): counts on a grid over the range of two columns."""
    lim = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    cell = lambda c, lo, hi: F.coalesce(F.least(F.floor((F.col(c) - F.col(lo)) * bins / F.nullif(F.col(hi) - F.col(lo), F.lit(0))).cast("int"), F.lit(bins - 1)), F.lit(0))
    return df.crossJoin(F.broadcast(lim)).groupBy(cell(x, "x0", "x1").alias("bx"), cell(y, "y0", "y1").alias("by")).agg(F.count("*").alias("n"))


def covariance(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, sample covariance and count, from one d x d sum for each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .knn import _vectors

        n, s, ss = 0, None, None
        for b in batches:
            if b.num_rows:
                x = _vectors(b.column(0))
                n += len(x)
                s = x.sum(axis=0) if s is None else s + x.sum(axis=0)
                ss = x.T @ x if ss is None else ss + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([s.tolist()]), pa.array([ss.ravel().tolist()])], ["n", "s", "ss"])

    sums = vectors.select(F.col("v").cast("array<double>")).mapInArrow(run, "n long, s array<double>, ss array<double>")
    rows = sums.toLocalIterator()
    n, s, ss = 0, 0.0, 0.0
    for r in rows:  # one small row for each partition, one at a time
        n, s, ss = n + r["n"], s + np.array(r["s"]), ss + np.array(r["ss"])
    mu = s / n
    return mu, (ss.reshape(len(mu), -1) - n * np.outer(mu, mu)) / (n - 1), n


def mahalanobis(vectors: DataFrame, key: str, mu: np.ndarray, cov: np.ndarray) -> DataFrame:
    """(key, dist): squared Mahalanobis distance to a mean."""
    inv = np.linalg.pinv(cov)
    sent = vectors.sparkSession.sparkContext.broadcast((mu, inv))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .knn import _vectors

        mu, inv = sent.value
        for b in batches:
            x = _vectors(b.column(1)) - mu if b.num_rows else np.zeros((0, len(mu)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.einsum("ij,jk,ik->i", x, inv, x))], [key, "dist"])

    return vectors.select(F.col(key).cast("long"), F.col("v").cast("array<double>")).mapInArrow(run, f"{key} long, dist double")


def mahalanobis_nearest(gt: DataFrame, base: DataFrame, query: DataFrame, cov: np.ndarray) -> DataFrame:
    """(q_id, dist): squared Mahalanobis distance of each query to its nearest neighbour."""
    near = gt.where("rank = 1").join(base.select(F.col("vec_id").alias("id"), F.col("v").alias("xv")), "id").join(query, "q_id")
    gap = F.zip_with(F.col("v").cast("array<double>"), F.col("xv").cast("array<double>"), lambda a, b: a - b)
    return mahalanobis(near.select("q_id", gap.alias("v")), "q_id", np.zeros(len(cov)), cov)
