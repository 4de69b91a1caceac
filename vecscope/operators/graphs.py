"""Proximity graphs as edge tables: pruning folds, reversal, relabelling, and sequential builders.

A pruning fold walks a node's candidates in order of distance and keeps one unless a kept one occludes it.  Each node
is folded on its own, inside Arrow batches, so a graph is built in one pass over (node, candidate list) rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import spread
from . import knn

METHODS = ("mrng", "ssg", "taumg")


def occluded(method: str, alpha: float = 60.0, tau: float = 0.01) -> Callable[[float, np.ndarray, np.ndarray], bool]:
    """The test of a candidate at distance d_v against kept ones at d_u, whose distances to it are d_uv (all squared).

    mrng: some kept one is nearer to it than the node is; ssg: the angle at the node is under alpha degrees;
    taumg: nearer by more than 3 tau.
    """
    cos = math.cos(math.radians(alpha))
    if method == "mrng":
        return lambda d_v, d_u, d_uv: bool((d_uv < d_v).any())
    if method == "ssg":
        return lambda d_v, d_u, d_uv: bool((d_uv < d_v + d_u - 2.0 * np.sqrt(d_v) * np.sqrt(d_u) * cos).any())
    if method == "taumg":
        return lambda d_v, d_u, d_uv: bool((d_uv < d_v - 3.0 * tau).any())
    raise ValueError(f"method is one of {METHODS}")


def fold(dist: np.ndarray, vectors: np.ndarray, test: Callable, cap: int | None = None) -> list[int]:
    """Indices of the kept candidates; the input is in order of distance."""
    kept: list[int] = []
    for i in range(len(dist)):
        if cap is not None and len(kept) >= cap:
            break
        if kept:
            d = vectors[kept] - vectors[i]
            if test(dist[i], dist[kept], (d * d).sum(axis=1)):
                continue
        kept.append(i)
    return kept


def prune(candidates: DataFrame, base: DataFrame, method: str = "mrng", alpha: float = 60.0, tau: float = 0.01, cap: int | None = None) -> DataFrame:
    """edges(src, pos, dst) from candidate edges (src, pos, dst, dist).

    Below the bound of a broadcast, which is measured, vectors are sent once and candidates travel as ids; beyond it
    each candidate brings its vector.
    """
    c = candidates.where("src <> dst")
    size = base.agg(F.sum(F.size("v"))).first()[0] or 0
    sent = None
    if size * 8 <= knn.BROADCAST_BYTES:
        rows = base.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL").toArrow().sort_by("vec_id")
        sent = base.sparkSession.sparkContext.broadcast((rows["vec_id"].to_numpy(), knn._vectors(rows["v"].combine_chunks()) if rows.num_rows else np.zeros((0, 0))))
        near = F.struct(F.col("dist"), F.col("dst"))
    else:
        c = c.join(base.select(F.col("vec_id").alias("dst"), F.col("v").cast("array<double>").alias("v")), "dst")
        near = F.struct("dist", "dst", "v")
    lists = spread(c, "src").groupBy("src").agg(F.sort_array(F.collect_list(near)).alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = occluded(method, alpha, tau)
        known, x = sent.value if sent else (None, None)
        for batch in batches:
            src, pos, dst = [], [], []
            for s, c in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                c = c.values
                ids, dist = c.field("dst").to_numpy(), c.field("dist").to_numpy()
                if sent:
                    at = np.searchsorted(known, ids)
                    there = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == ids) if len(known) else np.zeros(len(ids), bool)
                    ids, dist, v = ids[there], dist[there], x[at[there]] if len(known) else x
                else:
                    v = knn._vectors(c.field("v"))
                kept = ids[fold(dist, v, test, cap)]
                src.append(np.full(len(kept), s))
                pos.append(np.arange(len(kept)))
                dst.append(kept)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(y) if y else np.zeros(0), t) for y, t in ((src, pa.int64()), (pos, pa.int32()), (dst, pa.int64()))], ["src", "pos", "dst"])

    return lists.mapInArrow(run, "src long, pos int, dst long")


def build_graph(base: DataFrame, method: str = "mrng", k_cand: int = 32, alpha: float = 60.0, tau: float = 0.01) -> DataFrame:
    """edges(src, pos, dst) pruned from the k_cand nearest others of every vector."""
    return prune(knn.knn_graph(base, k_cand), base, method, alpha, tau)


# -- edge tables ----------------------------------------------------------------------------------------------------
def adjacency(edges: DataFrame) -> DataFrame:
    """(src, dsts) with the neighbours in list order."""
    return edges.groupBy("src").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "dst"))), lambda x: x["dst"]).alias("dsts"))


def from_padded(rows: DataFrame) -> DataFrame:
    """edges from (src, ids) rows padded with -1."""
    return rows.select("src", F.posexplode("ids").alias("pos", "dst")).where("dst >= 0")


def reverse(edges: DataFrame, drop_loops: bool = False) -> DataFrame:
    """edges of the reversed graph; in-lists in order of the source."""
    e = edges.where("src <> dst") if drop_loops else edges
    w = Window.partitionBy("dst").orderBy("src")
    return e.select(F.col("dst").alias("src"), (F.row_number().over(w) - 1).alias("pos"), F.col("src").alias("dst"))


def reverse_attribute(edges: DataFrame, attribute: str) -> DataFrame:
    """A per-edge attribute along the reversed edges."""
    w = Window.partitionBy("dst").orderBy("src")
    return edges.select(F.col("dst").alias("src"), (F.row_number().over(w) - 1).alias("pos"), F.col("src").alias("dst"), attribute)


def relabel(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """edges with both ends renamed by mapping(old, new)."""
    a = mapping.select(F.col("old").alias("src"), F.col("new").alias("new_src"))
    b = mapping.select(F.col("old").alias("dst"), F.col("new").alias("new_dst"))
    return edges.join(a, "src").join(b, "dst").select(F.col("new_src").alias("src"), "pos", F.col("new_dst").alias("dst"))


def padded(edges: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(src, ids): every node's neighbours, filled up with -1."""
    fill = F.array_repeat(F.lit(-1).cast("long"), width)
    rows = nodes.select(F.col("vec_id").alias("src")).join(adjacency(edges), "src", "left")
    return rows.select("src", F.slice(F.concat(F.coalesce("dsts", F.array().cast("array<bigint>")), fill), 1, width).alias("ids"))


def mixed(key: str, seed: int):
    """A pseudo-random order of integers, the same in every engine: two rounds of multiplication modulo a prime."""
    p = 2147483647
    x = ((F.pmod(F.col(key), F.lit(p)) * 48271) % p + seed * 69621 + 11) % p
    return (((x * 16807) % p) * 39373 + seed) % p


def shuffle_ids(base: DataFrame, seed: int = 3) -> DataFrame:
    """mapping(old, new): a permutation of row numbers.

    New ids are dealt by ranges of the mixed key: rows of one range are numbered together and ranges are offset by the
    counts below them, so no task sees all rows.
    """
    ranges = 256
    p = 2147483647
    keyed = base.select(F.col("vec_id").alias("old"), mixed("vec_id", seed).alias("h")).withColumn("r", F.floor(F.col("h") * ranges / p).cast("int"))
    below = keyed.groupBy("r").count().withColumn("first", F.sum("count").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count"))
    inside = keyed.withColumn("nth", F.row_number().over(Window.partitionBy("r").orderBy("h", "old")))
    return inside.join(F.broadcast(below.select("r", "first")), "r").select("old", (F.col("first") + F.col("nth") - 1).cast("long").alias("new"))


def shuffle_gt(gt: DataFrame, mapping: DataFrame) -> DataFrame:
    return gt.join(mapping.select(F.col("old").alias("id"), "new"), "id").select("q_id", "rank", F.col("new").alias("id"))


def csr(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, first, degree): row pointers over nodes in id order, with the edge table as column indices."""
    d = nodes.select(F.col("vec_id").alias("src")).join(edges.groupBy("src").count(), "src", "left").select("src", F.coalesce("count", F.lit(0)).alias("degree"))
    ranges = d.withColumn("r", F.floor(F.col("src") / 65536))
    below = ranges.groupBy("r").agg(F.sum("degree").alias("n")).withColumn("start", F.sum("n").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    w = Window.partitionBy("r").orderBy("src").rowsBetween(Window.unboundedPreceding, 0)
    return ranges.join(F.broadcast(below.select("r", "start")), "r").select("src", (F.col("start") + F.sum("degree").over(w) - F.col("degree")).alias("first"), "degree")


# -- sequential builders --------------------------------------------------------------------------------------------
def _sequential(base: DataFrame, build: Callable[[np.ndarray, np.ndarray], list[tuple[int, int, int, int]]], shards: int) -> DataFrame:
    """Insertion order decides these graphs, so each shard is one group; shards are independent graphs."""
    keyed = base.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard") if shards > 1 else F.lit(0).alias("shard"), "vec_id", F.col("v").cast("array<double>").alias("v"))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("vec_id").combine_chunks()
        ids = group["vec_id"].to_numpy()
        vectors = knn._vectors(group["v"].combine_chunks())
        cols = list(zip(*build(ids, vectors), strict=True)) or [()] * 4
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("level", "src", "pos", "dst"), cols, (pa.int32(), pa.int64(), pa.int32(), pa.int64()), strict=True)})

    return keyed.groupBy("shard").applyInArrow(run, "level int, src long, pos int, dst long")


def nsw_graph(base: DataFrame, k: int = 16, ef: int = 64, shards: int = 1) -> DataFrame:
    """edges of a navigable small world: each vector is joined both ways with the k nearest that a beam search finds."""
    from .search import Graph, beam

    def build(ids: np.ndarray, x: np.ndarray) -> list[tuple[int, int, int, int]]:
        nbrs: list[list[int]] = [[] for _ in ids]
        g = Graph(x, nbrs)
        for i in range(1, len(ids)):
            g.size = i
            near = beam(g, x[i], 0, min(ef, i)).found[:k]
            for _, j in near:
                nbrs[i].append(j)
                nbrs[j].append(i)
        return [(0, int(ids[i]), p, int(ids[j])) for i, ns in enumerate(nbrs) for p, j in enumerate(ns)]

    return _sequential(base, build, shards)


def layered_graph(base: DataFrame, m: int = 8, ef: int = 64, seed: int = 3, plain: bool = False, shards: int = 1) -> DataFrame:
    """(level, src, pos, dst) of a hierarchical graph; a row of pos -1 on the highest level names the entry."""
    from .search import Hierarchy

    def build(ids: np.ndarray, x: np.ndarray) -> list[tuple[int, int, int, int]]:
        h = Hierarchy(x, m, ef, seed, plain)
        for i in range(len(ids)):
            h.insert(i)
        entry = [(len(h.layers) - 1, int(ids[h.entry]), -1, int(ids[h.entry]))] if len(ids) else []
        return entry + [(lv, int(ids[i]), p, int(ids[j])) for lv, nbrs in enumerate(h.layers) for i, ns in sorted(nbrs.items()) for p, j in enumerate(ns)]

    return _sequential(base, build, shards)


def hnsw_graph(base: DataFrame, m: int = 8, ef: int = 64, seed: int = 3, plain: bool = False, shards: int = 1) -> DataFrame:
    """edges (level, src, pos, dst) of a hierarchical graph; `plain` puts every vector on level 0 only.

    A shard is one task: with one shard, the whole base is inserted by one.
    """
    return layered_graph(base, m, ef, seed, plain, shards).where("pos >= 0")
