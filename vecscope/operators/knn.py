"""Exact nearest neighbours: blocks of vectors against blocks of vectors, partial top-k, then the final top-k.

A block is one row with the ids and the matrix of up to BLOCK vectors.  The smaller side is broadcast if its measured
size allows; otherwise blocks meet by a product of the two block tables, and no vector table is ever collected.  Each
pair of blocks is one matrix product whose shortlist is measured again by direct differences, so rounding in the
product cannot reorder near ties.  Ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..plans.tables import spread

BLOCK = 4096
BROADCAST_BYTES = 128 << 20
EXPRESSION_PAIRS = 50_000_000
#: Dimensions up to which a distance is written out as one sum.
UNROLLED = 128


def _vectors(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1)


def blocks(vectors: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """(ids, data): the vectors of each partition packed into matrices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            ids, m = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            return pa.RecordBatch.from_arrays([pa.array([ids.tolist()], pa.list_(pa.int64())), pa.array([m.tobytes()], pa.binary())], ["ids", "data"])

        for batch in batches:
            for start in range(0, batch.num_rows, block):
                part = batch.slice(start, block)
                if size and size + part.num_rows > block:
                    yield out()
                    held, size = [], 0
                held.append((part.column(0).to_numpy(), _vectors(part.column(1))))
                size += part.num_rows
        if size:
            yield out()

    return vectors.where(F.col(key).isNotNull() & F.col("v").isNotNull()).select(F.col(key).cast("long"), F.col("v").cast("array<double>")).mapInArrow(run, "ids array<long>, data binary")


def _distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "ip":
        return 1.0 - q @ x.T
    if metric == "cosine":
        return 1.0 - (q @ x.T) / np.maximum(np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :], 1e-300)
    return (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2.0 * (q @ x.T)


def _direct(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "ip":
        return 1.0 - x @ q
    if metric == "cosine":
        return 1.0 - (x @ q) / np.maximum(np.linalg.norm(q) * np.linalg.norm(x, axis=1), 1e-300)
    d = x - q
    return (d * d).sum(axis=1)


def _pairs(base: DataFrame, query: DataFrame) -> DataFrame:
    """(ids, data, q_ids, q_data): every block of the base beside every block of queries."""
    qb, xb = blocks(query, "q_id").select(F.col("ids").alias("q_ids"), F.col("data").alias("q_data")), blocks(base, "vec_id")
    small = query.agg(F.sum(F.size("v")).alias("n")).first()["n"] or 0
    pairs = xb.crossJoin(F.broadcast(qb)) if small * 8 <= BROADCAST_BYTES else xb.crossJoin(qb)
    return pairs.select("ids", "data", "q_ids", "q_data")


def exact_knn(base: DataFrame, query: DataFrame, k: int, metric: str = "l2", exclude_self: bool = False, engine: str = "arrow") -> DataFrame:
    """gt(q_id, rank, id, dist): the k nearest base vectors of each query, rank from 1, by distance and then id."""
    # every query meets every base vector: the work is their product at any size; graph searches measure far fewer
    if engine == "sql":
        return _knn_sql(base, query, k, metric, exclude_self)
    if engine == "sql_bounded":
        return _knn_sql_bounded(base, query, k, metric, exclude_self)
    pairs = _pairs(base, query)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data, q_ids, q_data in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                ids, q_ids = np.array(ids), np.array(q_ids)
                x, q = np.frombuffer(data).reshape(len(ids), -1), np.frombuffer(q_data).reshape(len(q_ids), -1)
                for start in range(0, len(q), 256):
                    part = q[start : start + 256]
                    d = _distances(part, x, metric)
                    slack = 1e-9 * (1.0 + np.abs(d).max())
                    out_q, out_id, out_d = [], [], []
                    for r in range(len(part)):
                        row = d[r]
                        if exclude_self:
                            row = np.where(ids == q_ids[start + r], np.inf, row)
                        kth = np.partition(row, k - 1)[k - 1] if k < len(row) else np.inf
                        near = np.nonzero((row <= kth + slack) & np.isfinite(row))[0]
                        exact = _direct(part[r], x[near], metric)
                        best = np.lexsort((ids[near], exact))[:k]
                        out_id.append(ids[near[best]])
                        out_d.append(exact[best])
                        out_q.append(np.full(len(best), q_ids[start + r]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (out_q, out_id, out_d)], ["q_id", "id", "dist"])

    partial = pairs.mapInArrow(run, "q_id long, id long, dist double")
    return top_k(partial, k)


def mean_distance(base: DataFrame, query: DataFrame, rooted: bool = False) -> DataFrame:
    """(q_id, mean): mean distance to the whole base, squared unless rooted; blocks give sums, no pair leaves a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data, q_ids, q_data in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                x, q = np.frombuffer(data).reshape(len(ids), -1), np.frombuffer(q_data).reshape(len(q_ids), -1)
                for start in range(0, len(q), 256):
                    d = np.maximum(_distances(q[start : start + 256], x, "l2"), 0.0)
                    total = (np.sqrt(d) if rooted else d).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[start : start + 256], pa.int64()), pa.array(total), pa.array(np.full(len(total), len(ids)))], ["q_id", "total", "n"])

    sums = _pairs(base, query).mapInArrow(run, "q_id long, total double, n long")
    return sums.groupBy("q_id").agg((F.sum("total") / F.sum("n")).alias("mean"))


def top_k(near: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query; Spark limits every partition before the shuffle."""
    w = Window.partitionBy("q_id").orderBy("dist", "id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("q_id", "rank", "id", "dist")


def _knn_sql(base: DataFrame, query: DataFrame, k: int, metric: str, exclude_self: bool) -> DataFrame:
    """The same by expressions only, for queries of up to EXPRESSION_PAIRS pairs, which are counted."""
    if base.count() * query.count() > EXPRESSION_PAIRS:
        raise ValueError("too many pairs for expressions: use the arrow engine")
    q = query.select("q_id", F.col("v").alias("qv"))
    pairs = base.select(F.col("vec_id").alias("id"), F.col("v").alias("xv")).crossJoin(q)
    if exclude_self:
        pairs = pairs.where("id <> q_id")
    return top_k(pairs.select("q_id", "id", V.METRICS[metric](F.col("qv"), F.col("xv")).alias("dist")), k)


def _knn_sql_bounded(base: DataFrame, query: DataFrame, k: int, metric: str, exclude_self: bool) -> DataFrame:
    """The same by expressions only, for any number of pairs: all are measured, few are sorted.

    The k-th distance within some of the base is no less than that within all of it, so no pair beyond it counts.
    With about sqrt(k n) of n vectors for the bound, about as many pairs of each query are left to sort.
    """
    x = base.where("vec_id IS NOT NULL AND v IS NOT NULL").select(F.col("vec_id").alias("id"), V.as_double(F.col("v")).alias("xv"))
    q = query.where("q_id IS NOT NULL AND v IS NOT NULL").select("q_id", V.as_double(F.col("v")).alias("qv"))
    sizes = lambda c: (F.min(F.size(c)).alias("low"), F.max(F.size(c)).alias("high"), F.count("*").alias("n"), F.sum(F.size(c)).alias("numbers"), F.bool_or(F.exists(c, F.isnull)).alias("holes"))
    a, b = x.agg(*sizes("xv")).first(), q.agg(*sizes("qv")).first()
    dims = a["low"] if a["n"] and b["n"] and a["low"] == a["high"] == b["low"] == b["high"] and not a["holes"] and not b["holes"] else 0
    if metric == "l2" and 0 < dims <= UNROLLED:
        # a column for each dimension and one written-out sum, in the order of l2sq: many times faster than a fold of arrays
        apart = lambda c, name: [F.coalesce(F.get(c, F.lit(i)), F.lit(math.nan)).alias(f"{name}{i}") for i in range(dims)]
        x, q, dist = x.select("id", *apart("xv", "x")), q.select("q_id", *apart("qv", "y")), F.lit(0.0)
        for i in range(dims):
            gap = F.col(f"y{i}") - F.col(f"x{i}")
            dist = dist + gap * gap
    else:
        dist = V.METRICS[metric](F.col("qv"), F.col("xv"))
    dealt = spread(x, "id")

    def met(some: DataFrame, queries: DataFrame) -> DataFrame:
        side = F.broadcast(queries) if (b["numbers"] or 0) * 8 <= BROADCAST_BYTES else queries
        return some.crossJoin(side).where(F.col("id") != F.col("q_id")) if exclude_self else some.crossJoin(side)

    part = max(1, math.isqrt(a["n"] // k))
    some = met(dealt.where(F.pmod(F.xxhash64("id"), F.lit(part)) == 0), q).select("q_id", "id", dist.alias("dist")).where("dist IS NOT NULL")
    far = top_k(some, k).where(F.col("rank") == k).select("q_id", F.col("dist").alias("far"))
    pairs = met(dealt, q.join(far, "q_id", "left")).where(dist.isNotNull() & (F.col("far").isNull() | (dist <= F.col("far"))))
    return top_k(pairs.select("q_id", "id", dist.alias("dist")), k)


def knn_graph(base: DataFrame, k: int, metric: str = "l2", include_self: bool = False) -> DataFrame:
    """edges(src, pos, dst, dist): each vector's k nearest others, pos from 0."""
    gt = exact_knn(base, base.select(F.col("vec_id").alias("q_id"), "v"), k, metric, exclude_self=not include_self)
    return gt.select(F.col("q_id").alias("src"), (F.col("rank") - 1).alias("pos"), F.col("id").alias("dst"), "dist")


def mips_knn(base: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """gt by largest inner product, through squared distance after one dimension is appended to both sides."""
    phi = base.agg(F.max(V.norm2(F.col("v")))).first()[0] or 0.0
    longer = base.select("vec_id", F.concat(V.as_double(F.col("v")), F.array(F.sqrt(F.greatest(F.lit(phi) - V.norm2(F.col("v")), F.lit(0.0))))).alias("v"))
    return exact_knn(longer, query.select("q_id", F.concat(V.as_double(F.col("v")), F.array(F.lit(0.0))).alias("v")), k)


def upsert(base: DataFrame, changes: DataFrame) -> DataFrame:
    """base with rows of `changes` added, those with a known id overwritten."""
    return base.join(changes.select("vec_id"), "vec_id", "left_anti").unionByName(changes.select(*base.columns))


def remove(base: DataFrame, ids: DataFrame) -> DataFrame:
    return base.join(ids.select("vec_id"), "vec_id", "left_anti")


def drop_self(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def gather(gt: DataFrame, base: DataFrame) -> DataFrame:
    """gt with the vector of each neighbour."""
    return gt.join(base.select(F.col("vec_id").alias("id"), "v"), "id").select("q_id", "rank", "id", "v")


def rescore(gt: DataFrame, base: DataFrame, query: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """The first k of given neighbour ids with their distances, closest first."""
    d = gather(gt.where(F.col("rank") <= k), base).join(query.select("q_id", F.col("v").alias("qv")), "q_id")
    return top_k(d.select("q_id", "id", V.METRICS[metric](F.col("qv"), F.col("v")).alias("dist")), k)


def neighbour_products(gt: DataFrame, base: DataFrame, query: DataFrame) -> DataFrame:
    """(q_id, rank, id, ip): inner product of each query with each of its neighbours."""
    d = gather(gt, base).join(query.select("q_id", F.col("v").alias("qv")), "q_id")
    return d.select("q_id", "rank", "id", V.inner(F.col("qv"), F.col("v")).alias("ip"))


def edge_distances(edges: DataFrame, base: DataFrame) -> DataFrame:
    """(src, pos, dst, dist) for each edge."""
    side = lambda c, v: base.select(F.col("vec_id").alias(c), F.col("v").alias(v))
    return edges.select("src", "pos", "dst").join(side("src", "sv"), "src").join(side("dst", "dv"), "dst").select("src", "pos", "dst", V.l2sq(F.col("sv"), F.col("dv")).alias("dist"))


def centred_length(base: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """(key, length): distance from the base mean over the largest such distance in the base."""
    mean = base.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mu = mean.agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("s")).select(F.transform("s", lambda x: x["m"]).alias("mu"))
    far = base.crossJoin(F.broadcast(mu)).agg(F.max(F.sqrt(V.l2sq(F.col("v"), F.col("mu")))).alias("far"))
    return vectors.crossJoin(F.broadcast(mu)).crossJoin(F.broadcast(far)).select(key, (F.sqrt(V.l2sq(F.col("v"), F.col("mu"))) / F.col("far")).alias("length"))
