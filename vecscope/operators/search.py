"""Graph search with effort accounting: beam search, budgets, sweeps, and the least effort for a recall target.

Search is sequential for a query and independent between queries: queries are partitioned, the graph and its vectors
are sent to the executors as arrays below BROADCAST_BYTES, measured first.  A larger graph stays a table: each query
searches the nodes it was given so far, asks for the ones it lacks, gets them by a join, and searches again.  That is
the same search of the same whole graph, so results and effort do not depend on its size.

One distance computation (NDC) is counted for each vector that is measured, the entry included.  The entry follows
from the query's id and a seed unless it is given, so results are the same in every run.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import spread
from .knn import _vectors
from .stats import _cut

BROADCAST_BYTES = 1 << 28
AHEAD = 32


@dataclass
class Graph:
    """Vectors with neighbour lists; ids are positions.  Deleted ones are passed through but not returned."""

    x: np.ndarray
    nbrs: list[list[int]] | Rows
    deleted: set[int] = field(default_factory=set)
    size: int = 0

    def __post_init__(self) -> None:
        self.size = self.size or len(self.x)

    def dist(self, q: np.ndarray, ids: Sequence[int]) -> np.ndarray:
        d = self.x[ids] - q
        return (d * d).sum(axis=1)


class Rows:
    """Neighbour lists as two arrays: where each begins, and all their entries."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray):
        """src is sorted; the entries of a list are in order."""
        self.first, self.dst = np.searchsorted(src, np.arange(n + 1)), dst.astype(np.int64)

    def __getitem__(self, u: int) -> list[int]:
        return self.dst[self.first[u] : self.first[u + 1]].tolist()

    def get(self, u: int, default: list[int]) -> list[int]:
        return self[u]


@dataclass
class Found:
    """(distance, id) nearest first, distances measured, and expanded nodes."""

    found: list[tuple[float, int]]
    ndc: int
    hops: int
    trace: list[tuple[int, float]] = field(default_factory=list)


def beam(g: Graph, q: np.ndarray, entry: int, ef: int, budget: int | None = None, expansions: int | None = None, trace: bool = False) -> Found:
    """Best-first search: expand the nearest candidate until it is farther than the worst of the ef results.

    budget: stop once more than so many distances were measured.  expansions: stop after so many expanded nodes.
    """
    d = float(g.dist(q, [entry])[0])
    seen, cands = {entry}, [(d, entry)]
    best = [] if entry in g.deleted else [(-d, -entry)]
    ndc, hops, steps = 1, 0, []
    while cands:
        d, u = heapq.heappop(cands)
        if len(best) >= ef and d > -best[0][0]:
            break
        if expansions is not None and hops >= expansions:
            break
        hops += 1
        if trace:
            steps.append((u, -best[0][0] if best else math.inf))
        fresh = [v for v in dict.fromkeys(g.nbrs[u]) if v not in seen and v < g.size]
        seen.update(fresh)
        over = False
        if fresh:
            if budget is not None and ndc + len(fresh) > budget:
                fresh, over = fresh[: max(0, budget + 1 - ndc)], True
            for v, dv in zip(fresh, g.dist(q, fresh).tolist(), strict=True) if fresh else ():
                ndc += 1
                if len(best) < ef or dv < -best[0][0]:
                    heapq.heappush(cands, (dv, v))
                    if v not in g.deleted:
                        heapq.heappush(best, (-dv, -v))
                        if len(best) > ef:
                            heapq.heappop(best)
        if over:
            break
    return Found(sorted((-d, -i) for d, i in best), ndc, hops, steps)


class Hierarchy:
    """Layers of neighbour lists, built by insertion: greedy descent, a beam, heuristic choice, mutual links."""

    def __init__(self, x: np.ndarray, m: int, ef: int, seed: int = 3, plain: bool = False):
        self.x, self.m, self.ef, self.plain = x, m, ef, plain
        self.rng = np.random.default_rng(seed)
        self.layers: list[dict[int, list[int]]] = [{}]
        self.entry = -1

    def _graph(self, level: int) -> Graph:
        lists = self.layers[level]
        return Graph(self.x, _Lists(lists) if isinstance(lists, dict) else lists)  # type: ignore[arg-type]

    def choose(self, near: list[tuple[float, int]], cap: int) -> list[int]:
        """All if fewer than the cap; else those that no chosen one occludes, up to the cap."""
        if len(near) < cap:
            return [i for _, i in near]
        kept: list[int] = []
        for d, i in near:
            if len(kept) >= cap:
                break
            if kept:
                gap = self.x[kept] - self.x[i]
                if ((gap * gap).sum(axis=1) < d).any():
                    continue
            kept.append(i)
        return kept

    def descend(self, q: np.ndarray, start: int, top: int, bottom: int) -> tuple[int, int, int]:
        """Greedy steps from layer `top` down to above `bottom`: (node, distances measured, hops)."""
        now, ndc, hops = start, 1, 0
        d = float(((self.x[now] - q) ** 2).sum())
        for level in range(top, bottom, -1):
            moved = True
            while moved:
                moved = False
                hops += 1
                for v in self.layers[level].get(now, []):
                    dv = float(((self.x[v] - q) ** 2).sum())
                    ndc += 1
                    if dv < d:
                        d, now, moved = dv, v, True
        return now, ndc, hops

    def insert(self, i: int) -> None:
        level = 0 if self.plain else int(-math.log(max(self.rng.random(), 1e-300)) / math.log(self.m))
        top = len(self.layers) - 1
        for lv in range(level + 1):
            if lv == len(self.layers):
                self.layers.append({})
            self.layers[lv][i] = []
        if self.entry < 0:
            self.entry = i
            return
        at, _, _ = self.descend(self.x[i], self.entry, top, level)
        for lv in range(min(level, top), -1, -1):
            near = [n for n in beam(self._graph(lv), self.x[i], at, self.ef).found if n[1] != i]
            chosen = self.choose(near, self.m)
            self.layers[lv][i] = list(chosen)
            cap = 2 * self.m if lv == 0 else self.m
            for j in chosen:
                back = self.layers[lv][j]
                back.append(i)
                if len(back) > cap:
                    d = ((self.x[back] - self.x[j]) ** 2).sum(axis=1).tolist()
                    self.layers[lv][j] = self.choose(sorted(zip(d, back, strict=True)), cap)
            if near:
                at = near[0][1]
        if level > top:
            self.entry = i

    def update(self, i: int, vector: np.ndarray) -> None:
        """Move vector i: its neighbours choose anew among the two-hop surroundings, and i is linked where it now lies."""
        self.x[i] = vector
        for lv, nbrs in enumerate(self.layers):
            if i not in nbrs or len(nbrs) == 1:
                continue
            cap = 2 * self.m if lv == 0 else self.m
            near = set(nbrs[i])
            pool = near.union({i}, *[nbrs[j] for j in near])
            for j in sorted(near):
                others = sorted(pool - {j})
                d = ((self.x[others] - self.x[j]) ** 2).sum(axis=1).tolist()
                nbrs[j] = self.choose(sorted(zip(d, others, strict=True))[: self.ef], cap)
        top = len(self.layers) - 1
        level = max(lv for lv, nbrs in enumerate(self.layers) if i in nbrs)
        at, _, _ = self.descend(vector, self.entry, top, level)
        for lv in range(level, -1, -1):
            found = [n for n in beam(self._graph(lv), vector, at, self.ef).found if n[1] != i]
            if not found:
                continue
            cap = 2 * self.m if lv == 0 else self.m
            self.layers[lv][i] = self.choose(found, cap)
            for j in self.layers[lv][i]:
                back = self.layers[lv][j]
                if i not in back:
                    back.append(i)
                    if len(back) > cap:
                        d = ((self.x[back] - self.x[j]) ** 2).sum(axis=1).tolist()
                        self.layers[lv][j] = self.choose(sorted(zip(d, back, strict=True)), cap)
            at = found[0][1]

    def search(self, q: np.ndarray, k: int, ef: int) -> Found:
        at, ndc, hops = self.descend(q, self.entry, len(self.layers) - 1, 0)
        f = beam(self._graph(0), q, at, max(ef, k))
        return Found(f.found[:k], f.ndc + ndc - 1, f.hops + hops, f.trace)


class _Lists(dict):
    def __init__(self, lists: dict[int, list[int]]):
        super().__init__()
        self.lists = lists

    def __getitem__(self, i: int) -> list[int]:
        return self.lists.get(i, [])


# -- over tables ----------------------------------------------------------------------------------------------------
def _load(edges: DataFrame, base: DataFrame, deleted: DataFrame | None) -> tuple[np.ndarray, Graph]:
    rows = base.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v")).toArrow().sort_by("vec_id")
    ids = rows["vec_id"].to_numpy()
    x = _vectors(rows["v"].combine_chunks())
    e = edges.select(F.col("src").cast("long"), F.col("pos").cast("long"), F.col("dst").cast("long")).toArrow().sort_by([("src", "ascending"), ("pos", "ascending")])
    known = np.isin(e["src"].to_numpy(), ids) & np.isin(e["dst"].to_numpy(), ids)
    src, dst = np.searchsorted(ids, e["src"].to_numpy()[known]), np.searchsorted(ids, e["dst"].to_numpy()[known])
    gone = set() if deleted is None else set(np.searchsorted(ids, [r[0] for r in deleted.select("vec_id").collect()]).tolist())
    return ids, Graph(x, Rows(len(ids), src, dst), gone)


def shards_needed(edges: DataFrame, base: DataFrame) -> int:
    """How many times the broadcast bound the graph and the vectors take; beyond once they stay tables."""
    size = (base.agg(F.sum(F.size("v"))).first()[0] or 0) * 8 + edges.count() * 16
    return max(1, -(-size // BROADCAST_BYTES))


def _over_queries(query: DataFrame, ids: np.ndarray, graph: Graph, seed: int, entry: int | None, schema: str, judge) -> DataFrame:
    """One call of judge(q_id, vector, entry, extra columns) for each query; it yields rows."""
    sent = query.sparkSession.sparkContext.broadcast((ids, graph))
    names = [c.split(" ")[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    types = [kinds[c.split(" ")[1]] for c in schema.split(", ")]
    start = F.lit(entry).cast("long") if entry is not None else F.pmod(F.xxhash64(F.lit(seed), "q_id"), F.lit(len(ids)))
    extra = [c for c in query.columns if c not in ("q_id", "v")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, graph = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            vs, rows = _vectors(batch.column(1)), []
            more = [batch.column(3 + c).to_pylist() for c in range(len(extra))]
            for i, (q, at) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                at = int(np.searchsorted(ids, at)) if entry is not None else at
                rows += judge(ids, graph, q, vs[i], at, *[m[i] for m in more])
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return spread(query.select("q_id", F.col("v").cast("array<double>"), start, *extra), "q_id").mapInArrow(run, schema)


class _Missing(Exception):
    """Nodes that a search needs and was not given."""


class _Part:
    """The nodes that one query was given, by id; what it lacks is raised, with the surroundings of the nearest ones."""

    size = 1 << 63

    def __init__(self, known: pa.Table, ahead: int):
        ids = known["node"].to_pylist()
        self.x = dict(zip(ids, map(np.array, known["v"].to_pylist()), strict=True))
        self.nbrs = dict(zip(ids, known["nbrs"].to_pylist(), strict=True))
        self.deleted = {i for i, gone in zip(ids, known["gone"].to_pylist(), strict=True) if gone}
        self.ahead, self.measured = ahead, {}

    def dist(self, q: np.ndarray, ids: Sequence[int]) -> np.ndarray:
        lack = {i for i in ids if i not in self.x}
        if lack:
            near = heapq.nsmallest(self.ahead, self.measured, key=self.measured.get)
            raise _Missing(lack.union(*[[i for i in self.nbrs[u] if i not in self.x] for u in near]))
        d = np.stack([self.x[i] for i in ids]) - q
        out = (d * d).sum(axis=1)
        self.measured.update(zip(ids, out.tolist(), strict=True))
        return out


class _Same:
    """Ids of a graph whose nodes are known by their ids."""

    def __init__(self, n: int):
        self.n = n

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        return i


def _nodes(edges: DataFrame, base: DataFrame, deleted: DataFrame | None) -> DataFrame:
    """(node, v, nbrs, gone) for every base vector."""
    x = base.select(F.col("vec_id").cast("long").alias("node"), F.col("v").cast("array<double>").alias("v"))
    e = edges.select(F.col("src").cast("long").alias("node"), F.col("pos").cast("long"), F.col("dst").cast("long")).join(x.select(F.col("node").alias("dst")), "dst", "left_semi")
    lists = e.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("pos", "dst"))).alias("l")).select("node", F.transform("l", lambda p: p["dst"]).alias("nbrs"))
    out = x.join(lists, "node", "left").withColumn("nbrs", F.coalesce("nbrs", F.array().cast("array<long>")))
    if deleted is None:
        return out.withColumn("gone", F.lit(False))
    gone = deleted.select(F.col("vec_id").cast("long").alias("node")).distinct().withColumn("gone", F.lit(True))
    return out.join(gone, "node", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))


def _at_positions(rows: DataFrame, nodes: DataFrame) -> tuple[DataFrame, int]:
    """rows with start_ as an id instead of a hash that is taken modulo the number of nodes; and that number."""
    placed = _cut(nodes.select("node").orderBy("node").select("node", F.monotonically_increasing_id().alias("at_")))
    # the id holds the partition above 33 bits of the row in it
    sizes = sorted(placed.groupBy(F.shiftright("at_", 33).alias("part_")).count().collect())
    starts = np.cumsum([0, *[c for _, c in sizes]]).tolist()
    table = nodes.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(sizes, starts[:-1], strict=True)], "part_ long, first_ long")
    at = placed.withColumn("part_", F.shiftright("at_", 33)).join(F.broadcast(table), "part_")
    at = at.select(F.col("node").alias("entry_"), (F.col("first_") + F.col("at_") % (1 << 33)).alias("start_"))
    rows = rows.withColumn("start_", F.pmod("start_", F.lit(starts[-1])))
    return rows.join(at, "start_").withColumn("start_", F.col("entry_")).drop("entry_"), starts[-1]


def _in_rounds(query: DataFrame, nodes: DataFrame, seed: int, entry: int | None, schema: str, judge) -> DataFrame:
    """What _over_queries gives, over a table of nodes: in each round every open query gets the nodes it asked for.

    The look ahead doubles, so rounds grow with the length of a path through the graph, not with the nodes expanded.
    """
    spark = query.sparkSession
    names = [c.split(" ")[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    target = pa.schema([(c.split(" ")[0], kinds[c.split(" ")[1]]) for c in f"{schema}, want_ long".split(", ")])
    extra = [c for c in query.columns if c not in ("q_id", "v")]
    first = F.xxhash64(F.lit(seed), "q_id")
    if entry is not None:  # the id itself, or the next one
        first = F.lit(nodes.where(F.col("node") >= entry).agg(F.min("node")).first()[0]).cast("long")
    rows = query.select(F.col("q_id").cast("long").alias("q_id"), F.col("v").cast("array<double>").alias("v"), first.alias("start_"), *extra)
    rows, n = _at_positions(rows, nodes) if entry is None else (rows, nodes.count())
    rows = _cut(rows.select("q_id", "v", "start_", *extra))
    known = spark.createDataFrame([], "q_id long, node long, v array<double>, nbrs array<long>, gone boolean")

    def search(ahead: int):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            out, lack = [], set()
            more = [left[c].to_pylist() for c in extra]
            for i, (q, v, at) in enumerate(zip(left["q_id"].to_pylist(), left["v"].to_pylist(), left["start_"].to_pylist(), strict=True)):
                try:
                    out += [(*r, None) for r in judge(_Same(n), _Part(right, ahead), q, np.array(v), at, *[m[i] for m in more])]
                except _Missing as e:
                    lack |= e.args[0]
            if lack:  # rows of one id are answered together
                out = [(left["q_id"][0].as_py(), *[None] * (len(names) - 1), i) for i in sorted(lack)]
            cols = list(zip(*out, strict=True)) or [()] * len(target)
            return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, target, strict=True)], schema=target)

        return run

    done, ahead = None, AHEAD
    while True:
        met = spread(rows, "q_id").groupBy("q_id").cogroup(spread(known, "q_id").groupBy("q_id"))
        got = _cut(met.applyInArrow(search(ahead), f"{schema}, want_ long"))
        part = got.where("want_ IS NULL").select(*names)
        done = part if done is None else done.union(part)
        asked = got.where("want_ IS NOT NULL").select("q_id", F.col("want_").alias("node"))
        if asked.isEmpty():
            return done
        still = asked.select(F.col("q_id").alias("still_")).distinct()
        rows = rows.join(still, F.col("q_id").eqNullSafe(F.col("still_")), "left_semi")
        known = known.join(still, F.col("q_id").eqNullSafe(F.col("still_")), "left_semi").union(asked.join(nodes, "node").select("q_id", "node", "v", "nbrs", "gone"))
        rows, known, ahead = _cut(rows), _cut(known), 2 * ahead


def _search(query: DataFrame, edges: DataFrame, base: DataFrame, deleted: DataFrame | None, seed: int, entry: int | None, schema: str, judge) -> DataFrame:
    """judge() for each query on the whole graph, sent to the executors or, if it is larger than the bound, as a table."""
    held = edges.is_cached
    edges = edges if held else edges.persist()  # measured, then read
    try:
        if shards_needed(edges, base) > 1:
            nodes = _cut(_nodes(edges, base, deleted))
        else:
            ids, graph = _load(edges, base, deleted)
            return _over_queries(query, ids, graph, seed, entry, schema, judge)
    finally:
        if not held:
            edges.unpersist()
    return _in_rounds(query, nodes, seed, entry, schema, judge)


def beam_search(
    query: DataFrame, edges: DataFrame, base: DataFrame, k: int, ef: int, budget: int | None = None, seed: int = 1, entry: int | None = None,
    expansions: int | None = None, deleted: DataFrame | None = None,
) -> DataFrame:
    """(q_id, rank, id, dist, ndc, hops): the k nearest that a beam of ef finds.  ef under k searches by steps."""
    width = max(ef, k)
    steps = ef + 1 if ef < k and expansions is None else expansions

    def judge(ids, graph, q, v, at):
        f = beam(graph, v, at, width, budget, steps)
        return [(q, r + 1, int(ids[i]), d, f.ndc, f.hops) for r, (d, i) in enumerate(f.found[:k])]

    return _search(query, edges, base, deleted, seed, entry, "q_id long, rank int, id long, dist double, ndc long, hops long", judge)


def recall(result: DataFrame, gt: DataFrame, k: int) -> DataFrame:
    """(q_id, hits): how many of the first k true neighbours a result holds; 0 where it holds none."""
    true = gt.where(F.col("rank") <= k).select("q_id", "id")
    hits = result.select("q_id", "id").distinct().join(true, ["q_id", "id"], "left_semi").groupBy("q_id").agg(F.count("*").alias("hits"))
    return true.select("q_id").distinct().join(hits, "q_id", "left").select("q_id", F.coalesce("hits", F.lit(0)).alias("hits"))


def _with_truth(query: DataFrame, gt: DataFrame, k: int) -> DataFrame:
    true = gt.where(F.col("rank") <= k).groupBy("q_id").agg(F.collect_list("id").alias("true_ids"))
    return query.join(true, "q_id")


def recall_at_budget(query: DataFrame, edges: DataFrame, base: DataFrame, gt: DataFrame, k: int, budgets: Sequence[int] = (500, 1000, 2000, 4000, 8000, 16000, 32000, 64000), ef: int = 1000, seed: int = 1) -> DataFrame:
    """(q_id, budget, hits, ndc) for each query and budget of distance computations."""

    def judge(ids, graph, q, v, at, true):
        true = set(true)
        for b in budgets:
            f = beam(graph, v, at, max(k, ef), b)
            yield q, b, sum(int(ids[i]) in true for _, i in f.found[:k]), f.ndc

    return _search(_with_truth(query, gt, k), edges, base, None, seed, None, "q_id long, budget long, hits long, ndc long", judge)


def ef_sweep(query: DataFrame, edges: DataFrame, base: DataFrame, gt: DataFrame, k: int, efs: Sequence[int] = (10, 20, 40, 80), seed: int = 1) -> DataFrame:
    """(ef, recall, ndc, hops): means over the queries for each width of the beam."""

    def judge(ids, graph, q, v, at, true):
        true = set(true)
        for ef in efs:
            f = beam(graph, v, at, max(k, ef))
            yield q, ef, sum(int(ids[i]) in true for _, i in f.found[:k]), f.ndc, f.hops

    rows = _search(_with_truth(query, gt, k), edges, base, None, seed, None, "q_id long, ef int, hits long, ndc long, hops long", judge)
    return rows.groupBy("ef").agg((F.avg("hits") / k).alias("recall"), F.avg("ndc").alias("ndc"), F.avg("hops").alias("hops"))


def least_ndc(query: DataFrame, edges: DataFrame, base: DataFrame, gt: DataFrame, k: int, targets: Sequence[float] = (0.9,), low: int | None = None, bound: int = 5000, seed: int = 1) -> DataFrame:
    """(q_id, target, ef, ndc): the least beam that reaches each recall target, by doubling and bisection, and what it
    measured.

    Widths that were tried serve all targets.  A target that the bound does not reach gets the bound's figures.
    """

    def judge(ids, graph, q, v, at, true):
        true, tried = set(true), {}

        def at_width(ef: int) -> tuple[int, int]:
            if ef not in tried:
                f = beam(graph, v, at, ef)
                tried[ef] = sum(int(ids[i]) in true for _, i in f.found[:k]), f.ndc
            return tried[ef]

        for t in targets:
            need = count_target(t, k)
            lo = low or k
            hi, most = lo, max(lo, min(bound, len(ids)))  # a beam as wide as the graph sees all of it
            while hi < most and at_width(hi)[0] < need:
                lo, hi = hi + 1, min(2 * hi, most)
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (lo, mid) if at_width(mid)[0] >= need else (mid + 1, hi)
            yield q, t, lo, at_width(lo)[1]

    return _search(_with_truth(query, gt, k), edges, base, None, seed, None, "q_id long, target double, ef int, ndc long", judge)


def search_trace(query: DataFrame, edges: DataFrame, base: DataFrame, k: int, ef: int, seed: int = 1) -> DataFrame:
    """(q_id, hop, id, bound): the expanded node of each hop and the worst result so far."""

    def judge(ids, graph, q, v, at):
        for h, (u, d) in enumerate(beam(graph, v, at, max(ef, k), trace=True).trace):
            yield q, h, int(ids[u]), d

    return _search(query, edges, base, None, seed, None, "q_id long, hop int, id long, bound double", judge)


def hnsw_search(query: DataFrame, base: DataFrame, k: int, ef: int, m: int = 8, ef_build: int = 64, seed: int = 3) -> DataFrame:
    """(q_id, rank, id, dist, ndc, hops) by descent through the layers, then a beam on the lowest.

    Insertion is sequential: one task inserts the whole base, once, and must hold it; its layers are stored and sent to
    the executors as arrays.
    """
    from .graphs import layered_graph

    rows = _cut(layered_graph(base, m, ef_build, seed))
    ids, graph = _load(rows.where("pos < 0").select("src", "pos", "dst").limit(0), base, None)
    e = rows.toArrow().sort_by([("level", "ascending"), ("src", "ascending"), ("pos", "ascending")])
    level, src, pos, dst = (e[c].to_numpy() for c in ("level", "src", "pos", "dst"))
    src, dst = np.searchsorted(ids, src), np.searchsorted(ids, dst)
    layers = Hierarchy(graph.x, m, ef_build, seed)
    layers.layers = [Rows(len(ids), src[at], dst[at]) for lv in range(int(level.max(initial=0)) + 1) for at in [(level == lv) & (pos >= 0)]]
    layers.entry = int(src[pos < 0][0]) if len(src) else -1

    def judge(ids, layers, q, v, at):
        f = layers.search(v, k, ef)
        return [(q, r + 1, int(ids[i]), d, f.ndc, f.hops) for r, (d, i) in enumerate(f.found)]

    return _over_queries(query, ids, layers, seed, None, "q_id long, rank int, id long, dist double, ndc long, hops long", judge)


def count_target(share: float, k: int) -> int:
    """A share of k as a count, rounded up."""
    return math.ceil(round(share * k, 6))
