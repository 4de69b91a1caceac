"""How hard a query is on a graph: delta0, minimum effort and its variants, and the least degree K0.

For each query one row holds the first R ranks of its neighbour list with the out-neighbours of each; all kernels read
that row alone, so the only shuffle is by query.  R starts small and grows for the queries that need more; `Lists` finds
only as many neighbours as R asks for.  The adjacency of the graph is stored once and read in every step.  Effort without
a prefix walks the graph itself, sent as arrays, from both ends of every path: no query holds a row with all ranks.

delta0 is found through bottlenecks rather than by growing a prefix: b(s, t) is the least, over paths from s to t, of
the largest rank on the path, and delta0 = max(k, p-th least over s of (r-th least over t of b(s, t))).
"""

from __future__ import annotations

import heapq
import math
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import spread
from .graphs import adjacency
from .knn import _vectors, exact_knn
from .search import shards_needed
from .stats import _cut

INF = math.inf
#: Stands for no way among whole-number costs; sums of a row of them stay in 64 bits.
FAR = 1 << 50
#: Ranks that are tried in turn; None stands for all.
RANKS = (100, 400, 1600, 6400, 25_600, None)


class Prefix:
    """The neighbour list of one query by rank, with full out-lists: everything the kernels need."""

    def __init__(self, ids: list[int], out: list[list[int]], total: int):
        self.ids, self.out, self.total = ids, out, total
        rank = {v: r for r, v in enumerate(ids, 1)}
        self.next = [[rank[v] for v in o if v in rank] for o in out]
        self.place = [[(p, rank[v]) for p, v in enumerate(o, 1) if v in rank] for o in out]
        self._found: dict[tuple[int, int], dict[int, int]] = {}
        self._back: dict[tuple[int, int], np.ndarray] = {}
        self._into: dict[int, list[list[int]]] = {}

    def degree(self, r: int) -> int:
        return len(self.out[r - 1])

    def bottlenecks(self, s: int, k: int, upto: int, by_position: bool = False) -> dict[int, int]:
        """b(s, t) for each rank t <= k that can be reached inside the first `upto` ranks.

        by_position: paths are judged by the largest position of an edge in its list rather than by ranks.
        """
        first = 0 if by_position else s
        best, heap, found = {s: first}, [(first, s)], {}
        while heap:
            b, u = heapq.heappop(heap)
            if b > best[u]:
                continue
            if u <= k:
                found[u] = b
                if len(found) == k:
                    break
            for p, v in self.place[u - 1]:
                c = max(b, p if by_position else v)
                if v <= upto and c < best.get(v, INF):
                    best[v] = c
                    heapq.heappush(heap, (c, v))
        return found

    def reach(self, s: int, k: int, m: int) -> list[int]:
        """Ranks t <= k that s reaches inside the first m ranks, itself included."""
        seen, todo = {s}, [s]
        while todo:
            for v in self.next[todo.pop() - 1]:
                if v <= m and v not in seen:
                    seen.add(v)
                    todo.append(v)
        return sorted(t for t in seen if t <= k)

    def sources(self, k: int, r: int, p: int, m: int) -> list[tuple[int, list[int]]]:
        """The first p ranks that reach r of the k nearest or more, with what they reach."""
        out = []
        for s in range(1, min(k, m) + 1):
            t = self.reach(s, k, m)
            if len(t) >= r:
                out.append((s, t))
                if len(out) == p:
                    break
        return out

    def cheapest(self, s: int, targets: list[int], m: int, weights: bool = True, free: set[int] | None = None) -> set[int]:
        """Nodes on the cheapest paths from s to the targets; leaving u costs its out-degree, or nothing if it is free.

        Each node has one predecessor, the tight one of least (distance, rank).  A target counts only where it lies on
        the way to another.
        """
        dist, pred, heap, left = {s: 0}, {}, [(0, s)], set(targets)
        done: set[int] = set()
        while heap and left:
            d, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            left.discard(u)
            step = 0 if free and u in free else self.degree(u) if weights else 1
            for v in self.next[u - 1]:
                if v <= m and d + step < dist.get(v, INF):
                    dist[v], pred[v] = d + step, u
                    heapq.heappush(heap, (d + step, v))
        return self._chains(targets, pred)

    def shortest(self, s: int, targets: list[int], m: int) -> set[int]:
        """Nodes on breadth-first paths from s to the targets; the first discoverer is the predecessor."""
        pred, seen, todo = {}, {s}, deque([s])
        while todo:
            u = todo.popleft()
            for v in self.next[u - 1]:
                if v <= m and v not in seen:
                    seen.add(v)
                    pred[v] = u
                    todo.append(v)
        return self._chains(targets, pred)

    def distances(self, s: int, m: int) -> tuple[dict[int, int], dict[int, int]]:
        """Cost to each rank that s reaches inside the first m, and the predecessors on the way."""
        dist, pred, heap = {s: 0}, {}, [(0, s)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for v in self.next[u - 1]:
                c = d + self.degree(u)
                if v <= m and c < dist.get(v, INF):
                    dist[v], pred[v] = c, u
                    heapq.heappush(heap, (c, v))
        return dist, pred

    def tree(self, s: int, targets: list[int], m: int) -> set[int]:
        """Nodes of a two-level greedy tree from s to the targets.

        Again and again the cheapest bunch a target is taken: a hub and its nearest uncovered targets, at the cost of
        the way to the hub and from there to each.  Ties go to the lesser hub, then to the smaller bunch.  Costs from
        all hubs come from one search back from each target; only chosen hubs are searched forward.
        """
        left, nodes = sorted(set(targets) - {s}), set()
        from_s, to_hub = self.distances(s, m)
        hubs = sorted(from_s)
        to_s = np.array([from_s[h] for h in hubs], np.int64)
        rest = {t: self._rest(t, m)[hubs] for t in left}
        while left:
            near = np.stack([rest[t] for t in left], axis=1)
            order = np.argsort(near, axis=1, kind="stable")
            near = np.take_along_axis(near, order, axis=1)
            cost = (to_s[:, None] + near.cumsum(axis=1)) / np.arange(1, len(left) + 1)
            cost[near == FAR] = INF
            best = int(cost.argmin())
            if cost.flat[best] == INF:
                break
            at, last = divmod(best, len(left))
            h, got = hubs[at], [left[i] for i in order[at, : last + 1].tolist()]
            nodes |= self._chains([h], to_hub) | self._chains(got, self._ways(h, m)) | ({h} if h != s else set())
            left = [t for t in left if t not in got]
        return nodes | ({s} if targets else set())

    def _ways(self, h: int, m: int) -> dict[int, int]:
        """Predecessors on the cheapest ways from h, found once for all sources."""
        if (h, m) not in self._found:
            self._found[h, m] = self.distances(h, m)[1]
        return self._found[h, m]

    def _rest(self, t: int, m: int) -> np.ndarray:
        """Cost to t by rank of the first m, FAR where none leads there, found once for all sources."""
        if (t, m) in self._back:
            return self._back[t, m]
        if m not in self._into:
            self._into[m] = into = [[] for _ in range(m + 1)]
            for u in range(1, m + 1):
                for v in self.next[u - 1]:
                    if v <= m:
                        into[v].append(u)
        into, rest, heap = self._into[m], {t: 0}, [(0, t)]
        while heap:
            d, v = heapq.heappop(heap)
            if d > rest[v]:
                continue
            for u in into[v]:
                c = d + self.degree(u)
                if c < rest.get(u, INF):
                    rest[u] = c
                    heapq.heappush(heap, (c, u))
        found = self._back[t, m] = np.full(m + 1, FAR)
        found[list(rest)] = list(rest.values())
        return found

    def flow_tree(self, s: int, targets: list[int], m: int) -> set[int]:
        """Nodes of a tree from s to the targets by simulated flow.

        Every uncovered target sends one unit a second against the edges.  An edge fills up at the rate of the targets
        behind its head and, once full, passes them on to its tail, unless a target would reach a node on two ways.
        When the root is reached, its full edges become free, its targets are covered, and the rest starts again.
        """
        within = [u for u in range(1, m + 1)]
        into: dict[int, list[int]] = {v: [] for v in within}
        for u in within:
            for v in dict.fromkeys(self.next[u - 1]):
                if v <= m and v != u:
                    into[v].append(u)
        free: set[tuple[int, int]] = set()
        nodes: set[int] = {s} if targets else set()
        left = set(targets) - {s}
        while left:
            tree, covered = self._flood(s, left, into, free)
            if not covered:
                break
            free |= tree
            nodes |= {u for u, _ in tree}
            left -= covered
        return nodes

    def _flood(self, s: int, left: set[int], into: dict[int, list[int]], free: set[tuple[int, int]]) -> tuple[set[tuple[int, int]], set[int]]:
        """One run of the flow until s is reached: the full edges below it, and the targets it reaches."""
        price = lambda u, v: 0 if (u, v) in free else self.degree(u)
        behind = {t: {t} for t in left}  # targets behind each node that the flow has reached
        volume = dict.fromkeys(left, 0.0)  # what each edge into a node has got so far
        queue = {t: sorted((price(u, t), u) for u in into[t]) for t in left}
        below: dict[int, list[int]] = {}
        above: dict[int, list[int]] = {}
        while True:
            due = [((q[0][0] - volume[v]) / len(behind[v]), v) for v, q in queue.items() if q]
            if not due:
                return set(), set()
            wait, v = min(due)
            wait = max(wait, 0.0)
            for x in volume:
                volume[x] += wait * len(behind[x])
            _, u = queue[v].pop(0)
            up, todo = {u}, [u]
            while todo:
                for x in above.get(todo.pop(), ()):
                    if x not in up:
                        up.add(x)
                        todo.append(x)
            if v in up or any(behind.get(x, set()) & behind[v] for x in up):
                continue
            below.setdefault(u, []).append(v)
            above.setdefault(v, []).append(u)
            for x in up:
                if x not in behind:
                    behind[x], volume[x] = set(), 0.0
                    queue[x] = sorted((price(y, x), y) for y in into[x])
                behind[x] |= behind[v]
            if s in up:
                tree, todo = set(), [s]
                while todo:
                    a = todo.pop()
                    for b in below.get(a, ()):
                        if (a, b) not in tree:
                            tree.add((a, b))
                            todo.append(b)
                return tree, set(behind[s])

    @staticmethod
    def _chains(targets: list[int], pred: dict[int, int]) -> set[int]:
        on: set[int] = set()
        for t in targets:
            while t in pred and (t := pred[t]) not in on:
                on.add(t)
        return on

    def expanded(self, ranks: set[int]) -> set[int]:
        """Ids of the ranks and of all their out-neighbours."""
        return {self.ids[r - 1] for r in ranks}.union(*[self.out[r - 1] for r in ranks])


def delta0_of(x: Prefix, k: int, r: int, p: int) -> int | None:
    """delta0, or None if the ranks at hand don't suffice."""
    if len(x.ids) < k:
        return None
    reached = sorted(sorted(b.values())[r - 1] for s in range(1, k + 1) if len(b := x.bottlenecks(s, k, len(x.ids))) >= r)
    return max(k, reached[p - 1]) if len(reached) >= p else None


def cadence_of(d: int) -> int:
    """The value a test at every 100th rank beyond 1000 would give."""
    return d if d <= 1000 else -(-(d - 1) // 100) * 100 + 1


def k0_of(x: Prefix, k: int, r: int, p: int, beta: float) -> int | None:
    """The least list length at which p sources reach r of the k nearest inside the first (1 + beta) k ranks."""
    upto = math.floor((1 + beta) * k)
    reached = sorted(sorted(b.values())[r - 1] for s in range(1, k + 1) if len(b := x.bottlenecks(s, k, upto, True)) >= r)
    return max(1, reached[p - 1]) if len(reached) >= p else None


def effort_of(x: Prefix, k: int, r: int, p: int, m: int, path: str = "dijkstra", agg: str = "sum", expand: bool = True, overlap: bool = False) -> int:
    """Minimum effort inside the first m ranks.

    path: dijkstra (node weights), bfs, or a cover of all targets of a source at
    once: tree (greedy bunches) or flow (simulated flow).  agg: sum joins the paths of all sources; max takes the dearest source.
    expand: count the out-neighbours of path nodes too.  overlap: nodes paid for by earlier sources are free.
    """
    m = min(m, len(x.ids))
    pairs = x.sources(k, r, p, m)
    if len(pairs) < p:  # no paths to judge: the prefix itself
        return m if m >= 10_000 else len(x.expanded(set(range(1, m + 1))))
    targets = {x.ids[t - 1] for _, ts in pairs for t in ts}
    total: set[int] = set()
    worst = 0
    for s, ts in pairs:
        if path == "dijkstra":
            nodes = x.cheapest(s, ts, m, free=total if overlap else None)
        else:
            nodes = {"bfs": x.shortest, "tree": x.tree, "flow": x.flow_tree}[path](s, ts, m)
        if agg == "max":
            own = {x.ids[t - 1] for t in ts} if path == "bfs" else targets
            worst = max(worst, len((x.expanded(nodes) if expand else {x.ids[n - 1] for n in nodes}) | own))
        total |= nodes
    if agg == "max":
        return worst
    return len((x.expanded(total) if expand else {x.ids[n - 1] for n in total}) | targets)


def unbounded_effort_of(x: Prefix, k: int, r: int, p: int) -> int:
    """Effort without a prefix: the first p sources, overlapping paths through all ranks at hand, path nodes expanded."""
    total: set[int] = set()
    for s in range(1, min(p, len(x.ids)) + 1):
        ts = x.reach(s, k, len(x.ids))[:]
        total |= x.cheapest(s, ts, len(x.ids), free=total)
    return len(x.expanded(total))


class Whole:
    """The whole graph as arrays, nodes by place: unbounded effort without a list of all ranks.

    Ranks only settle ties between nodes, by distance to the query and then id, and are measured where they are needed.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, src: np.ndarray, dst: np.ndarray):
        """ids are sorted; the edges' ends are ids, in order of source and position.  Only nodes with a vector are walked."""
        self.ids, self.x = ids, x
        self.out_first, self.out_end, self.out = np.searchsorted(src, ids), np.searchsorted(src, ids, "right"), dst
        self.degrees = (self.out_end - self.out_first).tolist()
        known = np.isin(src, ids) & np.isin(dst, ids)
        a, b = np.searchsorted(ids, src[known]), np.searchsorted(ids, dst[known])
        back = np.argsort(b, kind="stable")
        places = np.arange(len(ids) + 1)
        self.next_first, self.next = np.searchsorted(a, places), b
        self.into_first, self.into = np.searchsorted(b[back], places), a[back]

    def after(self, u: int) -> list[int]:
        return self.next[self.next_first[u] : self.next_first[u + 1]].tolist()

    def before(self, v: int) -> list[int]:
        return self.into[self.into_first[v] : self.into_first[v + 1]].tolist()

    def effort(self, q: np.ndarray, near: list[int], p: int) -> int:
        """unbounded_effort_of for the query vector with its k nearest ids."""
        at = np.searchsorted(self.ids, near).tolist()
        far: dict[int, float] = {}
        total: set[int] = set()
        for s in at[:p]:
            total |= self._cheapest(s, at, q, far, total)
        out = {int(self.ids[u]) for u in total}
        return len(out.union(*[self.out[self.out_first[u] : self.out_end[u]].tolist() for u in total]))

    def _cheapest(self, s: int, targets: list[int], q: np.ndarray, far: dict[int, float], free: set[int]) -> set[int]:
        """Prefix.cheapest over all ranks: the same nodes from a walk that only enters what may lie on a cheapest path.

        One search from s and one back from each target meet; node v with cost d from s stays out if d and the least
        cost from v to any target exceed that target's cost.  What stays out leads to no cheapest path, so what is
        walked is met in the same order and gets the same predecessors.
        """
        degrees = self.degrees
        cost, heap, done = {s: 0}, [(0, s)], set()
        reached, ball, spare = [], -1, {}  # spare: the largest cost at which a node may still lie on a cheapest path
        for t in targets:
            best, rest, back, settled = cost.get(t, INF), {t: 0}, [(0, t)], []
            while heap and back and heap[0][0] + back[0][0] <= best:
                if len(heap) <= len(back):
                    d, u = heapq.heappop(heap)
                    if u in done:
                        continue
                    done.add(u)
                    d += 0 if u in free else degrees[u]
                    for v in self.after(u):
                        if d < cost.get(v, INF):
                            cost[v] = d
                            heapq.heappush(heap, (d, v))
                        if v in rest and d + rest[v] < best:
                            best = d + rest[v]
                else:
                    d, v = heapq.heappop(back)
                    if d > rest[v]:
                        continue
                    settled.append(v)
                    for u in self.before(v):
                        c = d if u in free else d + degrees[u]
                        if c < rest.get(u, INF):
                            rest[u] = c
                            heapq.heappush(back, (c, u))
                            if u in cost and cost[u] + c < best:
                                best = cost[u] + c
            if best == INF:
                continue
            reached.append(t)
            if back:
                ball = max(ball, best - back[0][0])
            for v in settled:
                spare[v] = max(spare.get(v, -1), best - rest[v])
        return self._walk(s, reached, q, far, free, ball, spare)

    def _walk(self, s: int, targets: list[int], q: np.ndarray, far: dict[int, float], free: set[int], ball: int, spare: dict[int, int]) -> set[int]:
        cost, pred, done, left = {s: 0}, {}, set(), set(targets)
        heap = [(0, 0.0, s)]
        while heap and left:
            d, _, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            left.discard(u)
            d += 0 if u in free else self.degrees[u]
            new = [v for v in dict.fromkeys(self.after(u)) if d < cost.get(v, INF) and (d <= ball or d <= spare.get(v, -1))]
            if unknown := [v for v in new if v not in far]:
                gap = self.x[unknown] - q
                far.update(zip(unknown, (gap * gap).sum(axis=1).tolist(), strict=True))
            for v in new:
                cost[v], pred[v] = d, u
                heapq.heappush(heap, (d, far[v], v))
        return Prefix._chains(targets, pred)


# -- over tables ----------------------------------------------------------------------------------------------------
class Lists:
    """Neighbour lists of the whole base, or of `depth` ranks, that are only searched as deep as they are read."""

    def __init__(self, base: DataFrame, query: DataFrame, depth: int | None = None):
        self.base, self.query = base, query
        n = base.where("vec_id IS NOT NULL AND v IS NOT NULL").count()
        self.total = min(n, depth) if depth else n
        self.whole = self.total == n

    def first(self, n: int | None, only: DataFrame | None = None) -> DataFrame:
        """(q_id, rank, id, total) of the first n ranks; only(q_id): of those queries."""
        q = self.query if only is None else self.query.join(only, "q_id", "left_semi")
        gt = exact_knn(self.base, q, min(n or self.total, self.total) or 1)
        return gt.select("q_id", "rank", "id", F.lit(self.total).cast("long").alias("total"))


def _first(gt: DataFrame | Lists, n: int | None, only: DataFrame | None = None) -> DataFrame:
    if isinstance(gt, Lists):
        return gt.first(n, only)
    g = gt if only is None else gt.join(only, "q_id", "left_semi")
    total = g.groupBy("q_id").agg(F.max("rank").cast("long").alias("total"))
    return (g if n is None else g.where(F.col("rank") <= n)).select("q_id", "rank", "id").join(total, "q_id")


def prefixes(gt: DataFrame | Lists, lists: DataFrame, max_rank: int | None = None, only: DataFrame | None = None) -> DataFrame:
    """(q_id, ids, outs, total): one row for each query with its first ranks and their out-lists; lists(src, dsts)."""
    rows = _first(gt, max_rank, only).join(lists.withColumnRenamed("src", "id"), "id", "left")
    # dealt by query once; the grouping below needs no further exchange
    packed = spread(rows, "q_id").groupBy("q_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "id", F.coalesce("dsts", F.array().cast("array<bigint>")).alias("dsts")))).alias("p"), F.max("total").alias("total")
    )
    return packed.select("q_id", F.transform("p", lambda x: x["id"]).alias("ids"), F.transform("p", lambda x: x["dsts"]).alias("outs"), "total")


def _judged(rows: DataFrame, names: tuple[str, ...], judge: Callable[..., tuple[int | None, ...]], extra: tuple[str, ...] = ()) -> DataFrame:
    """(q_id, names) with judge(prefix, extra columns) for each query; null where it gives None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for i in range(batch.num_rows):
                x = Prefix(batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), batch.column(3)[i].as_py())
                got.append(judge(x, *[batch.column(4 + c)[i].as_py() for c in range(len(extra))]))
            cols = list(zip(*got, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in cols]], ["q_id", *names])

    return rows.select("q_id", "ids", "outs", "total", *extra).mapInArrow(run, "q_id long, " + ", ".join(f"{n} long" for n in names))


def _growing(gt: DataFrame | Lists, edges: DataFrame, ranks: tuple[int | None, ...], names: tuple[str, ...], judge: Callable[..., tuple[int | None, ...]]) -> DataFrame:
    """Judge all queries on their first ranks; those that give None first are judged again with more."""
    done, open_, lists = None, None, _cut(adjacency(edges))
    for step, n in enumerate(ranks):
        found = _judged(prefixes(gt, lists, n, open_), names, judge)
        if step < len(ranks) - 1:
            found = _cut(found)  # a few numbers for each query, used twice
            open_ = found.where(F.col(names[0]).isNull()).select("q_id")
            last = open_.isEmpty()
            found = found.where(F.col(names[0]).isNotNull())
        else:
            last = True
        done = found if done is None else done.union(found)
        if last:
            return done
    return done


def _settled(x: Prefix, k: int, r: int, p: int) -> int | None:
    """delta0; one more than the whole list's length if that doesn't suffice; None if only the ranks at hand don't."""
    return delta0_of(x, k, r, p) or (x.total + 1 if len(x.ids) >= x.total else None)


def delta0(gt: DataFrame | Lists, edges: DataFrame, k: int, r: int, p: int, ranks: tuple[int | None, ...] = RANKS, cadence: bool = False) -> DataFrame:
    """(q_id, delta0): the least prefix of the neighbour list in which p of the k nearest reach r of them.

    Never found: one more than the list's length.
    """
    done = _growing(gt, edges, ranks, ("delta0",), lambda x: (_settled(x, k, r, p),))
    if cadence:
        high = F.when(F.col("delta0") <= 1000, F.col("delta0")).otherwise(F.ceil((F.col("delta0") - 1) / 100) * 100 + 1)
        done = done.select("q_id", high.alias("delta0"))
    return done


def minimum_effort(gt: DataFrame, edges: DataFrame, delta: DataFrame, k: int, r: int, p: int, name: str = "me", **how) -> DataFrame:
    """(q_id, me) inside each query's delta0 ranks; `how` as in effort_of."""
    inside = gt.join(delta.select("q_id", F.col("delta0").alias("m")), "q_id").where(F.col("rank") <= F.col("m")).select("q_id", "rank", "id")
    rows = prefixes(inside, adjacency(edges)).join(delta.select("q_id", F.col("delta0").alias("m")), "q_id")
    return _judged(rows, (name,), lambda x, m: (effort_of(x, k, r, p, m, **how),), ("m",))


def hardness(gt: DataFrame | Lists, edges: DataFrame, k: int, r: int, p: int, ranks: tuple[int | None, ...] = RANKS, **how) -> DataFrame:
    """(q_id, delta0, me): delta0 and the minimum effort in it, both from one reading of each query's ranks.

    With the edges of an occlusion-pruned graph this is a measure of the query alone.
    """

    def judge(x: Prefix) -> tuple[int | None, int | None]:
        d = _settled(x, k, r, p)
        return d, None if d is None else effort_of(x, k, r, p, d, **how)

    return _growing(gt, edges, ranks, ("delta0", "me"), judge)


def effort_fixed_delta(gt: DataFrame | Lists, edges: DataFrame, k: int, r: int, p: int, delta: int, **how) -> DataFrame:
    """(q_id, me) inside the first k + delta ranks."""
    return _judged(prefixes(gt, adjacency(edges), k + delta), ("me",), lambda x: (effort_of(x, k, r, p, k + delta, **how),))


def effort_unbounded(gt: DataFrame | Lists, edges: DataFrame, k: int, r: int, p: int) -> DataFrame:
    """(q_id, me) through the whole list of each query.

    Of lists over the whole base only the first k ranks are searched, and the graph is sent as arrays below the measured
    bound of graph searches; beyond it, and for a list that ends before the base does, each query gets all its ranks.
    """
    if isinstance(gt, Lists) and gt.whole and shards_needed(edges := _cut(edges), gt.base) == 1:
        return _unbounded_by_arrays(gt, edges, k, p)
    return _judged(prefixes(gt, adjacency(edges)), ("me",), lambda x: (unbounded_effort_of(x, k, r, p),))


def _unbounded_by_arrays(gt: Lists, edges: DataFrame, k: int, p: int) -> DataFrame:
    vector = F.col("v").cast("array<double>").alias("v")
    rows = gt.base.where("vec_id IS NOT NULL AND v IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), vector).toArrow().sort_by("vec_id")
    x = _vectors(rows["v"].combine_chunks()) if rows.num_rows else np.zeros((0, 0))
    e = edges.select(F.col("src").cast("long"), F.col("pos").cast("long"), F.col("dst").cast("long")).toArrow().sort_by([("src", "ascending"), ("pos", "ascending")])
    there = np.isfinite(x).all(axis=1)  # others are in no list
    whole = Whole(rows["vec_id"].to_numpy()[there], x[there], e["src"].to_numpy(), e["dst"].to_numpy())
    sent = gt.base.sparkSession.sparkContext.broadcast(whole)
    near = gt.first(k).groupBy("q_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id"))).alias("p"))
    near = near.join(gt.query.select("q_id", vector), "q_id").select("q_id", F.transform("p", lambda x: x["id"]).alias("ids"), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, got = _vectors(batch.column(2)) if batch.num_rows else [], []
            for i, ids in enumerate(batch.column(1).to_pylist()):
                got.append(sent.value.effort(q[i], ids, p))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.int64())], ["q_id", "me"])

    return spread(near, "q_id").mapInArrow(run, "q_id long, me long")


def k0(gt: DataFrame | Lists, edges: DataFrame, k: int, r: int, p: int, beta: float = 1.0) -> DataFrame:
    """(q_id, k0); null where no list length suffices."""
    return _judged(prefixes(gt, adjacency(edges), math.floor((1 + beta) * k)), ("k0",), lambda x: (k0_of(x, k, r, p, beta),))
