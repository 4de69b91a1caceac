"""Graph searches, sweeps, builders and effort variants against plain versions that share no code with the package."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecscope.operators import graphs, knn
from vecscope.plans.queries import CAND, K, P, QUERIES, R
from vecscope.plans.tables import base_query


@pytest.fixture(scope="module")
def world(spark, sf):
    b, q = base_query(spark, sf)
    x = {r["vec_id"]: np.array(r["v"], float) for r in b.collect()}
    qs = {r["q_id"]: np.array(r["v"], float) for r in q.collect()}
    out = {i: [] for i in x}
    for r in sorted(graphs.build_graph(b, "mrng", CAND).collect(), key=lambda r: (r["src"], r["pos"])):
        out[r["src"]].append(r["dst"])
    ids = sorted(x)
    starts = {r[0]: ids[r[1]] for r in q.select("q_id", F.pmod(F.xxhash64(F.lit(1), "q_id"), F.lit(len(ids)))).collect()}
    order = {q: sorted(ids, key=lambda i: (d2(x[i], v), i)) for q, v in qs.items()}
    return x, qs, out, starts, order


def d2(a, b):
    return float(((a - b) ** 2).sum())


def plain(x, v, out, entry, width, budget=math.inf, most=math.inf, gone=()):
    """(results, measured, expanded nodes with the worst result before each): a list that is sorted anew in every step."""
    seen, waiting = {entry}, [(d2(x[entry], v), entry)]
    best = [] if entry in gone else list(waiting)
    measured, path = 1, []
    while waiting:
        waiting.sort()
        d, u = waiting.pop(0)
        if (len(best) >= width and d > best[-1][0]) or len(path) >= most:
            break
        path.append((u, best[-1][0] if best else math.inf))
        for w in out[u]:
            if w in seen:
                continue
            seen.add(w)
            if measured > budget:
                break
            measured += 1
            dw = d2(x[w], v)
            if len(best) < width or dw < best[-1][0]:
                waiting.append((dw, w))
                if w not in gone:
                    best = sorted([*best, (dw, w)])[:width]
        if measured > budget:
            break
    return best, measured, path


def same(got, want):
    key = lambda r: tuple(round(c, 6) if isinstance(c, float) else c for c in r)
    assert sorted(map(key, got)) == sorted(map(key, want))


@pytest.mark.parametrize("name,width,most,every", [("beam_search", 40, math.inf, 0), ("step_search", K, 7, 0), ("deleted_search", 40, math.inf, 3)])
def test_beams(spark, sf, world, name, width, most, every):
    x, qs, out, starts, _ = world
    gone = {i for i in x if every and i % every == 0}
    want = []
    for q, v in qs.items():
        best, measured, path = plain(x, v, out, starts[q], width, most=most, gone=gone)
        want += [(q, r, i, d, measured, len(path)) for r, (d, i) in enumerate(best[:K], 1)]
    same([tuple(r) for r in QUERIES[name](spark, sf).collect()], want)


def test_trace(spark, sf, world):
    x, qs, out, starts, _ = world
    want = [(q, h, u, b) for q, v in qs.items() for h, (u, b) in enumerate(plain(x, v, out, starts[q], 20)[2])]
    same([tuple(r) for r in QUERIES["search_trace"](spark, sf).collect()], want)


def test_budgets_and_widths(spark, sf, world):
    x, qs, out, starts, order = world
    hits = lambda q, best: len({i for _, i in best[:K]} & set(order[q][:K]))
    want = []
    for q, v in qs.items():
        for budget in (50, 100, 200, 400):
            best, measured, _ = plain(x, v, out, starts[q], 1000, budget=budget)
            want.append((q, budget, hits(q, best), measured))
    same([tuple(r) for r in QUERIES["recall_at_budget"](spark, sf).collect()], want)
    rows = []
    for ef in (10, 20, 40, 80):
        runs = [(q, plain(x, v, out, starts[q], ef)) for q, v in qs.items()]
        rows.append((ef, np.mean([hits(q, r[0]) for q, r in runs]) / K, np.mean([r[1] for _, r in runs]), np.mean([len(r[2]) for _, r in runs])))
    same([tuple(map(float, r)) for r in QUERIES["ef_sweep"](spark, sf).select("ef", "recall", "ndc", "hops").collect()], [tuple(map(float, r)) for r in rows])


def test_least_effort(spark, sf, world):
    x, qs, out, starts, order = world
    got = {(r["q_id"], r["target"]): (r["ef"], r["ndc"]) for r in QUERIES["least_ndc"](spark, sf).collect()}
    assert len(got) == 3 * len(qs)
    for (q, target), (ef, ndc) in got.items():
        need, truth = math.ceil(round(target * K, 6)), set(order[q][:K])
        enough = lambda w: len({i for _, i in plain(x, qs[q], out, starts[q], w)[0][:K]} & truth) >= need  # noqa: B023, E731
        assert plain(x, qs[q], out, starts[q], ef)[1] == ndc
        assert enough(ef) and (ef == K or not enough(ef - 1))


def test_small_world(spark, sf, world):
    x = world[0]
    ids = sorted(x)
    out = {i: [] for i in ids}
    for n, i in enumerate(ids[1:], 1):
        best, _, _ = plain(x, x[i], {u: [w for w in out[u]] for u in ids[:n]}, ids[0], min(64, n))
        for _, j in best[:16]:
            out[i].append(j)
            out[j].append(i)
    same([tuple(r)[1:] for r in QUERIES["nsw_edges"](spark, sf).collect()], [(i, p, j) for i, js in out.items() for p, j in enumerate(js)])


def layered(x, m, width, level_of):
    """Layers of lists by insertion, and the entry, without any of the package's code."""
    layers, entry = [], None

    def pick(near, cap):
        if len(near) < cap:
            return [i for _, i in near]
        kept = []
        for d, i in near:
            if len(kept) < cap and all(d2(x[u], x[i]) >= d for u in kept):
                kept.append(i)
        return kept

    for i in sorted(x):
        level, top = level_of(), len(layers) - 1
        while len(layers) <= level:
            layers.append({})
        for lv in range(level + 1):
            layers[lv][i] = []
        if entry is None:
            entry = i
            continue
        at = entry
        for lv in range(top, level, -1):
            while True:
                near = min([(d2(x[j], x[i]), n, j) for n, j in enumerate(layers[lv].get(at, []))], default=(math.inf, 0, at))
                if near[0] >= d2(x[at], x[i]):
                    break
                at = near[2]
        for lv in range(min(level, top), -1, -1):
            best = [b for b in plain(x, x[i], {u: ls for u, ls in layers[lv].items()}, at, width)[0] if b[1] != i]
            layers[lv][i] = pick(best, m)
            cap = 2 * m if lv == 0 else m
            for j in layers[lv][i]:
                layers[lv][j] = [*layers[lv][j], i]
                if len(layers[lv][j]) > cap:
                    layers[lv][j] = pick(sorted((d2(x[u], x[j]), u) for u in layers[lv][j]), cap)
            at = best[0][1] if best else at
        if level > top:
            entry = i
    return layers, entry


def test_hierarchies_and_their_search(spark, sf, world):
    x, qs, *_ = world
    rng = np.random.default_rng(3)
    layers, entry = layered(x, 8, 64, lambda: int(-math.log(max(rng.random(), 1e-300)) / math.log(8)))
    want = [(lv, i, p, j) for lv, lists in enumerate(layers) for i, js in lists.items() for p, j in enumerate(js)]
    same([tuple(r) for r in QUERIES["hnsw_edges"](spark, sf).collect()], want)
    flat, _ = layered(x, 8, 64, lambda: 0)
    same([tuple(r) for r in QUERIES["plain_hnsw_edges"](spark, sf).collect()], [(0, i, p, j) for i, js in flat[0].items() for p, j in enumerate(js)])
    rows = []
    for q, v in qs.items():
        at, measured, hops = entry, 1, 0
        for lv in range(len(layers) - 1, 0, -1):
            moved = True
            while moved:
                hops, moved, d = hops + 1, False, d2(x[at], v)
                for j in layers[lv].get(at, []):
                    measured += 1
                    if d2(x[j], v) < d:
                        at, d, moved = j, d2(x[j], v), True
        best, n, path = plain(x, v, layers[0], at, 40)
        rows += [(q, r, i, d, n + measured - 1, hops + len(path)) for r, (d, i) in enumerate(best[:K], 1)]
    same([tuple(r) for r in QUERIES["hnsw_search"](spark, sf).collect()], rows)


def reached(nexts, s):
    seen, todo = [s], [s]
    while todo:
        todo = [w for w in dict.fromkeys(w for u in todo for w in nexts[u]) if w not in seen]
        seen += todo
    return seen


def cheapest(nexts, cost, s, targets):
    """Nodes on the ways from s: Bellman-Ford costs, then for each node the tight predecessor of least cost, then rank."""
    dist = {s: 0}
    for _ in nexts:
        for u in list(dist):
            for w in nexts[u]:
                if dist[u] + cost[u] < dist.get(w, math.inf):
                    dist[w] = dist[u] + cost[u]
    on = set()
    for t in targets:
        while t != s:
            t = min((dist[u], u) for u in dist if t in nexts[u] and dist[u] + cost[u] == dist[t])[1]
            on.add(t)
    return on


def first_found(nexts, s, targets):
    parent, queue = {s: None}, [s]
    for u in queue:
        for w in nexts[u]:
            if w not in parent:
                parent[w] = u
                queue.append(w)
    on = set()
    for t in targets:
        while (t := parent[t]) is not None:
            on.add(t)
    return on


def test_effort_along_first_found_paths_and_overlaps(spark, sf, world):
    x, qs, out, _, order = world
    hard = {r["q_id"]: r["delta0"] for r in QUERIES["hardness"](spark, sf).collect()}
    bfs = {r["q_id"]: r["me"] for r in QUERIES["me_bfs"](spark, sf).collect()}
    over = {r["q_id"]: r["me"] for r in QUERIES["me_overlap"](spark, sf).collect()}
    for q in qs:
        near = order[q][: hard[q]]
        place = {i: n for n, i in enumerate(near)}
        nexts = [[place[w] for w in out[i] if w in place] for i in near]
        pairs = [(s, ts) for s in range(K) if len(ts := [t for t in reached(nexts, s) if t < K]) >= R][:P]
        ends = {near[t] for _, ts in pairs for t in ts}
        grown = lambda nodes: len({near[n] for n in nodes}.union(ends, *[out[near[n]] for n in nodes]))  # noqa: B023, E731
        assert len(pairs) == P and bfs[q] == grown(set().union(*[first_found(nexts, s, ts) for s, ts in pairs]))
        paid = set()
        for s, ts in pairs:
            cost = [0 if u in paid else len(out[near[u]]) for u in range(len(near))]
            on = zero_safe(nexts, cost, s, sorted(ts))
            paid |= on
        assert over[q] == grown(paid)


def zero_safe(nexts, cost, s, targets):
    """As `cheapest`, where leaving a node may cost nothing: settled in order of (cost, rank), first strict improvement."""
    dist, parent, done = {s: 0}, {}, set()
    while len(done) < len(dist):
        d, u = min((dist[i], i) for i in dist if i not in done)
        done.add(u)
        for w in nexts[u]:
            if d + cost[u] < dist.get(w, math.inf):
                dist[w], parent[w] = d + cost[u], u
    on = set()
    for t in targets:
        while t in parent:
            t = parent[t]
            on.add(t)
    return on


def test_effort_without_a_prefix(spark, sf, world):
    x, qs, out, _, order = world
    got = {r["q_id"]: r["me"] for r in QUERIES["me_unbounded"](spark, sf).collect()}
    for q in list(qs)[::5]:
        near = order[q]
        place = {i: n for n, i in enumerate(near)}
        nexts = [[place[w] for w in out[i]] for i in near]
        paid = set()
        for s in range(P):
            targets = [t for t in reached(nexts, s) if t < K]
            paid |= zero_safe(nexts, [0 if u in paid else len(out[near[u]]) for u in range(len(near))], s, sorted(targets))
        assert got[q] == len({near[n] for n in paid}.union(*[out[near[n]] for n in paid]))


def test_mahalanobis(spark, sf, world):
    x, qs, _, _, order = world
    m = np.stack(list(x.values()))
    inverse = np.linalg.pinv(np.cov(m.T))
    far = lambda g: float(g @ inverse @ g)
    for r in QUERIES["mahalanobis"](spark, sf).collect():
        assert abs(r["dist"] - far(qs[r["q_id"]] - m.mean(axis=0))) < 1e-5
    for r in QUERIES["mahalanobis_nearest"](spark, sf).collect():
        assert abs(r["dist"] - far(qs[r["q_id"]] - x[order[r["q_id"]][0]])) < 1e-5


def test_samples_of_a_mixture(spark, sf, world):
    x = world[0]
    rows = QUERIES["gmm_workload"](spark, sf).collect()
    assert len(rows) == 200 and all(r["dims"] == 64 and abs(r["norm2"] - 1) < 1e-5 for r in rows)
    inner = [min(d2(a, b) for j, b in list(x.items())[:200] if j != i) for i, a in list(x.items())[:60]]
    assert 0.3 < np.mean([r["nearest"] for r in rows]) / np.mean(inner) < 3


def test_search_among_expressions_is_bounded(spark, sf, monkeypatch):
    monkeypatch.setattr(knn, "EXPRESSION_PAIRS", 10)
    with pytest.raises(ValueError):
        knn.exact_knn(*base_query(spark, sf), 3, engine="sql")
