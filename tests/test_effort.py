"""Hand-made graphs with known answers, and properties of the kernels."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from vecscope.operators import effort
from vecscope.operators.effort import Prefix, Whole, cadence_of, delta0_of, effort_of, k0_of, unbounded_effort_of
from vecscope.operators.graphs import build_graph
from vecscope.operators.search import count_target


def prefix(n, edges, total=None):
    out = [[] for _ in range(n)]
    for a, b in edges:
        out[a - 1].append(b)
    return Prefix(list(range(1, n + 1)), out, total or n)


def by_growing(x, k, r, p):
    for m in range(k, len(x.ids) + 1):
        if sum(len(x.reach(s, k, m)) >= r for s in range(1, k + 1)) >= p:
            return m
    return None


def test_ring_holds_at_once():
    assert delta0_of(prefix(4, [(1, 2), (2, 3), (3, 4), (4, 1)]), 4, 4, 4) == 4


def test_bridge_beyond_the_nearest():
    halves = [(1, 2), (2, 1), (3, 4), (4, 3)]
    assert delta0_of(prefix(7, [*halves, (2, 7), (7, 3), (4, 1)]), 4, 4, 4) == 7


def test_line_has_too_few_sources():
    x = prefix(4, [(1, 2), (2, 3), (3, 4)])
    assert delta0_of(x, 4, 4, 2) is None
    assert effort_of(x, 4, 4, 2, 4) == 4


def test_tied_paths_use_the_lesser_rank():
    x = prefix(4, [(1, 2), (1, 3), (2, 4), (3, 4)])
    assert x.cheapest(1, [4], 4) == {1, 2}


def test_weights_avoid_the_hub():
    hub = [(1, 5), (5, 2), *[(5, n) for n in range(6, 12)]]
    x = prefix(11, [*hub, (1, 3), (3, 4), (4, 2)])
    assert x.cheapest(1, [2], 11) == {1, 3, 4}
    assert x.cheapest(1, [2], 11, weights=False) == {1, 5}
    assert x.shortest(1, [2], 11) == {1, 5}


def test_tree_takes_the_cheaper_ways():
    # two targets behind one dear hub, and each behind a cheaper way of its own
    edges = [(1, 6), (6, 2), (6, 3), (6, 7), (1, 4), (4, 2), (1, 5), (5, 3)]
    x = prefix(7, edges)
    assert x.tree(1, [2, 3], 7) == {1, 4, 5}
    assert x.tree(1, [1], 7) == {1} and x.tree(1, [], 7) == set()
    assert effort_of(x, 3, 2, 1, 7, path="tree") >= 3


def test_flow_shares_an_edge_that_paths_would_pay_twice():
    # 1 -> 4 -> {2, 3}: both flows meet in 4 and share the way to it; 5 and 6 offer single ways that cost more
    x = prefix(9, [(1, 4), (4, 2), (4, 3), (1, 5), (5, 2), (5, 7), (5, 8), (5, 9), (1, 6), (6, 3), (6, 7), (6, 8), (6, 9)])
    assert x.flow_tree(1, [2, 3], 9) == {1, 4}
    assert x.flow_tree(1, [1], 9) == {1} and x.flow_tree(1, [], 9) == set()


def reaches(x, nodes, s, m):
    seen, todo = {s}, [s]
    while todo:
        u = todo.pop()
        if u in nodes:
            for v in x.next[u - 1]:
                if v <= m and v not in seen:
                    seen.add(v)
                    todo.append(v)
    return seen


def test_effort_counts_paths_neighbours_and_targets():
    x = prefix(5, [(1, 2), (2, 1), (2, 3), (3, 4), (1, 5)])
    # sources 1 and 2 reach both; paths are {1} and {2}; their neighbours are 2, 5 and 1, 3
    assert effort_of(x, 2, 2, 2, 3) == 4
    assert effort_of(x, 2, 2, 2, 3, expand=False) == 2
    assert effort_of(x, 2, 2, 2, 3, agg="max") == 3
    assert unbounded_effort_of(x, 2, 2, 2) == 4


def test_least_list_length():
    x = prefix(3, [(1, 3), (1, 2), (2, 3), (2, 1), (3, 2), (3, 1)])
    assert k0_of(x, 2, 2, 1, 0.0) == 2
    assert k0_of(x, 2, 2, 1, 0.5) == 1  # from 1 over 3 to 2, by first edges only
    assert k0_of(x, 2, 2, 2, 0.5) == 2


def test_cadence():
    assert [cadence_of(d) for d in (999, 1000, 1001, 1002, 1101, 1102)] == [999, 1000, 1001, 1101, 1101, 1201]


def test_count_targets():
    assert [count_target(a, k) for a, k in ((0.98, 50), (0.9, 10), (0.86, 50), (0.94, 100))] == [49, 9, 43, 94]


graphs = st.integers(4, 10).flatmap(lambda n: st.tuples(st.just(n), st.lists(st.tuples(st.integers(1, n), st.integers(1, n)), max_size=40, unique=True)))


@settings(max_examples=150, deadline=None)
@given(graphs, st.integers(1, 4), st.integers(1, 4))
def test_bottlenecks_equal_growing_prefixes(g, r, p):
    x = prefix(*g)
    assert delta0_of(x, 4, r, p) == by_growing(x, 4, r, p)


@settings(max_examples=80, deadline=None)
@given(graphs, st.integers(1, 3), st.integers(1, 3))
def test_harder_targets_need_no_less(g, r, p):
    x = prefix(*g)
    far = 10**9
    d = lambda a, b: delta0_of(x, 4, a, b) or far
    assert d(r, p) <= d(r + 1, p) and d(r, p) <= d(r, p + 1)
    if d(r, p) < far:
        targets = {t for _, ts in x.sources(4, r, p, d(r, p)) for t in ts}
        assert effort_of(x, 4, r, p, d(r, p)) >= len(targets)


@settings(max_examples=120, deadline=None)
@given(graphs)
def test_covers_reach_every_target(g):
    x = prefix(*g)
    for s in range(1, 4):
        targets = [t for t in x.reach(s, 4, g[0])]
        for cover in (x.cheapest, x.tree, x.flow_tree):
            assert set(targets) <= reaches(x, cover(s, targets, g[0]), s, g[0]), cover


@settings(max_examples=300, deadline=None)
@given(st.integers(4, 24).flatmap(lambda n: st.tuples(st.just(n), st.lists(st.tuples(st.integers(1, n), st.integers(1, n + 1)), max_size=90, unique=True))), st.integers(0, 3))
def test_whole_graph_gives_the_effort_of_all_ranks(g, places):
    n, edges = g
    # few places make ties of distance; one id in the edges is not in the base
    x = np.random.default_rng(n).integers(0, places + 2, (n, 2)).astype(float)
    ids = np.arange(1, n + 1) * 3
    edges = sorted((3 * a, pos, 3 * b) for pos, (a, b) in enumerate(edges))
    whole = Whole(ids, x, np.array([e[0] for e in edges], np.int64), np.array([e[2] for e in edges], np.int64))
    q = np.zeros(2)
    ranked = ids[np.lexsort((ids, ((x - q) ** 2).sum(axis=1)))].tolist()
    want = Prefix(ranked, [[b for a, _, b in edges if a == i] for i in ranked], n)
    for k, p in ((4, 4), (3, 2), (1, 1)):
        assert whole.effort(q, ranked[:k], p) == unbounded_effort_of(want, k, 1, p)


def test_unbounded_effort_reads_no_more_than_the_nearest(spark):
    x = np.random.default_rng(5).normal(size=(120, 4))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    base, query = spark.createDataFrame(rows[10:], "vec_id long, v array<double>"), spark.createDataFrame(rows[:10], "q_id long, v array<double>")
    edges = build_graph(base, "mrng", 8)
    asked = []

    class Lists(effort.Lists):
        def first(self, n, only=None):
            asked.append(n)
            return super().first(n, only)

    got = {r.q_id: r.me for r in effort.effort_unbounded(Lists(base, query), edges, 4, 3, 3).collect()}
    assert asked == [4]
    want = effort.effort_unbounded(effort.Lists(base, query).first(None).select("q_id", "rank", "id"), edges, 4, 3, 3)
    assert got == {r.q_id: r.me for r in want.collect()} and len(got) == 10


def tree_of_all_ways(x, s, targets, m):
    """The greedy tree by a search from every hub."""
    left, nodes = set(targets) - {s}, set()
    from_s, to_hub = x.distances(s, m)
    ways = {h: x.distances(h, m) for h in from_s}
    while left:
        bunches = []
        for h in sorted(from_s):
            near = sorted((d, t) for t in left if (d := ways[h][0].get(t)) is not None)
            for n in range(1, len(near) + 1):
                bunches.append(((from_s[h] + sum(d for d, _ in near[:n])) / n, h, n, [t for _, t in near[:n]]))
        if not bunches:
            break
        _, h, _, got = min(bunches)
        nodes |= x._chains([h], to_hub) | x._chains(got, ways[h][1]) | ({h} if h != s else set())
        left -= set(got)
    return nodes | ({s} if targets else set())


@settings(max_examples=300, deadline=None)
@given(graphs, st.integers(4, 10))
def test_tree_equals_a_search_from_every_hub(g, m):
    x, m = prefix(*g), min(g[0], m)
    for s in range(1, 5):
        for targets in (x.reach(s, 4, m), [1, 2, 3, 4]):
            assert x.tree(s, targets, m) == tree_of_all_ways(x, s, targets, m)


def test_tree_searches_do_not_grow_with_the_hubs():
    n = 400
    rng = np.random.default_rng(2)
    x = prefix(n, [(u, int(v)) for u in range(1, n + 1) for v in rng.choice(n, 8, replace=False) + 1 if v != u])
    searches, run = [], x.distances
    x.distances = lambda s, m: searches.append(s) or run(s, m)
    effort_of(x, 10, 9, 9, n, path="tree")
    assert len(searches) <= 9 + 9 * 10
