import random
from collections import defaultdict

import numpy as np
import pytest

from vecscope.llm import near_dedup as nd
from vecscope.llm.common import Scratch
from vecscope.llm.components import components
from vecscope.llm.setsketch import SetSketch
from vecscope.llm.shingles import Shingler


def sets(text, k=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, min(1, len(w)))))


def brute(rows, percent):
    """(id, n, component) by holding every pair of texts against each other."""
    s = [(i, sets(t)) for i, t in rows]
    up = {i: i for i, _ in s}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, (i, x) in enumerate(s):
        for j, y in s[:a]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(i), root(j)))
                up[q] = p
    return sorted((i, len(x), root(i)) for i, x in s)


def edited(text, share, r):
    w = text.split()
    for _ in range(int(len(w) * share)):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus(words):
    r = random.Random(4)
    texts = [None, "", "  ", "a b", "A b", "a b c", words(2000, 9)]
    for g in range(6):
        own = words(150 + 40 * g, 20 + g)
        texts += [own] + [edited(own, 0.002 * k, r) for k in range(1, 14)]
    hot = words(120, 77)
    texts += [hot] * 30 + [edited(hot, 0.02, r) for _ in range(60)] + [hot.upper()]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_components_equal_brute_force(docs, corpus, percent):
    got = nd.components_of(docs(corpus), percent).collect()
    assert sorted(tuple(r)[:3] for r in got) == brute(corpus, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_small_blocks_and_one_leader_lose_nothing(docs, corpus, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 7)
    monkeypatch.setattr(nd, "LEADERS", 1)
    got = nd.components_of(docs(corpus), 85).collect()
    assert sorted(tuple(r)[:3] for r in got) == brute(corpus, 85)


def test_one_of_each_group_stays(docs, corpus):
    d = docs([*corpus, corpus[0], corpus[0], (None, "lonely words stand here today"), (None, dict(corpus)[10])])
    out = nd.keep_one(d, 80)
    assert out.columns == d.columns
    rows = out.collect()
    kept = [i for i, _, c in brute(corpus, 80) if i == c]
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == kept
    assert "lonely words stand here today" in [r["text"] for r in rows]
    source = {tuple(r) for r in d.collect()}
    assert all(tuple(r) in source for r in rows)


def test_empty_and_single(docs):
    assert nd.components_of(docs([])).count() == 0 and nd.keep_one(docs([])).count() == 0
    assert [tuple(r) for r in nd.components_of(docs([(5, "one two three four five six")])).collect()] == [(5, 2, 5, True)]


def test_bands_miss_almost_nothing():
    for percent in (50, 80, 85, 95):
        b = nd.bands_for(percent)
        assert (1 - (percent / 100) ** nd.ROWS) ** b <= nd.MISS


def test_registers_merge_estimate_and_agree():
    r = np.random.default_rng(2)
    sk = SetSketch(400)
    x = r.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = x[:2000], x[500:2500]
    ra, rb = sk.registers(a), sk.registers(b)
    assert (sk.merge(ra, rb) == sk.registers(np.union1d(a, b))).all()
    est = sk.similarity(ra[None], rb[None], np.array([2000.0]), np.array([2000.0]))[0]
    assert abs(est - 1500 / 2500) < 0.1
    assert abs((ra == rb).mean() - 0.6) < 0.1


def test_shingles():
    s = Shingler()
    assert len(s.distinct("a b c d e f")) == 2 and len(s.distinct("a b c")) == 1 and len(s.distinct(" ")) == 0
    assert (s.distinct("A b  C d\te f") == s.distinct("a B c D e F")).all()
    assert len(np.intersect1d(s.distinct("a b c d"), s.distinct("a b c d e"))) == 0


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (None, 3), (200, 201), (201, 200), (200, 201)]
    e = spark.createDataFrame(edges, "a long, b long")
    got = defaultdict(set)
    for r in components(e, Scratch(spark, "t")).collect():
        got[r["component"]].add(r["node"])
    assert got == {1: set(range(1, 41)), 100: set(range(100, 130)), 200: {200, 201}}
    assert components(e.limit(0), Scratch(spark, "t")).count() == 0


def joined_by_id(rows, percent):
    """(id, n, component) where rows of one id are one document: by links and shared ids, over all pairs of rows."""
    s = [sets(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same = rows[a][0] is not None and rows[a][0] == rows[b][0]
            if same or (s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b])):
                up[root(a)] = root(b)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[root(x)] = min(i, least.get(root(x), i))
    return sorted(((i, len(s[x]), least.get(root(x))) for x, (i, _) in enumerate(rows)), key=repr)


def test_texts_that_share_an_id(docs, words):
    a, b, c = words(30, 1), words(30, 2), words(30, 3)
    rows = [(2, a), (5, a), (5, b), (6, b), (7, c)]
    got = nd.components_of(docs(rows)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(2, 2), (5, 2), (5, 2), (6, 2), (7, 7)]
    kept = sorted((r["doc_id"], r["text"]) for r in nd.keep_one(docs(rows)).collect())
    assert kept == [(2, a), (5, b), (7, c)]


def test_shared_null_and_empty_ids_equal_brute_force(docs, corpus):
    r = random.Random(8)
    rows = [(i % 40 if r.random() < 0.3 else None if r.random() < 0.1 else i, t) for i, t in corpus] + [(3, None), (3, ""), (900, None), (900, corpus[9][1])]
    got = nd.components_of(docs(rows), 85).collect()
    assert sorted((tuple(x)[:3] for x in got), key=repr) == joined_by_id(rows, 85)
    assert all(x["kept"] == (x["component_id"] is None or x["doc_id"] == x["component_id"]) for x in got)
    kept = [(x["doc_id"], x["text"]) for x in nd.keep_one(docs(rows), 85).collect()]
    # every text has a linked one that stays, and no two that stay are linked
    s = {t: sets(t) for _, t in rows}
    near = lambda x, y: bool(s[x]) and 100 * len(s[x] & s[y]) >= 85 * len(s[x] | s[y])
    groups = brute(list(enumerate(t for _, t in rows)), 85)
    stays = {t for _, t in kept}
    of = {x: c for x, _, c in groups}
    by_group = defaultdict(set)
    for x, (i, t) in enumerate(rows):
        if s[t] and (i, t) in kept:
            by_group[of[x]].add((i, t))
    assert {of[x] for x, (_, t) in enumerate(rows) if s[t]} == set(by_group) and all(len(v) == 1 for v in by_group.values())
    assert None in stays and len(kept) == len(set(kept)) and not any(near(x, y) for x in stays for y in stays if x is not y and x != y)


def test_hot_buckets_and_hubs_give_the_same(docs, corpus, monkeypatch):
    from vecscope.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(common, "HOT_KEYS", 10**9)
    monkeypatch.setattr(nd, "PAIRS", 4)
    assert sorted(tuple(r)[:3] for r in nd.components_of(docs(corpus), 85).collect()) == brute(corpus, 85)
