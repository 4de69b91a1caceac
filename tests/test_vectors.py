"""Neighbours, graphs and search on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecscope.operators import graphs, knn, measures, search, stats, workload
from vecscope.sources import formats


def vectors(spark, x, key="vec_id"):
    return spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], f"{key} long, v array<double>")


@pytest.fixture(scope="module")
def cloud():
    return np.random.default_rng(1).normal(size=(120, 6))


def test_ties_go_to_the_lesser_id(spark):
    square = [(0, 0), (0, 1), (1, 0), (1, 1), (0.5, 0.5), (0.5, 0.5)]
    got = knn.exact_knn(vectors(spark, square), vectors(spark, [(0.5, 0.5)], "q_id"), 4)
    assert [(r["rank"], r["id"]) for r in got.orderBy("rank").collect()] == [(1, 4), (2, 5), (3, 0), (4, 1)]


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_engines_agree(spark, cloud, metric):
    b, q = vectors(spark, cloud[20:]), vectors(spark, cloud[:20], "q_id")
    keep = lambda d: {(r["q_id"], r["rank"], r["id"]) for r in d.collect()}
    assert keep(knn.exact_knn(b, q, 7, metric)) == keep(knn.exact_knn(b, q, 7, metric, engine="sql"))


def test_more_neighbours_than_vectors_and_none(spark, cloud):
    b, q = vectors(spark, cloud[:5]), vectors(spark, cloud[:2], "q_id")
    assert knn.exact_knn(b, q, 50).count() == 10
    assert knn.exact_knn(b.limit(0), q, 3).count() == 0
    assert knn.exact_knn(b, q.limit(0), 3).count() == 0


def test_blocks_meet_without_broadcast(spark, cloud, monkeypatch):
    b, q = vectors(spark, cloud), vectors(spark, cloud, "q_id")
    want = {tuple(r) for r in knn.exact_knn(b, q, 5).select("q_id", "rank", "id").collect()}
    monkeypatch.setattr(knn, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(knn, "BLOCK", 16)
    assert {tuple(r) for r in knn.exact_knn(b, q, 5).select("q_id", "rank", "id").collect()} == want


def test_pruned_edges_are_candidates_and_free_of_occlusion(spark, cloud):
    b = vectors(spark, cloud)
    cand = {(r["src"], r["dst"]) for r in knn.knn_graph(b, 20).collect()}
    rows = graphs.build_graph(b, "mrng", 20).orderBy("src", "pos").collect()
    assert {(r["src"], r["dst"]) for r in rows} <= cand
    d = lambda i, j: ((cloud[i] - cloud[j]) ** 2).sum()
    for s in range(len(cloud)):
        kept = [r["dst"] for r in rows if r["src"] == s]
        assert all(d(u, v) >= d(s, v) for i, v in enumerate(kept) for u in kept[:i])


def test_reversing_twice_is_the_same_graph(spark, cloud):
    e = graphs.build_graph(vectors(spark, cloud), "ssg", 15)
    pairs = lambda d: {(r["src"], r["dst"]) for r in d.collect()}
    assert pairs(graphs.reverse(graphs.reverse(e))) == pairs(e)


def test_shuffle_is_a_permutation(spark, cloud):
    m = graphs.shuffle_ids(vectors(spark, cloud)).collect()
    assert sorted(r["new"] for r in m) == list(range(120)) and any(r["new"] != r["old"] for r in m)


def test_padded_rows_round_trip(spark, cloud):
    b = vectors(spark, cloud)
    e = graphs.build_graph(b, "mrng", 12)
    pairs = lambda d: {(r["src"], r["pos"], r["dst"]) for r in d.collect()}
    assert pairs(graphs.from_padded(graphs.padded(e, b, 30))) == pairs(e)


def test_wide_beam_is_exact_and_budget_holds(spark, cloud):
    b, q = vectors(spark, cloud), vectors(spark, cloud[:10] + 0.01, "q_id")
    gt = knn.exact_knn(b, q, 10)
    e = graphs.nsw_graph(b, 8, 40)
    full = search.beam_search(q, e, b, 10, 200)
    assert all(r["hits"] == 10 for r in search.recall(full, gt, 10).collect())
    assert all(r["ndc"] <= 31 for r in search.beam_search(q, e, b, 10, 200, budget=30).collect())
    gone = b.where("vec_id % 2 = 0")
    assert all(r["id"] % 2 for r in search.beam_search(q, e, b, 10, 200, deleted=gone).collect())


def test_search_in_shards(spark, cloud, monkeypatch):
    b, q = vectors(spark, cloud), vectors(spark, cloud[:10] + 0.01, "q_id")
    gt = knn.exact_knn(b, q, 5)
    complete = b.select(F.col("vec_id").alias("src")).crossJoin(b.select(F.col("vec_id").alias("dst"))).where("src <> dst").withColumn("pos", F.col("dst"))
    monkeypatch.setattr(search, "BROADCAST_BYTES", 100_000)
    assert search.shards_needed(complete, b) > 1
    got = search.beam_search(q, complete, b, 5, 10)
    assert {(r["q_id"], r["rank"], r["id"]) for r in got.collect()} == {(r["q_id"], r["rank"], r["id"]) for r in gt.collect()}


def test_large_sparse_graph_is_searched_whole(spark, cloud, monkeypatch):
    b, q = vectors(spark, cloud), vectors(spark, cloud[:10] + 0.01, "q_id")
    gt = knn.exact_knn(b, q, 5)
    e = graphs.build_graph(b, "mrng", 12)
    e = spark.createDataFrame([*e.select("src", "pos", "dst").collect(), (3, 99, 1000)], "src long, pos int, dst long")
    gone = b.where("vec_id % 3 = 0")

    def found():
        frames = [
            search.beam_search(q, e, b, 5, 10), search.beam_search(q, e, b, 5, 2, entry=7), search.beam_search(q, e, b, 5, 20, budget=30), search.beam_search(q, e, b, 5, 10, deleted=gone),
            search.recall_at_budget(q, e, b, gt, 5, (20, 60)), search.ef_sweep(q, e, b, gt, 5, (5, 10)), search.least_ndc(q, e, b, gt, 5, (0.6, 1.0)), search.search_trace(q, e, b, 5, 8),
        ]
        return [sorted(tuple(r) for r in f.collect()) for f in frames]

    want = found()
    monkeypatch.setattr(search, "BROADCAST_BYTES", 1000)
    monkeypatch.setattr(search, "AHEAD", 2)
    assert search.shards_needed(e, b) > 1 and all(want) and found() == want


def test_least_effort_reaches_its_target(spark, cloud):
    b, q = vectors(spark, cloud), vectors(spark, cloud[:10] + 0.01, "q_id")
    gt, e = knn.exact_knn(b, q, 10), graphs.nsw_graph(b, 6, 40)
    least = {(r["q_id"], r["target"]): (r["ef"], r["ndc"]) for r in search.least_ndc(q, e, b, gt, 10, (0.5, 1.0)).collect()}
    assert all(least[i, 0.5] <= least[i, 1.0] for i in range(10))
    h = search.recall(search.hnsw_search(q, b, 10, 100), gt, 10).agg(F.avg("hits")).first()[0]
    assert h > 9


def test_moved_vectors_are_found_again(cloud):
    x = cloud.copy()
    h = search.Hierarchy(x, 6, 40)
    for i in range(len(x)):
        h.insert(i)
    h.update(5, cloud[80] + 0.001)
    assert 5 in [i for _, i in h.search(cloud[80], 3, 40).found]
    assert all(len(ns) <= 12 and i not in ns for i, ns in h.layers[0].items())


def test_workload_bins_keep_their_quota(spark):
    h = spark.createDataFrame([(i, (i * 37) % 101) for i in range(200)], "q_id long, me long")
    got = workload.stratified(h, "me", 20, 5, 3, 3)
    assert all(r["count"] <= 4 for r in got.groupBy("bin").count().collect())
    flat = spark.createDataFrame([(i, 5) for i in range(9)], "q_id long, me long")
    assert {r["bin"] for r in workload.with_bins(flat, "me", 5).collect()} == {1}
    assert workload.stratified(flat, "me", 20, 5, 5, 800).count() == 0


def test_mixture_samples_repeat_and_survive_saving(spark, cloud, tmp_path):
    m = workload.fit_mixture(vectors(spark, cloud), 2, rounds=3)
    m.save(spark, str(tmp_path / "m"))
    again = workload.Mixture.load(spark, str(tmp_path / "m"))
    a, b = (workload.sample_mixture(spark, x, 50).orderBy("q_id").collect() for x in (m, again))
    assert a == b and len(a) == 50
    assert abs(sum(x * x for x in a[0]["v"]) - 1) < 1e-9


def test_zero_distances_in_measures(spark):
    gt = spark.createDataFrame([(1, r, r, d) for r, d in enumerate([0.0, 0.0, 1.0, 2.0, 4.0, 8.0, 9.0], 1)], "q_id long, rank int, id long, dist double")
    assert measures.lid_mle(gt, 3).first()["lid"] > 0
    assert measures.lid_stable(gt, 4).first()["lid"] is not None
    assert measures.lid_exp(gt, 3).first()["value"] == 1.0
    assert measures.epsilon_hardness(gt, 2, 0.0).first()["value"] == 3


def test_contrast_takes_the_whole_base(spark, cloud, sf, monkeypatch):
    from vecscope.plans import queries

    b, q = vectors(spark, cloud[20:]), vectors(spark, cloud[:20], "q_id")
    for rooted in (False, True):
        want = {r["q_id"]: r["value"] for r in measures.relative_contrast(knn.exact_knn(b, q, 100), 5, rooted).collect()}
        monkeypatch.setattr(knn, "BLOCK", 16)
        got = {r["q_id"]: r["value"] for r in measures.relative_contrast(knn.exact_knn(b, q, 6), 5, rooted, knn.mean_distance(b, q, rooted)).collect()}
        assert len(got) == 20 and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    asked, gt = [], queries._gt
    monkeypatch.setattr(queries, "_gt", lambda s, d, k: asked.append(k) or gt(s, d, min(k, 11)))
    assert queries.QUERIES["relative_contrast"](spark, sf).count() and max(asked) == 11


def test_pagerank_sums_to_one_and_breadth_first(spark):
    e = spark.createDataFrame([(0, 0, 1), (1, 0, 2), (2, 0, 0), (2, 1, 3)], "src long, pos int, dst long")
    n = spark.createDataFrame([(i,) for i in range(5)], "vec_id long")
    assert abs(sum(r["rank"] for r in stats.pagerank(e, n).collect()) - 1) < 1e-9
    assert {r["node"]: r["hops"] for r in stats.bfs_distances(e, 0).collect()} == {0: 0, 1: 1, 2: 2, 3: 3}


def test_breadth_first_follows_long_chains(spark):
    e = spark.createDataFrame([(i, 0, i + 1) for i in range(67)], "src long, pos int, dst long")
    assert {r["node"]: r["hops"] for r in stats.bfs_distances(e, 0).collect()} == {i: i for i in range(68)}
    assert stats.bfs_distances(e, 0, limit=3).count() == 4


@pytest.mark.parametrize("kind", ["fvecs", "fbin"])
def test_vector_files(spark, cloud, tmp_path, kind):
    b = vectors(spark, cloud.astype(np.float32))
    formats.write(b, str(tmp_path / kind), kind, 3)
    back = formats.read(spark, str(tmp_path / kind), kind).orderBy("vec_id").collect()
    assert [r["v"] for r in back] == cloud.astype(np.float32).tolist()
    few = formats.read(spark, str(tmp_path / kind), kind, rows=7, dims=2).collect()
    assert len(few) == 7 and all(len(r["v"]) == 2 for r in few)


@pytest.mark.parametrize("kind", ["adj", "adj64", "ended"])
def test_graph_files(spark, cloud, tmp_path, kind):
    e = graphs.build_graph(vectors(spark, cloud), "mrng", 10)
    formats.write(graphs.adjacency(e), str(tmp_path / kind), kind)
    pairs = lambda d: {(r["src"], r["pos"], r["dst"]) for r in d.collect()}
    assert pairs(formats.read(spark, str(tmp_path / kind), kind)) == pairs(e)


def test_layered_and_weighted_files(spark, tmp_path):
    import struct

    node = lambda links, label: struct.pack("<I2I2fQ", len(links), *[*links, 0, 0][:2], 0.5, 1.5, label)
    head = struct.pack("<6QiI3QdQ", 0, 2, 2, 28, 20, 12, 1, 0, 2, 2, 2, 0.5, 10)
    upper = struct.pack("<I3I", 12, 1, 1, 0) + struct.pack("<I", 0)
    (tmp_path / "h").write_bytes(head + node([1], 10) + node([0], 20) + upper)
    rows = {tuple(r) for r in formats.read(spark, str(tmp_path / "h"), "layered").collect()}
    assert rows == {(0, 10, 0, 20), (0, 20, 0, 10), (1, 10, 0, 20)}
    body = b"".join(struct.pack("<2fIfI", 0, 0, n, w, label) for n, w, label in ((1, 0.5, 7), (0, 0.25, 9)))
    (tmp_path / "d").write_bytes(struct.pack("<BHIB", 1, 2, 2, 1) + body)
    assert {tuple(r) for r in formats.read(spark, str(tmp_path / "d"), "weighted").collect()} == {(7, 0, 9, 0.5), (9, 0, 7, 0.25)}


def test_streamed_queries(spark, cloud, tmp_path):
    from vecscope.streaming import score_stream

    b, q = vectors(spark, cloud), vectors(spark, cloud[:8], "q_id")
    q.write.parquet(str(tmp_path / "q"))
    seen = []
    stream = spark.readStream.schema(q.schema).parquet(str(tmp_path / "q"))
    score_stream(stream, b, 3, lambda df, n: seen.extend(df.collect()), str(tmp_path / "c")).awaitTermination()
    assert {tuple(r)[:3] for r in seen} == {tuple(r)[:3] for r in knn.exact_knn(b, q, 3).collect()}


def test_workflows_end_to_end(spark, cloud):
    from vecscope.plans import pipeline

    s = pipeline.Settings(k=5, recall=0.8, prob=0.8, k_cand=20, gt_depth=60, components=2, n_queries=40, size=20, bins=4, trim_low=1, trim_high=1)
    b = vectors(spark, cloud)
    edges, model = pipeline.preprocess(b, s)
    got = pipeline.benchmark(spark, b, edges, model, s)
    assert 0 < got.count() <= 20 and set(got.columns) == {"q_id", "me", "bin", "v"}


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_expressions_take_any_number_of_pairs(spark, cloud, monkeypatch, metric):
    b, q = vectors(spark, cloud[20:]), vectors(spark, cloud[:20], "q_id")
    monkeypatch.setattr(knn, "EXPRESSION_PAIRS", 10)
    rows = lambda df: sorted((r.q_id, r.rank, r.id) for r in df.collect())
    want = rows(knn.exact_knn(b, q, 7, metric))
    assert rows(knn.exact_knn(b, q, 7, metric, engine="sql_bounded")) == want
    monkeypatch.setattr(knn, "UNROLLED", 0)
    assert rows(knn.exact_knn(b, q, 7, metric, engine="sql_bounded")) == want
    assert rows(knn.exact_knn(b.where("vec_id < 3"), q, 7, metric, engine="sql_bounded")) == rows(knn.exact_knn(b.where("vec_id < 3"), q, 7, metric))


def test_expression_query_is_not_refused(spark, sf, monkeypatch):
    from vecscope.plans import queries

    monkeypatch.setattr(knn, "EXPRESSION_PAIRS", 10)
    assert queries.exact_knn_expressions(spark, sf).count() == 500
