"""File formats: what is written is read back, drafts don't count, and names say kinds."""

import pytest
from pyspark.sql import functions as F

from vecscope.operators import graphs
from vecscope.sources import formats


def vectors(spark, n=40, d=5):
    return spark.range(n).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(d)), lambda k: (F.col("id") * k).cast("float")).alias("v"))


@pytest.mark.parametrize("kind", ["fvecs", "fbin", "ivecs", "ibin", "i8bin"])
def test_vectors(spark, tmp_path, kind):
    df = vectors(spark, 25)
    for parts in (1, 3):
        formats.write(df, str(tmp_path / f"x{parts}.{kind}"), parts=parts)
        got = formats.read(spark, str(tmp_path / f"x{parts}.{kind}")).collect()
        assert [(r["vec_id"], [float(x) for x in r["v"]]) for r in sorted(got)] == [(i, [float(i * k) for k in range(1, 6)]) for i in range(25)]
    assert formats.read(spark, str(tmp_path / f"x3.{kind}"), rows=7, dims=2).count() == 7


def lists():
    return {0: [1, 2], 1: [], 2: [0, 1, 3], 3: [2]}


@pytest.mark.parametrize("kind", ["adj", "adj64", "ended", "adj_entry"])
def test_ragged_graphs(spark, tmp_path, kind):
    df = spark.createDataFrame(list(lists().items()), "src long, ids array<long>")
    formats.write(df, str(tmp_path / "g"), kind)
    got = formats.read(spark, str(tmp_path / "g"), kind).collect()
    assert sorted(tuple(r) for r in got) == sorted((s, p, x) for s, ids in lists().items() for p, x in enumerate(ids))


def test_layered_and_weighted_graphs(spark, tmp_path):
    levels = {10: [[11, 12], [12]], 11: [[10]], 12: [[10, 11, 13], [10], []], 13: [[12]]}
    rows = [(s, [float(s), 0.5], ls) for s, ls in levels.items()]
    formats.write(spark.createDataFrame(rows, "src long, v array<float>, levels array<array<long>>"), str(tmp_path / "a.hnsw"), entry=12)
    got = formats.read(spark, str(tmp_path / "a.hnsw")).collect()
    assert sorted(tuple(r) for r in got) == sorted((lv, s, p, x) for s, ls in levels.items() for lv, ids in enumerate(ls) for p, x in enumerate(ids))
    near = [(s, [1.0, 2.0, 3.0], [(s + 1) % 5, (s + 2) % 5], [0.25, s / 2]) for s in range(5)]
    formats.write(spark.createDataFrame(near, "src long, v array<float>, ids array<long>, weights array<float>"), str(tmp_path / "a.deg"))
    got = formats.read(spark, str(tmp_path / "a.deg")).collect()
    assert sorted(tuple(r) for r in got) == sorted((s, p, x, w) for s, _, ids, ws in near for p, (x, w) in enumerate(zip(ids, ws, strict=True)))


def test_scalars_knn_graphs_padding_and_codebooks(spark, tmp_path):
    import struct

    df = spark.range(30).select("id", (F.col("id") * 3).cast("int").alias("value"))
    formats.write(df, str(tmp_path / "v"), "raw_i", 2)
    assert [r["value"] for r in sorted(formats.read(spark, str(tmp_path / "v"), "raw_i").collect())] == [3 * i for i in range(30)]
    formats.write(vectors(spark, 6, 4).select("vec_id", F.transform("v", lambda x: (x % 6).cast("int")).alias("v")), str(tmp_path / "k"), "ivecs")
    assert formats.read(spark, str(tmp_path / "k"), "knng", degree=2).count() == 12
    padded = spark.createDataFrame([(0, [1, -1]), (1, [-1, -1]), (2, [0, 1])], "src long, ids array<int>")
    formats.write(padded, str(tmp_path / "p"), "ibin")
    assert sorted(tuple(r) for r in formats.read(spark, str(tmp_path / "p"), "padded").collect()) == [(0, 0, 1), (2, 0, 0), (2, 1, 1)]
    (tmp_path / "c.fdat").write_bytes(struct.pack("<3i", 2, 3, 4) + struct.pack("<24f", *range(24)))
    got = sorted(formats.read(spark, f"{tmp_path}/c.fdat").collect())
    assert len(got) == 6 and got[5]["v"] == [20.0, 21.0, 22.0, 23.0]


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    path = str(tmp_path / "x")
    formats.write(vectors(spark, 10), path, "fvecs")
    with pytest.raises(Exception):  # noqa: B017
        formats.write(vectors(spark, 10).select("vec_id", F.when(F.col("vec_id") < 9, F.col("v")).otherwise(F.array(F.lit(1.0).cast("float"))).alias("v")), path, "fvecs")
    assert formats.read(spark, path, "fvecs").count() == 10


def test_names():
    assert formats.kind_of("a/deep_base.fvecs") == "fvecs" and formats.kind_of("x_K32.mrng") == "adj" and formats.kind_of("g_hnsw.ibin_plain") == "padded"
    with pytest.raises(ValueError):
        formats.kind_of("x.parquet")


def test_logs_csv_relabelling_and_reversed_attributes(spark, tmp_path):
    (tmp_path / "log").write_text("note\n" + ", ".join(str(100 + i) for i in range(12)) + ",\n")
    assert [(r["q_id"], r["ndc"]) for r in sorted(formats.read_effort_log(spark, str(tmp_path / "log")).select("q_id", "ndc").collect())] == [(i, 100.0 + i) for i in range(12)]
    edges = spark.createDataFrame([(0, 0, 1, 0.5), (0, 1, 2, 0.7), (2, 0, 1, 0.1)], "src long, pos int, dst long, w double")
    formats.write_edge_csv(edges.select("src", "dst", "w"), str(tmp_path / "csv"))
    assert sorted(spark.read.option("header", True).csv(str(tmp_path / "csv")).collect())[0].asDict() == {"source": "0", "target": "1", "weight": "0.5"}
    back = sorted(tuple(r) for r in graphs.reverse_attribute(edges, "w").collect())
    assert back == [(1, 0, 0, 0.5), (1, 1, 2, 0.1), (2, 0, 0, 0.7)]
    mapping = spark.createDataFrame([(0, 7), (1, 8), (2, 9)], "old long, new long")
    assert sorted(tuple(r) for r in graphs.relabel(edges.select("src", "pos", "dst"), mapping).collect()) == [(7, 0, 8), (7, 1, 9), (9, 0, 8)]
