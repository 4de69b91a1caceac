import random
import zlib

import numpy as np

from vecscope.llm import quality_fm as q


def corpus(words):
    r = random.Random(6)
    good = [(i, words(r.randint(40, 90), i)) for i in range(60)]
    bad = [(100 + i, " ".join(w + r.choice(("###", "$$$", "%%%")) for w in words(r.randint(40, 90), i).split())) for i in range(60)]
    return good + bad


def labels(spark, rows):
    return spark.createDataFrame([(i, int(i < 100), 0, "x") for i, _ in rows] + [(None, 1, 0, "x"), (5, None, 0, "x"), (5, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")


def test_sum_of_squares_equals_all_pairs():
    r = np.random.default_rng(1)
    m = q.Machine(0.3, r.normal(size=50), r.normal(size=(50, 4)))
    idx, x = np.array([3, 9, 20, 41]), r.normal(size=4)
    pairs = sum(m.v[idx[a]] @ m.v[idx[b]] * x[a] * x[b] for a in range(4) for b in range(a + 1, 4))
    assert abs(m.raw(idx, x) - (0.3 + m.w[idx] @ x + pairs)) < 1e-9


def test_learns_and_respects_the_fold(spark, docs, words):
    rows = corpus(words)
    d = docs([*rows, (900, None), (901, ""), (902, words(30_000, 3)), (0, rows[0][1]), (None, "no id here")])
    m = q.train(d, labels(spark, rows))
    got = q.score(d, m).collect()
    assert len(got) == len(rows) + 5 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _ in rows)
    held = [i for i, _ in rows if by[i]["held_out"]]
    assert held and np.mean([by[i]["predicted"] == (i < 100) for i in held]) > 0.95


def test_held_out_labels_change_nothing(spark, docs, words):
    rows = corpus(words)
    flipped = labels(spark, rows).selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality")
    a, b = (q.train(docs(rows), x) for x in (labels(spark, rows), flipped))
    assert a.bias == b.bias and (a.w == b.w).all() and (a.v == b.v).all()


def test_language_source_and_id_are_not_inputs(spark, docs, words):
    rows = corpus(words)
    m = q.train(docs(rows), labels(spark, rows))
    same = docs([(i + 7000, t) for i, t in rows]).selectExpr("doc_id", "text", "n_chars", "'de' AS lang", "'other' AS source")
    key = lambda d: sorted(r["score"] for r in q.score(d, m).collect())
    assert key(docs(rows)) == key(same)


def test_no_labels_or_documents(spark, docs, words):
    rows = corpus(words)
    none = labels(spark, rows).limit(0)
    assert {r["score"] for r in q.score(docs(rows), q.train(docs(rows), none)).collect()} == {0.5}
    assert q.score(docs([]), q.Machine.blank()).count() == 0


def test_held_out_accuracy(spark, sf):
    from vecscope.llm.queries import queries

    j = queries()["op9_quality_fm"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (j.predicted == j.quality).mean() > 0.95 and (j[j.quality == 1].predicted == 1).all()


def test_share_of_capitals_reads_the_whole_text():
    f = q.Featurizer()
    for size in (100, 4096, 5000, 8191, 8192, 8193, 50_000):
        for text in ("A" * size, "aB" * (size // 2), "a" * (size - 1) + "A", "A" + "é" * size):
            raw = text.encode()
            assert f(text, None)[1][5] == sum(65 <= c <= 90 for c in raw) / len(raw)


def test_sample_is_bounded_in_rows_and_bytes(spark, docs, words):
    rows = corpus(words)
    many = docs([(i, t) for i, t in rows for _ in range(20)] + [(i, f"{t} again") for i, t in rows])
    none = [(10_000 + i, "no document has this id") for i in range(500)]
    lab = labels(spark, rows).union(labels(spark, none).where("doc_id > 9999"))
    how = ("doc_id", "text", "n_chars", "quality")
    two = q.training_rows(many, lab, 2, 1 << 30, *how)
    assert len(two) == 2
    every = q.training_rows(many, lab, 10_000, 1 << 30, *how)
    assert len(every) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i, _ in rows)
    size = lambda rs: sum(4 * len(i) + 4 * len(v) for i, v, _ in rs)
    some = q.training_rows(many, lab, 10_000, size(every[:7]), *how)
    assert len(some) == 7 and size(some) <= size(every[:7])
