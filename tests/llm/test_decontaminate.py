from vecscope.llm import decontaminate as d


def sets(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, min(1, len(w))))}


def brute(docs, items, percent):
    out = []
    for i, t in docs:
        for j, u in items:
            a, b = sets(t), sets(u)
            if b and 100 * len(a & b) >= percent * len(b):
                out.append((i, j, len(a & b), len(b)))
    return sorted(out, key=repr)


def cases(words):
    items = [(k, words(10 + 9 * k, 50 + k)) for k in range(14)] + [(20, "too short"), (21, None), (22, ""), (23, words(37, 53)), (0, words(10, 50))]
    texts = [words(300, 1) + " " + items[3][1] + " " + words(4000, 2), words(50, 3) + " " + " ".join(items[5][1].split()[:-4]), " ".join(items[6][1].split()[:30]), items[2][1].upper(), None, "", "Too  SHORT", "this is too short", words(200, 4)]
    texts += [items[7][1] + " " + items[8][1]] * 3
    return list(enumerate(texts)) + [(None, items[4][1])], items


def bench(spark, items):
    return spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")


def test_equals_brute_force(spark, docs, words):
    rows, items = cases(words)
    for percent in (50, 80, 100):
        got = sorted((tuple(r) for r in d.contaminated(docs(rows), bench(spark, items), percent).collect()), key=repr)
        assert got == brute(rows, items, percent)
    assert len(got) > 5


def test_blocks_of_items_give_the_same(spark, docs, words):
    rows, items = cases(words)
    got = sorted((tuple(r) for r in d.contaminated(docs(rows), bench(spark, items), 80, block_bytes=300).collect()), key=repr)
    assert got == brute(rows, items, 80)


def test_equal_items_share_a_block_but_keep_their_rows(spark, docs, words, monkeypatch):
    rows, items = cases(words)
    items += [items[7]] * 40 + [(None, items[8][1])] * 3
    monkeypatch.setattr(d, "COPIES", 7)
    for size in (300, 1 << 20):
        got = sorted((tuple(r) for r in d.contaminated(docs(rows), bench(spark, items), 80, block_bytes=size).collect()), key=repr)
        assert got == brute(rows, items, 80)
    one = [items[7]] * 500
    assert len(d.write_blocks(bench(spark, one), 80, "item_id", "text", 5, 2 * len(items[7][1]))) == 1


def test_clean_rows_stay_unchanged(spark, docs, words):
    rows, items = cases(words)
    bad = {i for i, *_ in brute(rows, items, 80)}
    table = docs(rows)
    for size in (300, 1 << 20):
        out = d.keep_clean(table, bench(spark, items), 80, block_bytes=size)
        assert out.columns == table.columns
        assert sorted(out.collect(), key=repr) == sorted((r for r in table.collect() if r["doc_id"] not in bad), key=repr)


def test_empty_tables(spark, docs, words):
    rows, items = cases(words)
    assert d.contaminated(docs([]), bench(spark, items)).count() == 0
    assert d.contaminated(docs(rows), bench(spark, [])).count() == 0
    assert d.keep_clean(docs(rows), bench(spark, [])).count() == len(rows)


def test_sketches_keep_the_pigeonhole_bound():
    for n in range(1, 400):
        for percent in (50, 80, 95, 100):
            missing = n - -(-percent * n // 100)
            assert d.sketch_size(n, percent) >= min(n, missing + 1)
