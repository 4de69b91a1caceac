import re
from collections import Counter

import pytest

from vecscope.llm import quality_rules as q

WORD = re.compile("[^\x20\x09-\x0d]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    tri = Counter(zip(w, w[1:], w[2:]))
    hit = {k + j for k in range(len(w) - 2) if tri[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def texts(words):
    return [
        None, "", " \n\t", "one", "a b c a b c", "x x x x x", "a b c d a b c d e a b c\n" * 3, words(60), words(200, 1), words(60) + " ### $$$ *** ||| &&& <<< %%%",
        "\n".join([words(20, 2)] * 4), "ümläut 😀 word joined here\x0bx\x0cy", words(40) + "\n" + words(40), "AND SHOUT " * 60, words(30_000, 3), "tick tock " * 20_000,
    ]


def test_counts_equal_brute_force(docs, words):
    rows = list(enumerate(texts(words))) + [(3, "one"), (None, "no id")]
    got = sorted((tuple(r)[:6] for r in q.score_rules(docs(rows)).collect()), key=repr)
    want = sorted(((i, *base(t)) for i, t in rows), key=repr)
    key = lambda r: (r[0], r[1], r[2], r[3], r[4], r[5])
    assert [key(r) for r in got] == [key(r) for r in want]


def test_verdicts(docs, words):
    rows = list(enumerate(texts(words)))
    got = {r["doc_id"]: r for r in q.score_rules(docs(rows)).collect()}
    assert got[0]["base_failed"] and not got[0]["kept"]
    assert got[7]["kept"] and got[8]["kept"] and not got[9]["kept"]
    assert got[10]["n_dup_lines"] == 3 and got[15]["n_repeat_words"] == 40_000 and not got[13]["kept"]
    assert all(not (r["base_failed"] and r["kept"]) for r in got.values())


def test_kept_rows_are_unchanged(docs, words):
    d = docs([*enumerate(texts(words)), (7, words(60))])
    kept = {r["doc_id"] for r in q.score_rules(d).collect() if r["kept"]}
    out = q.keep_good(d)
    assert out.columns == d.columns
    assert sorted(out.collect()) == sorted(r for r in d.collect() if r["doc_id"] in kept)


def test_empty_table_and_other_rules(docs, words):
    assert q.score_rules(docs([])).count() == 0 and q.keep_good(docs([])).count() == 0
    strict = (q.Rule("long words", "mean_word_length", 50.0),)
    assert not q.score_rules(docs([(1, words(60))]), strict).first()["kept"]


@pytest.mark.parametrize("name", ["op1_quality_rules"])
def test_equals_sql(spark, sf, name):
    from test_llm_sql import compare

    compare(spark, sf, name)


def test_good_labels_are_kept(spark, sf):
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    j = q.score_rules(d).join(lab, "doc_id").where("NOT base_failed")
    assert j.where("quality = 1 AND NOT kept").count() == 0 and j.where("quality = 0 AND kept").count() == 0
