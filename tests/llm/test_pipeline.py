"""The pipeline and each of its stages against plain versions, on the whole tables of sf0.01."""

import hashlib

import duckdb
import pytest
from test_decontaminate import brute as leaks
from test_near_dedup import brute as groups
from test_pii import BASE, base

import corpus_pipeline as cp
from vecscope.llm.queries import oracle_sql

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


def redacted(text):
    spans = [(int(a), int(b), k) for k, a, b in (x.split(":") for x in base(text))]
    out, at = [], 0
    for a, b, k in sorted(spans, key=lambda s: (s[0], list(BASE).index(s[2]))):
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


@pytest.fixture(scope="module")
def expected(sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    good = {r[0] for r in con.execute(f"SELECT doc_id FROM ({oracle_sql()['op1_quality_rules']}) WHERE kept").fetchall()}
    docs = [r for r in con.execute("SELECT doc_id, text FROM documents").fetchall() if r[0] in good]
    items = con.execute(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()
    one = {i for i, _, c in groups(docs, 80) if i == c}
    unique = [r for r in docs if r[0] in one]
    bad = {i for i, *_ in leaks(unique, items, 80)}
    clean = {i: redacted(t) for i, t in unique if i not in bad}
    return good, one, set(clean), clean


def test_run_and_every_stage(spark, sf, expected):
    good, one, clean, texts = expected
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    want = dict(zip([n for n, _ in cp.STAGES[:4]], (good, one, clean, clean), strict=True))
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf)
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert docs.columns == columns and {r["doc_id"] for r in docs.collect()} == want[name], name
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == texts
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())

    library = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = {r["doc_id"]: r for r in cp.run(spark, sf).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_stages_take_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, sf).count() == 0
