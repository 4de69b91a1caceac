import hashlib
import random

import pytest

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
from vecscope.llm import bpe  # noqa: E402

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec.load(PATH)


def want(library, text):
    e = library.encode(text or "", add_special_tokens=False)
    return " ".join(map(str, e.ids)), library.decode(e.ids, skip_special_tokens=False)


ODD = [
    "", " ", "a<|endoftext|>b <|startoftext|>", "İstanbul ΣΑΣ ſ ß Å é 한글 中文字 １２３ ² ½ ﬁ \x1c\x1d \x85 \xa0 a​b 👍🏽 don't I'LL 'S", "x" * 5000, "ab" * 3000,
    "\x00\x01", "﻿abc", "aͅb", "𝒜𝓑 ①", "wordswithoutspaces" * 200,
]


def test_odd_texts_equal_the_library(library, codec):
    r = random.Random(1)
    span = lambda: chr(r.choice([r.randrange(32, 0x250), r.randrange(0x250, 0x3000), r.randrange(0x3000, 0xD7FF), r.randrange(0xE000, 0x1FFFF)]))
    texts = ODD + ["".join(span() for _ in range(40)) for _ in range(400)]
    assert codec.encode_batch(texts) == [want(library, t) for t in texts]


def test_plain_characters_need_no_library(library, codec):
    texts = [f"a{chr(k)}B {chr(k)}1{chr(k)}" for k in range(0x2100)]
    assert codec.encode_batch(texts) == [want(library, t) for t in texts]


def test_speculation_is_used_and_checked(codec):
    fresh = bpe.Codec.load(PATH)
    got = fresh.encode_words(["the", "hello", "tionthe", "zqxjv", "ingerou"])
    assert fresh.fast_words and got == [fresh.merge([fresh.vocab[s] for s in fresh.symbols(w)]) for w in ("the", "hello", "tionthe", "zqxjv", "ingerou")]


def test_short_and_long_merges_agree(codec, monkeypatch):
    r = random.Random(5)
    words = ["".join(r.choice("aeionrst") for _ in range(r.randint(2, 40))) for _ in range(300)]
    start = [[codec.vocab[s] for s in codec.symbols(w)] for w in words]
    short = [codec.merge(list(s)) for s in start]
    monkeypatch.setattr(bpe, "SHORT", 0)
    assert [codec.merge(list(s)) for s in start] == short


def test_small_cache_gives_the_same(library, monkeypatch):
    monkeypatch.setattr(bpe, "WORDS_KEPT", 3)
    c = bpe.Codec.load(PATH)
    texts = [f"word{k} again and again {k}" for k in range(50)]
    assert [c.encode(t) for t in texts] == [want(library, t) for t in texts]


def test_query_columns(spark, docs, library):
    rows = [(1, "Hello World, it's 2024!"), (2, None), (3, ""), (1, "Hello World, it's 2024!"), (None, "x"), (4, ODD[2])]
    got = bpe.encode(docs(rows), PATH, columns=("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        ids, decoded = want(library, text[r["doc_id"]])
        assert " ".join(map(str, r["ids"])) == ids and r["decoded"] == decoded and r["n_tokens"] == len(ids.split())
        assert r["ids_sha256"] == hashlib.sha256(ids.encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
        assert bpe.decode_ids(PATH, r["ids"]) == decoded
    assert bpe.encode(docs([]), PATH).count() == 0


def test_whole_table(spark, sf, library):
    from vecscope.llm.queries import queries

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries()["op3_bpe"](spark, sf).collect():
        ids, decoded = want(library, texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids.split()), hashlib.sha256(ids.encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_verdicts_are_bounded_and_sorted(monkeypatch):
    import random

    import numpy as np

    codec = bpe.Codec.load(P.path("word_bpe_49k.json"))
    monkeypatch.setattr(bpe, "PAIRS_KEPT", 300)
    r = random.Random(1)
    for _ in range(30):
        codec.encode(" ".join("".join(r.choice("abcdefgh") for _ in range(9)) for _ in range(20)))
        assert sum(len(k) for k, _ in codec.runs) <= 600 and all((np.diff(k) > 0).all() for k, _ in codec.runs)
