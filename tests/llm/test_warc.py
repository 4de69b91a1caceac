import gzip
import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from vecscope.llm import warc as w
from vecscope.llm.common import Scratch

BIG = "<html>" + "payload " * 40 + "</html>"
ROWS = [
    (5, "http://b.example.com/x?q=1", BIG), (2, "http://a.example.com/", BIG), (9, "https://a.example.com/", BIG), (1, None, "small"), (3, "no scheme", "small"), (4, "http://a.example.com/", None),
    (6, "http://a.example.com/", ""), (7, "http://ü.example.com/\r\nWARC-Type: x", "\r\n\r\nWARC/1.1\r\n\r\n" + "é" * 60), (8, "http://long.example.com/", "z" * 3_000_000), (8, "http://long.example.com/", "z" * 3_000_000),
]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, "k") for r in rows], "page_id long, url string, html string, digest string, size int, key string")


def want(rows):
    groups = defaultdict(list)
    for i, _, html in rows:
        groups[(html or "").encode()].append(i)
    out = []
    for body, ids in groups.items():
        for i in ids:
            again = len(body) >= 100 and i != min(ids)
            out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", min(ids) if again else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    got = w.archive(pages(spark, ROWS)).read_all().collect()
    assert sorted((tuple(r) for r in got), key=repr) == want(ROWS)


def test_salted_groups_and_small_files(spark, monkeypatch):
    monkeypatch.setattr(w, "BROADCAST_ROWS", -1)
    rows = [(i, f"http://h{i % 7}.example.org/{i}", BIG if i % 3 else f"{BIG}{i}") for i in range(300)]
    got = w.archive(pages(spark, rows)).read_all().collect()
    assert sorted((tuple(r) for r in got), key=repr) == want(rows)


def test_lookup_reads_few_blocks(spark, tmp_path):
    rows = [(i, f"http://h{i % 40}.example.org/p{i % 50}", f"body {i} " + "x" * 120) for i in range(2000)]
    root = f"file://{tmp_path}"
    s = Scratch(spark, "t")
    manifest = s.save(w.write_archives(w.with_types(pages(spark, rows).select("page_id", "url", "html"), s), f"{root}/warc"), "m")
    a = w.Archive(spark, root, s.save(w.write_index(manifest, f"{root}/cdx", lines=16), "d"))
    assert a.directory.count() >= 125
    for i in (0, 7, 1999):
        key = spark.createDataFrame([(rows[i][1],)], "u string").select(w.surt(F.col("u"))).first()[0]
        same = sorted(j for j, u, _ in rows if u == rows[i][1])
        assert sorted(r.page() for r in a.lookup(key)) == same
        loaded = a.directory.orderBy("first_key", "first_id").collect()
        assert sorted(r.page() for r in a.lookup(key, loaded)) == same
    assert a.lookup("org,nowhere)/") == [] and a.lookup("") == []


def test_keys(spark):
    urls = ["http://WWW.Example.com/A?b#c", "http://example.com", None, "none", "https://a.b:80/"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(w.surt(F.col("u"))).collect()]
    assert got == ["com,example,www)/A?b#c", "com,example)", "", "", "b:80,a)/"]


def test_records_are_plain_warc():
    raw = w.record(3, "http://x/", b"abc", 3, hashlib.sha256(b"abc").hexdigest(), None)
    r = w.Record.parse(gzip.decompress(gzip.compress(raw)))
    assert (r.page(), r.kind, r.size, r.payload, r.headers["warc-target-uri"]) == (3, "response", 3, b"abc", "http://x/")
    again = w.Record.parse(w.record(4, "http://x/", b"", 3, hashlib.sha256(b"abc").hexdigest(), 3))
    assert (again.kind, again.page("warc-refers-to"), again.size, again.payload) == ("revisit", 3, 3, b"")


def test_empty_table(spark):
    a = w.archive(pages(spark, ROWS).limit(0))
    assert a.read_all().count() == 0 and a.lookup("x") == []


def test_whole_table(spark, sf):
    from vecscope.llm.queries import queries

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in queries()["op10_warc"](spark, sf).collect()), key=repr) == want(rows)


def test_reading_is_dealt_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(w, "READ_BYTES", 2000)
    rows = [(i, f"http://h{i}.example.org/", f"{i} " + BIG) for i in range(400)]
    got = w.archive(pages(spark, rows)).read_all()
    spread = got.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(spread) == 4 and max(r["count"] for r in spread) < 250
