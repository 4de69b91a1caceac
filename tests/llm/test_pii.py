import hashlib
import random
import re

from vecscope.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        t += x - 9 * (x > 9)
    return t % 10 == 0


def base(text):
    out = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 12 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15
            if ok:
                out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


HARD = [
    None, "", "a@b.com_c@d.com", "x@y.z.w@q.r", "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1", "+1+2 (555) 123-4567-", "4111 1111 1111 1111", "4111-1111-1111-1111 5",
    "😀 a@b.co 😀 +49 151 1234567 end", "a@b.cc " * 700, "é1.1.1.1é", " 4012888888881881", "+1 (202) 555-0147, me@home.org; 10.0.0.1", "@.@ a@b a@.c", "+" * 50 + "12", "no data here",
]


def check(rows, df):
    want = sorted(((i, *[sum(x.startswith(k) for x in base(t)) for k in BASE], hashlib.sha256(",".join(base(t)).encode()).hexdigest()) for i, t in rows), key=repr)
    assert sorted((tuple(r)[:6] for r in pii.find(df).collect()), key=repr) == want


def test_base_spans_equal_plain_patterns(docs):
    r = random.Random(3)
    noise = ["".join(r.choice("a1.@+- ()2%_9b\n") for _ in range(150)) for _ in range(200)]
    rows = list(enumerate(HARD + noise)) + [(2, HARD[2]), (None, "q@w.er")]
    check(rows, docs(rows))


def test_long_runs_stay_linear_and_shallow(docs):
    rows = list(enumerate(["9" * 60_000, "a." * 30_000 + "@b", "a@" + "b." * 30_000 + "c", "+1" + " (" * 30_000]))
    got = {r["doc_id"]: r["spans"] for r in pii.find(docs(rows)).collect()}
    assert got == {0: "", 1: "", 2: f"email:0:{len(rows[2][1])}", 3: ""}


def test_whole_table(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    check([tuple(r) for r in d.select("doc_id", "text").collect()], d)


def seeded():
    rows = [(i, f"Please reach the desk at: +1202555{1000 + i} today") for i in range(8)]
    return [*rows, (90, "Please reach the desk at: 2025559999 today"), (91, "There were 2025559999 grains"), (92, "desk at: none")]


def test_contexts_discover_what_base_misses(docs):
    got = {r["doc_id"]: (r["n_phone"], r["n_added"], r["spans"]) for r in pii.find(docs(seeded())).collect()}
    assert got[90] == (0, 1, "phone:26:36")
    assert got[91] == (0, 0, "") and got[92] == (0, 0, "")
    assert got[3] == (1, 0, "phone:26:38")


def test_more_unseen_than_seeds_are_discovered(docs):
    rows = [(i, f"tel: +1202555{1000 + i}") for i in range(20)] + [(100 + i, f"tel: 202555{2000 + i}") for i in range(60)]
    got = {r["doc_id"]: r["n_added"] for r in pii.find(docs(rows)).collect()}
    assert all(got[100 + i] == 1 for i in range(60))


def test_seeds_of_another_kind_count_against_a_pattern(docs):
    rows = [(i, f"node: +1202555{1000 + i}") for i in range(5)] + [(20 + i, f"node: 192.168.10.{100 + i}") for i in range(5)] + [(90, "node: 2025559999")]
    assert {r["doc_id"]: r["n_added"] for r in pii.find(docs(rows)).collect()}[90] == 0


def test_confidence_passes_between_patterns(spark):
    from vecscope.llm.common import Scratch

    strong = [(3, f"+{i}", True, ["tel:"]) for i in range(99)]
    weak = [(3, f"+{i}", True, ["desk a"]) for i in range(200, 203)] + [(1, f"10.20.30.{i}", True, ["desk a"]) for i in range(10, 16)]
    both = [(3, f"55{i}", False, ["tel:", "desk a"]) for i in range(1000, 1090)] + [(3, f"66{i}", False, ["desk a"]) for i in range(1000, 1100)]
    rows = spark.createDataFrame(strong + weak + both, "kind int, found string, seed boolean, patterns array<string>")
    got = {r["pattern"]: r["confidence"] for r in pii.pattern_scores(rows, Scratch(spark, "t")).where("kind = 3").collect()}
    assert abs(got["tel:"] - 0.99) < 1e-9 and abs(got["desk a"] - (3 + 90 * 0.99) / (3 + 6 + 1 + 90)) < 1e-9


def test_copies_do_not_raise_confidence(docs):
    rows = [(i, "Please reach the desk at: +12025551000 today") for i in range(20)] + [(90, "Please reach the desk at: 2025559999 today")]
    assert {r["doc_id"]: r["n_added"] for r in pii.find(docs(rows)).collect()}[90] == 0


def test_redaction(docs):
    d = docs([*seeded(), (100, HARD[12]), (101, None), (102, "plain"), (102, "plain"), (103, "a@b.co a@b.co")])
    out = pii.redact(d)
    assert out.columns == d.columns
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append((r["text"], r["n_chars"], r["lang"], r["row_"]))
    assert got[100] == [("[PHONE], [EMAIL]; [IP]", 22, "en", 1)]
    assert got[90][0][0] == "Please reach the desk at: [PHONE] today"
    assert got[101] == [(None, None, "en", 1)] and len(got[102]) == 2 and got[103][0][0] == "[EMAIL] [EMAIL]"
    assert pii.redact(docs([])).count() == 0 and pii.find(docs([])).count() == 0


def test_many_added_spans_join_without_broadcast(docs, monkeypatch):
    monkeypatch.setattr(pii, "BROADCAST_ROWS", -1)
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs(seeded())).collect()}
    assert got[90].endswith("[PHONE] today")


def test_discoveries_induce_further_patterns(docs):
    desk = [(i, f"Please reach the desk at: +1202555{1000 + i} today") for i in range(8)]
    found = [(20 + i, f"Please reach the desk at: 303555{2000 + i} today") for i in range(8)]
    again = [(40 + i, f"Call our hotline no: 303555{2000 + i} now") for i in range(8)]
    rows = [*desk, *found, *again, (90, "Call our hotline no: 4045559999 now"), (91, "There were 4045559999 grains"), (92, "our crate was 4045558888")]
    got = {r["doc_id"]: (r["n_added"], r["spans"]) for r in pii.find(docs(rows)).collect()}
    assert all(got[i][0] == 1 for i, _ in [*found, *again]) and got[90] == (1, "phone:21:31")
    assert got[91][0] == got[92][0] == 0
    # two discovered numbers are not enough
    few = [*desk, *found, *again[:2], rows[24]]
    assert {r["doc_id"]: r["n_added"] for r in pii.find(docs(few)).collect()}[90] == 0


def test_null_and_repeated_ids_get_added_spans(docs):
    rows = [*seeded(), (None, "Please reach the desk at: 2025557777 today"), (90, "Please reach the desk at: 2025559999 today"), (90, "nothing")]
    got = [(r["doc_id"], r["spans"]) for r in pii.find(docs(rows)).collect()]
    assert got.count((None, "phone:26:36")) == 1 and got.count((90, "phone:26:36")) == 2 and got.count((90, "")) == 1
    assert sum(r["text"] == "Please reach the desk at: [PHONE] today" and r["doc_id"] is None for r in pii.redact(docs(rows)).collect()) == 1


def test_hot_patterns_and_instances_give_the_same(docs, monkeypatch):
    from vecscope.llm import common

    rows = [(i, f"desk at: +1202555{1000 + i}") for i in range(20)] + [(100 + i, f"desk at: 202555{2000 + i % 9} or w{i} x: 202555{2000 + i % 9}") for i in range(60)]
    want = sorted(tuple(r) for r in pii.find(docs(rows)).collect())
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    monkeypatch.setattr(common, "HOT_KEYS", 10**9)
    assert sorted(tuple(r) for r in pii.find(docs(rows)).collect()) == want and sum(r[-1] for r in want) >= 60
