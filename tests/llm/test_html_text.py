import itertools
import re
from html import unescape

import numpy as np

from vecscope.llm import html_text as h
from vecscope.llm.labelled_pages import labelled_pages


def text(html):
    return h.main_text(h.trained(), html)


def test_blocks_of_broken_markup():
    b = h.Blocks.of("<p>one<p>two <b>bold</b>er<br>line<ul><li>a<li>b &amp; c</ul><script>x<p></script><!-- no --><div>d<span>e</span></div>tail")
    assert [x[0] for x in b] == ["one", "two bolder line", "a", "b & c", "de", "tail"]
    assert h.Blocks.of(None) == [] and h.Blocks.of("") == [] and h.Blocks.of("<p> \n </p>") == []


def test_held_out_pages():
    field = h.trained()
    right = total = 0
    for html, labels in labelled_pages(150, seed=99):
        got = field.decode(h.features(h.Blocks.of(html)))
        right += sum(map(int.__eq__, got, labels))
        total += len(labels)
    assert right / total > 0.99


def test_viterbi_equals_brute_force():
    r = np.random.default_rng(3)
    f = h.Field(r.normal(size=(1 << h.BITS, 2)), r.normal(size=(2, 2)), r.normal(size=2))
    for n in range(1, 8):
        seq = [tuple(r.integers(0, 1 << h.BITS, 4).tolist()) for _ in range(n)]
        e = f.emissions(seq)
        score = lambda y: f.first[y[0]] + sum(e[i, y[i]] for i in range(n)) + sum(f.move[a, b] for a, b in itertools.pairwise(y))  # noqa: E731, B023
        assert tuple(f.decode(seq)) == max(itertools.product((0, 1), repeat=n), key=score)
    assert f.decode([]) == []


def test_parts_around_the_article():
    page = """<html><head><title>T</title></head><body><div class="cookie-notice"><p>We use cookies.</p></div><header><div class="logo">Site</div></header>
    <nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><article><h1>Head&nbsp;line</h1><p>First   &lt;para&gt;
    of text.</p><div class="ad">Buy now</div><p>Be.</p></article><aside class="sidebar"><p>Related things to read</p></aside>
    <section id="comments"><h3>Comments</h3><div class="comment"><p>I liked this a lot, thank you.</p></div></section><form><p>Your name</p><button>Send</button></form><footer>&copy; 2024</footer></body></html>"""
    assert text(page) == "Head line First <para> of text. Be."


def test_columns_nulls_repeats_and_long_pages(spark):
    long = "<article>" + "<p>word word.</p>" * 20_000 + "</article>"
    rows = [(1, "u", "<article><p>x y z.</p></article>", "t", 3), (2, None, None, "t", 3), (2, None, None, "t", 3), (3, "u", "", "t", 3), (4, "u", long, "t", 3), (None, "u", "<article><p>q r.</p></article>", "t", 3)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = h.extract(d).collect()
    assert sorted(((r["page_id"], r["n_chars"], r["text"][:6]) for r in got), key=repr) == sorted([(1, 6, "x y z."), (2, 0, ""), (2, 0, ""), (3, 0, ""), (4, 20_000 * 11 - 1, "word w"), (None, 4, "q r.")], key=repr)
    assert h.extract(d.limit(0)).count() == 0


def test_whole_table(spark, sf):
    from vecscope.llm.queries import queries

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries()["op6_html_text"](spark, sf).collect():
        inner = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1].replace("<br>", " ")
        parts = [" ".join(unescape(re.sub(r"</?b>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == " ".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


def test_sums_along_the_tree_equal_full_features():
    import random

    r = random.Random(4)
    tags = "div p span a ul li article section b table tr td nav x-y".split()
    field = h.trained()
    for _ in range(60):
        page = "".join(
            r.choice((f"<{(t := r.choice(tags))}{r.choice(('', ' class=' + repr(r.choice(('ad box', 'main text', 'menu side-bar', 'c1 c2 c3')))))}>", f"</{r.choice(tags)}>", " text of a block. "))
            for _ in range(150)
        )
        blocks = h.Blocks.of(page)
        if blocks:
            assert np.allclose(field.sums(blocks), field.emissions(h.features(blocks)))


def test_deep_nesting_stays_linear():
    import time

    h.trained()
    for page in ("<div>x" * 200_000, "<span>" * 100_000 + "<p>x" * 100_000, "<div class='a b'>x" * 100_000, "<b> </b>" * 100_000 + "x", "<p>" + "</i>" * 200_000 + "x", "<li><td>" * 100_000 + "x"):
        began = time.process_time()
        text(page)
        assert time.process_time() - began < 12, page[:20]


def test_pages_of_other_shapes():
    story = "The river rose in the night and the mill stood under water by noon. Nobody in the village had seen such a flood before."
    more = "They carried the flour up to the church, sack by sack, and waited there. The miller kept count with chalk on the door."
    pages = [
        f"<html><body><div id='top'><a href='/'>Home</a> <a href='/n'>News</a> <a href='/s'>Sport</a></div><main><h1>Flood</h1><p>{story}</p><p>{more}</p></main><div class='footer'>Imprint</div></body></html>",
        f"<body><nav><a href=x>One</a><a href=y>Two</a></nav><div class='content'><article><p>{story}<p>{more}</article></div><footer><p>All rights reserved.</p></footer></body>",
        f"<article><header><h1>Flood</h1></header><section><p>{story}</p></section><blockquote>{more}</blockquote></article><aside><ul><li><a href=q>Other story</a></ul></aside>",
    ]
    for page in pages:
        got = text(page)
        assert story in got and more in got
        assert not any(x in got for x in ("Sport", "Imprint", "All rights", "Other story", "Two"))
