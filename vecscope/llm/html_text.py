"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page is cut into leaf blocks, runs of text between block-level tags.  Each block has binary features: the tags and
the class and id words of its ancestors, its own tag, bins of its length, link share and punctuation.  The field is
trained on labelled pages by gradient ascent on the conditional likelihood and decoded by Viterbi; the blocks labelled
as article are joined.  Weights are a table of fixed size, sent to the executors once; pages are judged where they lie.

Defined results
  null or empty html   text '' and n_chars 0
  very long pages      parsing and decoding are linear in the page and in its nesting: open tags are nodes of a tree
                       that add to what their parents have; no block is cut or dropped by size
  broken markup        unknown and unclosed tags are closed by their parents' end; p and li by the next of their kind
  ties                 Viterbi prefers the label 0
  repeated rows        each gets its row
  empty table          no rows
  extra columns        `extract` returns its own columns only
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .labelled_pages import labelled_pages

HIDDEN = frozenset("script style template noscript svg head iframe object textarea select option math audio video canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open tag that a new one of the set ends, unless a tag of the third set stands between.
_BREAKS_P = BLOCK - {"button", "label", "legend", "caption"}
_SCOPE = frozenset("div section article aside main nav header footer ul ol table td th tr form body html blockquote".split())
CONTAINERS = frozenset("article main nav header footer aside form section body dialog figure table".split())
WORDS = re.compile(r"[a-z]+|[0-9]+")
BITS = 14


@functools.lru_cache(maxsize=100_000)
def _slot(name: str) -> int:
    h = 2166136261
    for c in name.encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return (h ^ (h >> 15)) & ((1 << BITS) - 1)


@functools.lru_cache(maxsize=20_000)
def _open_slots(tag: str, words: tuple[str, ...]) -> tuple[int, ...]:
    """Features of everything below an open tag."""
    return tuple({_slot(f"in:{tag}"), *[_slot(f"w:{w}") for w in words]})


@functools.lru_cache(maxsize=20_000)
def _near_slots(tag: str, words: tuple[str, ...]) -> frozenset[int]:
    """Features of what has this tag as its innermost container, which says most about a block."""
    return frozenset({_slot(f"near:{tag}"), *[_slot(f"near:w:{w}") for w in words]})


@functools.lru_cache(maxsize=20_000)
def _own_slots(tag: str) -> frozenset[int]:
    return frozenset({_slot(f"own:{tag}"), _slot("bias")})


class Node:
    """An open tag with its parent; it holds only the features that none of its ancestors has."""

    __slots__ = ("added", "between", "box", "near", "own", "parent", "place", "slots", "tag", "total")

    def __init__(self, parent: Node | None, tag: str, words: tuple[str, ...], active: dict[int, int]):
        self.parent, self.tag = parent, tag
        self.slots = _open_slots(tag, words) if parent else ()
        self.added = tuple(s for s in self.slots if not active.get(s))
        for s in self.slots:
            active[s] = active.get(s, 0) + 1
        self.total = self.place = None
        if parent is None:
            self.box, self.near, self.between, self.own = self, frozenset(), (), ()
            return
        if words or tag in CONTAINERS:
            self.box, self.between = self, ()
            self.near = frozenset(s for s in _near_slots(tag, words) if not active.get(s))
        else:
            self.box, self.near, self.between = parent.box, parent.near, parent.between
            if more := [s for s in self.added if s in self.near]:
                self.between += tuple(more)
        self.own = tuple(s for s in _own_slots(tag) if not active.get(s) and s not in self.near)

    def features(self) -> tuple[int, ...]:
        out, n = set(self.near).union(self.own or (_slot("bias"),)), self
        while n is not None:
            out.update(n.added)
            n = n.parent
        return tuple(sorted(out))


class Blocks(HTMLParser):
    """Leaf blocks of a page as (text, innermost open tag, characters in links)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.active: dict[int, int] = {}
        self.root = Node(None, "", (), self.active)
        self.stack: list[Node] = []
        #: Where each tag stands on the stack, and where the tags of _SCOPE do.
        self.at: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.blocks: list[tuple[str, Node, int]] = []
        self.buffer: list[str] = []
        self.linked = self.hidden = self.links = 0
        self.solid = False
        self.where = self.root

    def flush(self) -> None:
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            if text:
                self.blocks.append((text, self.where, min(self.linked, len(text))))
            self.buffer, self.linked, self.solid = [], 0, False

    def _push(self, tag: str, words: tuple[str, ...]) -> None:
        if tag in _SCOPE:
            self.scopes.append(len(self.stack))
        self.at.setdefault(tag, []).append(len(self.stack))
        self.stack.append(Node(self.stack[-1] if self.stack else self.root, tag, words, self.active))
        self.hidden += tag in HIDDEN
        self.links += tag == "a"

    def _pop(self, to: int) -> None:
        while len(self.stack) > to:
            n = self.stack.pop()
            self.at[n.tag].pop()
            if n.tag in _SCOPE:
                self.scopes.pop()
            for s in n.slots:
                self.active[s] -= 1
            self.hidden -= n.tag in HIDDEN
            self.links -= n.tag == "a"

    def _last(self, tags: tuple[str, ...]) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def _close(self, tags: tuple[str, ...], scope: int) -> None:
        """End the innermost of the tags, unless a tag of the scope stands between."""
        if (i := self._last(tags)) > scope:
            self._pop(i)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.flush()
            if tag in _BREAKS_P:
                self._close(("p",), self.scopes[-1] if self.scopes else -1)
            if tag == "li":
                self._close(("li",), self._last(("ul", "ol", "menu")))
            elif tag in ("td", "th"):
                self._close(("td", "th"), self._last(("tr", "table")))
            elif tag == "tr":
                self._close(("tr",), self._last(("table",)))
            elif tag == "body":
                self._close(("head",), -1)
        elif tag == "br":
            self.buffer.append(" ")
        if tag in VOID:
            return
        words: tuple[str, ...] = ()
        for name, value in attrs:
            if value and name in ("class", "id", "role"):
                words += tuple(WORDS.findall(value.lower()))
        self._push(tag, words)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID or tag in BLOCK:
            self.handle_starttag(tag, attrs)
            if tag not in VOID:
                self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        i = self._last((tag,))
        if i >= 0 and (tag in BLOCK or not self.scopes or self.scopes[-1] < i):
            self._pop(i)

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        if not self.solid:
            self.where = self.stack[-1] if self.stack else self.root
            self.solid = bool(data.strip())
        self.buffer.append(data)
        if self.links:
            self.linked += len(data)

    @classmethod
    def of(cls, html: str | None) -> list[tuple[str, Node, int]]:
        if not html:
            return []
        p = cls()
        p.feed(html)
        p.close()
        p.flush()
        return p.blocks


@functools.lru_cache(maxsize=10_000)
def _text_features(size: int, share: int, stops: int) -> tuple[int, ...]:
    return tuple({_slot(f"size:{size}"), _slot(f"links:{share}"), _slot(f"stops:{stops}")})


def _of_text(text: str, linked: int) -> tuple[int, ...]:
    return _text_features(min(12, len(text).bit_length()), round(4 * linked / len(text)), min(3, sum(map(text.count, ".!?"))))


def features(blocks: list[tuple[str, Node, int]]) -> list[tuple[int, ...]]:
    """The active binary features of each block, listed in full: for training."""
    return [where.features() + _of_text(text, linked) for text, where, linked in blocks]


class Field:
    """A linear chain over labels 0 and 1: state weights by feature, and transition weights."""

    def __init__(self, state: np.ndarray, move: np.ndarray, first: np.ndarray):
        self.state, self.move, self.first = state, move, first

    def emissions(self, seq: list[tuple[int, ...]]) -> np.ndarray:
        size = np.fromiter(map(len, seq), np.int64, len(seq))
        flat = np.fromiter((f for s in seq for f in s), np.int64, int(size.sum()))
        return np.add.reduceat(self.state[flat], np.concatenate([[0], np.cumsum(size)[:-1]]), axis=0)

    def sums(self, blocks: list[tuple[str, Node, int]]) -> list[tuple[float, float]]:
        """The emissions of a page's blocks, each tag's share added up once for all that is below it."""
        if not hasattr(self, "pairs"):
            self.pairs = self.state.tolist()
        w, out = self.pairs, []
        boxes: dict[int, tuple[float, float]] = {}
        for text, where, linked in blocks:
            if where.place is None:
                way, n = [], where
                while n is not None and n.total is None:
                    way.append(n)
                    n = n.parent
                for n in reversed(way):
                    x, y = n.parent.total if n.parent else (0.0, 0.0)
                    n.total = x + sum([w[s][0] for s in n.added]), y + sum([w[s][1] for s in n.added])
                if id(where.box) not in boxes:  # what a container adds, for all in it
                    boxes[id(where.box)] = sum([w[s][0] for s in where.near]), sum([w[s][1] for s in where.near])
                (x, y), (u, v), own = where.total, boxes[id(where.box)], where.own or (_slot("bias"),)
                x += u - sum([w[s][0] for s in where.between]) + sum([w[s][0] for s in own])
                y += v - sum([w[s][1] for s in where.between]) + sum([w[s][1] for s in own])
                where.place = x, y
            x, y = where.place
            for s in _of_text(text, linked):
                x, y = x + w[s][0], y + w[s][1]
            out.append((x, y))
        return out

    def decode(self, seq: list[tuple[int, ...]]) -> list[int]:
        """Viterbi: the most likely labels of a page's blocks."""
        return self.viterbi(self.emissions(seq).tolist()) if seq else []

    def viterbi(self, e: list[tuple[float, float]]) -> list[int]:
        if not e:
            return []
        (a, b), (c, d) = self.move.tolist()
        s0, s1 = self.first[0] + e[0][0], self.first[1] + e[0][1]
        back = []
        for x, y in e[1:]:
            p0, p1 = s1 + c > s0 + a, s1 + d > s0 + b
            back.append((p0, p1))
            s0, s1 = (s1 + c if p0 else s0 + a) + x, (s1 + d if p1 else s0 + b) + y
        now = int(s1 > s0)
        out = [now]
        for p in reversed(back):
            now = int(p[now])
            out.append(now)
        return out[::-1]


def train(pages: list[tuple[str, list[int]]], steps: int = 150, rate: float = 0.15, decay: float = 1e-4) -> Field:
    """Maximise the conditional likelihood of labelled pages: forward-backward over all pages at once, Adam steps."""
    seqs, gold = [], []
    for html, labels in pages:
        f = features(Blocks.of(html))
        if len(f) != len(labels):
            raise ValueError(f"a labelled page has {len(labels)} labels for {len(f)} blocks")
        if f:
            seqs.append(f)
            gold.append(labels)
    n, longest = len(seqs), max(map(len, seqs))
    length = np.array(list(map(len, seqs)))
    mask = np.arange(longest)[None, :] < length[:, None]
    y = np.zeros((n, longest), np.int64)
    for i, g in enumerate(gold):
        y[i, : len(g)] = g
    rows = [f for s in seqs for f in s]
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    flat = np.fromiter((f for r in rows for f in r), np.int64, int(size.sum()))
    owner, starts = np.repeat(np.arange(len(rows)), size), np.concatenate([[0], np.cumsum(size)[:-1]])
    w, t, s = np.zeros((1 << BITS, 2)), np.zeros((2, 2)), np.zeros(2)
    want = np.zeros((len(rows), 2))
    want[np.arange(len(rows)), y[mask]] = 1
    pair_gold = np.zeros((2, 2))
    both = mask[:, 1:]
    np.add.at(pair_gold, (y[:, :-1][both], y[:, 1:][both]), 1)
    first_gold = np.bincount(y[:, 0], minlength=2).astype(float)
    lse = lambda x, axis: np.logaddexp.reduce(x, axis=axis)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, t, s)]
    for step in range(1, steps + 1):
        e = np.zeros((n, longest, 2))
        e[mask] = np.add.reduceat(w[flat], starts, axis=0)
        a, b = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        a[:, 0] = s + e[:, 0]
        for k in range(1, longest):
            a[:, k] = np.where(mask[:, k, None], lse(a[:, k - 1, :, None] + t, 1) + e[:, k], a[:, k - 1])
        for k in range(longest - 2, -1, -1):
            b[:, k] = np.where(mask[:, k + 1, None], lse(t + (e[:, k + 1] + b[:, k + 1])[:, None, :], 2), 0)
        z = lse(a[:, -1], 1)
        single = np.exp(a + b - z[:, None, None])
        pair = np.exp(a[:, :-1, :, None] + t + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None])[both].sum(axis=0)
        gap = want - single[mask]
        gw = np.stack([np.bincount(flat, gap[owner, c], 1 << BITS) for c in (0, 1)], axis=1)
        grads = (gw / n - decay * w, (pair_gold - pair) / n, (first_gold - single[:, 0].sum(axis=0)) / n)
        for p, g, m in zip((w, t, s), grads, moments, strict=True):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.999 * m[1] + 0.001 * g * g
            p += rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    return Field(w, t, s)


@functools.lru_cache(maxsize=4)
def trained(pages: int = 1500, seed: int = 11) -> Field:
    """The field trained on `pages` labelled pages, a bounded and fixed sample."""
    return train(labelled_pages(pages, seed))


def main_text(field: Field, html: str | None) -> str:
    blocks = Blocks.of(html)
    return " ".join([b[0] for b, label in zip(blocks, field.viterbi(field.sums(blocks)), strict=True) if label])


def extract(pages: DataFrame, field: Field | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row."""
    narrow = pages.select(pages[key].alias("k"), pages[url].cast("string").alias("u"), pages[html].cast("string").alias("h"))
    sent = pages.sparkSession.sparkContext.broadcast(field or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                texts = [main_text(sent.value, h.as_py()) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [key, url, "text", "n_chars"])

    kind = dict(narrow.dtypes)["k"]
    return narrow.mapInArrow(run, f"{key} {kind}, {url} string, text string, n_chars long")
