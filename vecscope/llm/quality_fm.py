"""Quality classifier: a factorisation machine over hashed words, structure statistics and the length column.

The pairwise term is evaluated in linear time by the sum-of-squares identity: for each factor, half of the square of
the sum less the sum of the squares.  Training reads a bounded sample of labelled documents outside the held-out fold:
SAMPLE of them at most, one row each, and SAMPLE_BYTES of their features at most.  It is chosen by a hash of the id
among the labelled ids that have a document, so it is the same in every run.  Scoring sends a weight table of fixed
size to the executors and judges every row where it lies.

Defined results
  null or empty text   has structure features only and gets their score
  very long texts      all words count; memory grows with one text
  ties                 a score of 0.5 is predicted 1; a row with labels that disagree counts with their mean
  null labels or ids   not trained on; every row is scored all the same
  repeated rows        equal rows get equal scores; of rows that share a labelled id, training takes one, by a hash of
                       its text
  empty tables         no labels: every score is 0.5; no documents: no rows
  extra columns        `score` returns its own columns only
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

SLOTS = 1 << 15
STATS = 12
SAMPLE = 6000
SAMPLE_BYTES = 256 << 20
FACTORS = 8
WORDS_KEPT = 500_000
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class _Slots(dict):
    def __missing__(self, word: bytes) -> int:
        s = STATS + xxhash.xxh32_intdigest(word) % SLOTS
        if len(self) < WORDS_KEPT:
            self[word] = s
        return s


class Featurizer:
    """A text and its length column as sorted distinct slots with values; the first STATS slots are statistics."""

    def __init__(self) -> None:
        self.slots = _Slots()

    def __call__(self, text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
        raw = (text or "").encode(errors="surrogatepass")
        low = raw.lower()
        words = low.split()
        n, size = max(1, len(words)), max(1, len(raw))
        lines = [x for x in low.split(b"\n") if x.strip()]
        stats = np.array([
            1.0,
            np.log1p(len(words)) / 10,
            sum(map(len, words)) / n / 10,
            min(3.0, sum(map(low.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))) / n),
            min(3.0, low.count(b"!") / n),
            (len(raw) - len(raw.translate(None, CAPITALS))) / size,
            1 - len(set(lines)) / max(1, len(lines)),
            len(set(words)) / n,
            min(1.0, sum(map(low.count, (b"0", b"1", b"2", b"3", b"4", b"5", b"6", b"7", b"8", b"9"))) / size * 5),
            min(1.0, (low.count(b".") + low.count(b",")) / n),
            min(1.0, len(lines) / n),
            np.log1p(max(0, n_chars or 0)) / 10,
        ])
        if not words:
            return np.arange(STATS), stats
        idx, count = np.unique(np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words)), return_counts=True)
        value = np.log1p(count)
        return np.concatenate([np.arange(STATS), idx]), np.concatenate([stats, value / np.sqrt((value**2).sum())])


@dataclass
class Machine:
    bias: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, idx: np.ndarray, value: np.ndarray) -> float:
        vx = self.v[idx] * value[:, None]
        s = vx.sum(axis=0)
        return float(self.bias + self.w[idx] @ value + 0.5 * (s @ s - (vx * vx).sum()))

    def score(self, idx: np.ndarray, value: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.raw(idx, value), -30, 30))))

    @classmethod
    def blank(cls) -> Machine:
        return cls(0.0, np.zeros(STATS + SLOTS), np.zeros((STATS + SLOTS, FACTORS)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 25, batch: int = 128, rate: float = 0.02, decay: float = 1e-5, seed: int = 5) -> Machine:
    """Logistic loss by Adam on mini-batches; classes weigh the same in total."""
    m = Machine.blank()
    if not len(labels) or not 0 < labels.mean() < 1:
        return m
    rng = np.random.default_rng(seed)
    m.v[:] = rng.normal(0, 0.02, m.v.shape)
    weight = np.where(labels > 0.5, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    b = np.zeros(1)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (b, m.w, m.v)]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            step += 1
            size = np.array([len(rows[i][0]) for i in pick])
            idx, x = np.concatenate([rows[i][0] for i in pick]), np.concatenate([rows[i][1] for i in pick])
            owner, start = np.repeat(np.arange(len(pick)), size), np.concatenate([[0], np.cumsum(size)[:-1]])
            vx = m.v[idx] * x[:, None]
            s = np.add.reduceat(vx, start, axis=0)
            raw = b[0] + np.add.reduceat(m.w[idx] * x, start) + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), start))
            g = (1.0 / (1.0 + np.exp(-np.clip(raw, -30, 30))) - labels[pick]) * weight[pick] / len(pick)
            used, inv = np.unique(idx, return_inverse=True)
            gw = np.bincount(inv, g[owner] * x, len(used)) + decay * m.w[used]
            terms = (g[owner] * x)[:, None] * (s[owner] - vx)
            gv = np.stack([np.bincount(inv, terms[:, f], len(used)) for f in range(m.v.shape[1])], axis=1) + decay * m.v[used]
            for p, grad, (a, c), rowset in ((b, np.array([g.sum()]), state[0], slice(None)), (m.w, gw, state[1], used), (m.v, gv, state[2], used)):
                a[rowset] = 0.9 * a[rowset] + 0.1 * grad
                c[rowset] = 0.999 * c[rowset] + 0.001 * grad * grad
                p[rowset] -= rate * (a[rowset] / (1 - 0.9**step)) / (np.sqrt(c[rowset] / (1 - 0.999**step)) + 1e-8)
    m.bias = float(b[0])
    return m


def held_out(key: Column) -> Column:
    """The fold that training never sees: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int, sample_bytes: int, key: str, text: str, size: str, label: str) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(slots, values, label) of the sample, in the order of a hash of the ids: bounded in rows and in bytes."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key)))
    known = known.groupBy(F.col(key).alias("key_")).agg(F.avg(F.col(label).cast("double")).alias("label_"))
    there = docs.select(docs[key].alias("key_")).distinct()
    chosen = known.join(there, "key_", "left_semi").orderBy(F.xxhash64("key_"), "key_").limit(sample)
    n_chars = docs[size].cast("long") if size in docs.columns else F.lit(None).cast("long")
    rows = docs.select(docs[key].alias("key_"), F.struct(F.xxhash64(docs[text].cast("string")).alias("hash"), docs[text].cast("string").alias("text"), n_chars.alias("n")).alias("row_"))
    # at most `sample` ids are sent
    one = rows.join(F.broadcast(chosen), "key_").groupBy("key_", "label_").agg(F.min("row_").alias("row_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Featurizer()
        for batch in batches:
            out = [f(t, n) for t, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            idx, value = pa.array([i.astype(np.int32).tobytes() for i, _ in out], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in out], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), idx, value], ["place", "label", "idx", "value"])

    made = one.select(F.struct(F.xxhash64("key_").alias("h"), F.col("key_").cast("string").alias("k")).cast("string").alias("place"), "label_", "row_.text", "row_.n")
    scratch = Scratch(docs.sparkSession, "fm")
    made = scratch.save(made.mapInArrow(run, "place string, label double, idx binary, value binary"), "rows")
    taken, used = [], 0
    for place, n in sorted(tuple(r) for r in made.select("place", (F.octet_length("idx") + F.octet_length("value")).alias("n")).collect()):  # `sample` rows
        used += n
        if used > sample_bytes:
            break
        taken.append(place)
    got = made.where(F.col("place") <= taken[-1]).collect() if taken else []
    scratch.drop()
    got.sort(key=lambda r: r["place"])
    return [(np.frombuffer(r["idx"], np.int32).astype(np.int64), np.frombuffer(r["value"], np.float32).astype(np.float64), r["label"]) for r in got]


def train(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", size: str = "n_chars", label: str = "quality", sample_bytes: int = SAMPLE_BYTES
) -> Machine:
    """A machine fitted on at most `sample` labelled documents outside the held-out fold."""
    rows = training_rows(docs, labels, sample, sample_bytes, key, text, size, label)
    return fit([(i, v) for i, v, _ in rows], np.array([y for _, _, y in rows], float))


def score(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text", size: str = "n_chars") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    n_chars = docs[size].cast("long") if size in docs.columns else F.lit(None).cast("long")
    narrow = docs.select(docs[key].alias("key_"), held_out(docs[key]).alias("held_"), docs[text].cast("string").alias("text_"), n_chars.alias("n_"))
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Featurizer()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                s = [sent.value.score(*f(t.as_py(), n.as_py())) for t, n in zip(part.column(2), part.column(3), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], [key, "held_out", "score", "predicted"]
                )

    kind = dict(narrow.dtypes)["key_"]
    return narrow.mapInArrow(run, f"{key} {kind}, held_out boolean, score double, predicted int")
