"""Benchmark decontamination: a size-partitioned MinHash containment search for short items inside long documents.

Items are partitioned by the size of their shingle sets into classes [2^c, 2^(c+1)), each with a table of its own.  An
item's sketch holds its least MinHash values, as many as its class asks for: with U the largest size of the class and t
the threshold, U - ceil(t U) + 1.  At most that number less one of an item's shingles can be missing from a document
that contains t of them, so such a document holds at least one sketch value.  A document is searched class by class
with its own MinHash values up to the largest one in the class's table, so no candidate is lost whatever the
document's length.  Candidates are then verified by exact containment, word by word.

Documents are read once, in place, and never shuffled.  The benchmark is cut into blocks of BLOCK_BYTES of text, which
lie as files in the shared folder: the driver makes one at a time, and a task holds one at a time.  One block is
loaded once; of several, each is loaded once for every DOCS_BYTES of documents.  A block takes about five times its
text in memory, as shingles of candidates are made when they are needed and SETS_KEPT of them are kept.  Items equal in
id and text are one item with a number of copies, so no block grows with them.

Defined results
  null or empty text   neither contains nor is contained
  fewer than 5 words   an item is one shingle, its whole sequence, and is found in a document of that very sequence
  very long texts      hashed in numpy from their words; memory grows with one document
  null ids             rows and items like others
  ties, repeated rows  every (document row, item) pair stands for itself; equal rows give equal rows
  empty tables         no benchmark or no documents: no rows, and `keep_clean` keeps all
  extra columns        `contaminated` returns its own columns only; `keep_clean` returns its input's columns unchanged
"""

from __future__ import annotations

import math
import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, file_system
from .shingles import Shingler

BLOCK_BYTES = 16 << 20
DOCS_BYTES = 32 << 20
SETS_KEPT = 1000
#: Rows that one match with repeated items becomes at a time.
COPIES = 10_000


def sketch_size(n: int, percent: int) -> int:
    """Values in the sketch of an item of n shingles: the pigeonhole bound of its size class."""
    upper = 2 ** (n.bit_length()) - 1
    return min(n, upper - math.ceil(percent * upper / 100) + 1)


class ItemBlock:
    """A block of items: their words, and for each class of sizes a sorted table of sketch values with their owners."""

    def __init__(self, items: list[tuple[int | None, str, int]], percent: int, k: int = 5):
        self.percent, self.k = percent, k
        shingler = Shingler(k)
        self.items: list[tuple[int | None, bytes, int]] = []
        values: dict[int, list[np.ndarray]] = defaultdict(list)
        owners: dict[int, list[np.ndarray]] = defaultdict(list)
        for item_id, text, copies in items:
            ws = shingler.words(text)
            if not ws:
                continue
            hashes = np.unique(shingler.sequence(ws))
            low = hashes[: sketch_size(len(hashes), percent)]
            size_class = len(hashes).bit_length()
            owners[size_class].append(np.full(len(low), len(self.items), np.int32))
            values[size_class].append(low)
            self.items.append((item_id, b" ".join(ws), copies))
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        for c in sorted(values):
            flat, own = np.concatenate(values[c]), np.concatenate(owners[c])
            order = np.argsort(flat, kind="stable")
            self.tables.append((flat[order], own[order]))
        self.sets: dict[int, frozenset[tuple[bytes, ...]]] = {}

    def shingles(self, ws: list[bytes]) -> frozenset[tuple[bytes, ...]]:
        width = min(self.k, len(ws))
        return frozenset(tuple(ws[i : i + width]) for i in range(len(ws) - width + 1))

    def wanted(self, o: int) -> frozenset[tuple[bytes, ...]]:
        if (found := self.sets.get(o)) is None:
            if len(self.sets) >= SETS_KEPT:
                self.sets.clear()
            found = self.sets[o] = self.shingles(self.items[o][1].split(b" "))
        return found

    def candidates(self, hashes: np.ndarray) -> list[int]:
        """The items that share a sketch value with a document of these sorted distinct hashes."""
        found: set[int] = set()
        for values, owners in self.tables:
            kept = hashes[: np.searchsorted(hashes, values[-1], "right")]
            if not len(kept):
                continue
            if len(kept) < len(values):
                lo, hi = np.searchsorted(values, kept, "left"), np.searchsorted(values, kept, "right")
                for a, b in zip(lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                    found.update(owners[a:b].tolist())
            else:
                at = np.minimum(np.searchsorted(kept, values), len(kept) - 1)
                found.update(owners[kept[at] == values].tolist())
        return sorted(found)

    def search(self, shingler: Shingler, text: str | None) -> list[tuple[int | None, int, int, int]]:
        """(item_id, shared, size, copies) for each item contained in the text."""
        ws = shingler.words(text)
        if not ws or not self.tables:
            return []
        found = self.candidates(np.unique(shingler.sequence(ws)))
        if not found:
            return []
        own, out = self.shingles(ws), []
        for o in found:
            want = self.wanted(o)
            both = len(want & own)
            if 100 * both >= self.percent * len(want):
                out.append((self.items[o][0], both, len(want), self.items[o][2]))
        return out


def write_blocks(benchmark: DataFrame, percent: int, key: str, text: str, k: int, block_bytes: int) -> list[str]:
    """The benchmark as files of blocks of about `block_bytes` of text; one at a time comes to the driver."""
    scratch = Scratch(benchmark.sparkSession, "items")
    items = benchmark.select(benchmark[key].cast("long").alias("key_"), benchmark[text].cast("string").alias("text_")).where("text_ IS NOT NULL")
    items = scratch.save(items.groupBy("key_", "text_").agg(F.count("*").alias("copies")), "distinct")
    total = items.agg(F.sum(F.octet_length("text_"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    place = F.pmod(F.xxhash64("key_", "text_"), F.lit(n))
    system, root = file_system(scratch.root)
    for b in range(n):
        rows = (items.where(place == b) if n > 1 else items).collect()
        with system.open_output_stream(f"{root}/{b}", compression=None) as out:
            out.write(pickle.dumps(ItemBlock([tuple(r) for r in rows], percent, k), protocol=5))
    scratch.drop("distinct")
    return [scratch.path(str(b)) for b in range(n)]


def read_block(path: str) -> ItemBlock:
    system, root = file_system(path)
    with system.open_input_stream(root, compression=None) as f:
        return pickle.loads(f.read())


def _matches(paths: list[str], k: int, at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[tuple[int | None, int, int, int]]]]]:
    """Batches with what each of their texts contains; documents wait in DOCS_BYTES for several blocks."""
    shingler = Shingler(k)
    only = read_block(paths[0]) if len(paths) == 1 else None
    held: list[pa.RecordBatch] = []

    def search() -> Iterator[tuple[pa.RecordBatch, list]]:
        found: list[list[list]] = [[[] for _ in range(b.num_rows)] for b in held]
        for path in paths:
            block = only or read_block(path)
            for b, rows in zip(held, found, strict=True):
                for row, t in zip(rows, b.column(at), strict=True):
                    row += block.search(shingler, t.as_py())
        yield from zip(held, found, strict=True)

    for batch in batches:
        held.append(batch)
        if only or sum(b.nbytes for b in held) >= DOCS_BYTES:
            yield from search()
            held = []
    if held:
        yield from search()


def contaminated(
    docs: DataFrame, benchmark: DataFrame, percent: int = 80, key: str = "doc_id", item: str = "item_id", text: str = "text", k: int = 5, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item): documents that hold `percent` or more of an item's distinct shingles."""
    paths = write_blocks(benchmark, percent, item, text, k, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _matches(paths, k, 1, batches):
            rows = [(d, *m) for d, ms in zip(batch.column(0).to_pylist(), found, strict=True) for m in ms]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "n_shared", "n_item", "copies"])

    out = docs.select(docs[key].cast("long"), docs[text].cast("string")).mapInArrow(run, "doc_id long, item_id long, n_shared long, n_item long, copies long")
    # a match with an item of many copies is repeated in slices of bounded length
    out = out.withColumn("slice_", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES)))).withColumn("copy_", F.explode(F.sequence(F.lit(1), F.least(F.lit(COPIES), F.col("copies") - F.col("slice_") * COPIES))))
    return out.select(F.col("doc_id").alias(key), F.col("item_id").alias(item), "n_shared", "n_item")


def keep_clean(docs: DataFrame, benchmark: DataFrame, percent: int = 80, text: str = "text", k: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `docs`, columns unchanged, that contain no item; rows are judged where they lie, without a join."""
    at = docs.columns.index(text)
    paths = write_blocks(benchmark, percent, "item_id", text, k, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _matches(paths, k, at, batches):
            yield batch.filter(pa.array([not m for m in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
