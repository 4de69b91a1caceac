"""Near-duplicate detection: SetSketch registers, banding, a joint likelihood estimate, and exact verification.

1.  Every text becomes a set of 5-word shingles, the registers of its sketch and a digest of the set; rows with equal
    sets form one class, a node of the graph of links.
2.  Runs of registers are bands.  Their number follows from the threshold so that a pair on the threshold shares no
    band with probability MISS at most.  Classes that share a band value form a bucket.
3.  Each bucket has a leader, by one of LEADERS orders of the nodes; members are held against their leaders only.  Pairs
    whose similarity, estimated by joint maximum likelihood from the registers, lies Z standard deviations under the
    threshold are left out; the others are verified on their full shingle sets, and confirmed links give components.
4.  What this can have lost are links within a bucket between different components.  In buckets that still hold several
    components, the members outside the largest one meet all other members, in blocks of bounded size: first by their
    registers alone; only what is left then gets its texts and is judged on the full sets, unless joined meanwhile.
    After that every pair of a bucket has been judged, or its ends are connected anyway.  No step lists the pairs of a
    group, and no group passes through one task: hot buckets, leaders, hubs and equal sets are dealt to many.

Defined results
  null or empty text   n_shingles 0, linked with nothing, a component of its own, kept
  fewer than 5 words   one shingle, the whole sequence; equal sequences are linked
  very long texts      sets are sorted arrays of 64-bit hashes; registers need memory for one block of 512 hashes
  ties                 the least id that can be reached is a component's id; the row of the least id (then of the least
                       hash of its text) represents a group in `keep_one`
  repeated ids         rows that share an id are one document of `components_of`: what any of them is linked with has
                       one component.  `keep_one` goes by texts instead: a row goes only if a text that its own is
                       linked with stays, whatever other texts have its id
  repeated rows        share their component; `keep_one` keeps one of the rows that agree in id and text
  null ids             linked like others; their component is the least id that can be reached, or null if there is none,
                       and they count as kept where it is null
  empty table          no rows
  extra columns        `components_of` returns its own columns only; `keep_one` returns its input's columns unchanged
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hot_bound, join_unique
from .components import components
from .setsketch import SetSketch
from .shingles import Shingler, mix, shared

ROWS = 5
MISS = 1e-9
Z = 5.0
BLOCK = 512
#: Orders of the ids among which bands choose their leaders: a member is held against so many leaders of a group, not
#: against one in every band.
LEADERS = 8
#: Pairs of one leader that meet its text in one task.
PAIRS = 256


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands of `rows` registers needed for a pair on the threshold to share one, but for probability `miss`."""
    return max(1, math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** rows)))) if percent < 100 else 1


def slack(percent: int, m: int) -> float:
    t = percent / 100
    return Z * math.sqrt(max(t * (1 - t), 0.01) / m)


def _slices(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, n):
            yield batch.slice(start, n)


def sketches(docs: DataFrame, m: int, k: int = 5) -> DataFrame:
    """(doc_id, text_hash, n_shingles, set_key, registers); set_key and registers are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sketch = Shingler(k), SetSketch(m)
        for part in _slices(batches, 512):
            n, key, regs = [], [], []
            for text in part.column(2):
                s = shingler.distinct(text.as_py())
                n.append(len(s))
                key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                regs.append(sketch.registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(regs, pa.binary())],
                ["doc_id", "text_hash", "n_shingles", "set_key", "registers"],
            )

    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, "doc_id long, text_hash long, n_shingles long, set_key binary, registers binary")


def band_rows(nodes: DataFrame, bands: int, rows: int = ROWS) -> DataFrame:
    """(band, bucket, node): one row for each band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, 4096):
            if not part.num_rows:
                continue
            regs = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(part.num_rows, -1)[:, : bands * rows]
            x = regs.reshape(part.num_rows, bands, rows).astype(np.uint64)
            h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), x.shape[:2]).copy()
            for j in range(rows):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + x[:, :, j])
            ids = np.repeat(part.column(0).to_numpy(), bands)
            band = np.tile(np.arange(bands, dtype=np.int32), part.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(band), pa.array(h.reshape(-1).view(np.int64)), pa.array(ids)], ["band", "bucket", "node"])

    return nodes.select("node", "registers").mapInArrow(run, "band int, bucket long, node long")


def beside_leader(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """pairs(a, b, ways) with what `table` holds of a: a leader of many pairs is copied to `ways` tasks."""
    dealt = pairs.withColumn("chunk", F.pmod(F.xxhash64("b"), F.col("ways")))
    copies = dealt.select("a", "ways", "chunk").distinct().join(table, "a")
    return dealt.join(copies, ["a", "ways", "chunk"])


def likely(pairs: DataFrame, nodes: DataFrame, percent: int, m: int) -> DataFrame:
    """The pairs (a, b, ways) whose joint estimate does not lie clearly under the threshold."""
    least, t = percent / 100 - slack(percent, m), percent / 100
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("registers").alias(f"r{c}"))
    both = beside_leader(pairs, side("a")).join(side("b"), "b").where(F.least("na", "nb") >= t * F.greatest("na", "nb") - 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = SetSketch(m)
        for part in _slices(batches, 2048):
            if part.num_rows:
                ra, rb = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(part.num_rows, m) for c in (5, 6))
                na, nb = (part.column(c).to_numpy().astype(float) for c in (3, 4))
                ok = pa.array(sketch.similarity(ra, rb, na, nb) >= least)
                yield pa.RecordBatch.from_arrays([part.column(c).filter(ok) for c in range(3)], ["a", "b", "ways"])

    return both.select("a", "b", "ways", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long, ways int")


def verified(pairs: DataFrame, texts: DataFrame, percent: int, k: int = 5) -> DataFrame:
    """The pairs (a, b) with 100 * |A and B| >= percent * |A or B| on the full shingle sets, with those two sizes."""
    with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    both = beside_leader(with_b, texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))).select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        last, left = None, np.zeros(0, np.uint64)
        for part in _slices(batches, 256):
            rows: list[tuple[int, int, int, int]] = []
            for a, b, ta, tb in zip(*(part.column(c).to_pylist() for c in range(4)), strict=True):
                if a != last:  # the join leaves the pairs of a leader together
                    last, left = a, shingler.distinct(ta)
                right = shingler.distinct(tb)
                both_ = shared(left, right)
                union = len(left) + len(right) - both_
                if union and 100 * both_ >= percent * union:
                    rows.append((a, b, both_, union))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "n_both", "n_union"])

    return both.mapInArrow(run, "a long, b long, n_both long, n_union long")


_MEMBER = "bucket long, band int, block int, guest boolean, visits boolean, node long, component long, n_shingles long"


def dealt_members(members: DataFrame) -> DataFrame:
    """Members of buckets as residents of one block each and, where they visit, as guests of all the other blocks.

    members: (band, bucket, node, component, n_shingles, registers, visits, blocks).
    """
    home = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    place = F.when(
        F.col("visits"),
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(x.alias("block"), (x == home).alias("lives"))),
    ).otherwise(F.array(F.struct(home.alias("block"), F.lit(True).alias("lives"))))
    return members.withColumn("place", F.explode(place)).select(
        "bucket", "band", "place.block", (~F.col("place.lives")).alias("guest"), "visits", "node", "component", "n_shingles", "registers"
    )


class Block:
    """The residents of one block of a bucket, what meets them, and what has been joined among them."""

    def __init__(self, band: int, sketch: SetSketch, percent: int, rows: int):
        self.band, self.sketch, self.percent, self.width = band, sketch, percent, rows
        self.least = percent / 100 - slack(percent, sketch.m)
        self.rows: list[tuple] = []
        self.parent: dict[int, int] = {}
        self.sets: dict[int, np.ndarray] = {}

    def root(self, c: int) -> int:
        while (up := self.parent.get(c, c)) != c:
            self.parent[c] = self.parent.get(up, up)
            c = up
        return c

    def seal(self) -> None:
        """All residents are there; each is (visits, node, component, n_shingles, registers, text)."""
        r = self.rows
        self.visits = np.array([x[0] for x in r], bool)
        self.ids, self.comp = np.array([x[1] for x in r], np.int64), np.array([x[2] for x in r], np.int64)
        self.n = np.array([x[3] for x in r], float)
        self.regs = np.frombuffer(b"".join([x[4] for x in r]), np.uint16).reshape(len(r), self.sketch.m)

    def near(self, g: tuple, within: bool) -> list[int]:
        """The residents that a visitor may be linked with, by sizes and registers, in the first band they share."""
        t = self.percent / 100
        # two visitors both meet in the other's home: the home of the lesser node, or the common home, judges them
        ok = ~self.visits | ((self.ids > g[1]) if within else (self.ids < g[1]))
        ok &= (np.minimum(self.n, g[3]) >= t * np.maximum(self.n, g[3]) - 1e-9) & (self.comp != g[2])
        at = np.nonzero(ok)[0]
        mine = np.frombuffer(g[4], np.uint16)
        if self.band and len(at):
            same = (self.regs[at, : self.band * self.width] == mine[: self.band * self.width]).reshape(len(at), self.band, self.width)
            at = at[~same.all(axis=2).any(axis=1)]
        if not len(at):
            return []
        est = self.sketch.similarity(self.regs[at], np.broadcast_to(mine, (len(at), self.sketch.m)), self.n[at], np.full(len(at), float(g[3])))
        keep = est >= self.least
        return at[keep][np.argsort(-est[keep], kind="stable")].tolist()

    def links(self, g: tuple, within: bool, shingler: Shingler) -> Iterator[tuple[int, int]]:
        right = None
        for i in self.near(g, within):
            x = self.rows[i]
            a, b = self.root(x[2]), self.root(g[2])
            if a == b:
                continue
            if right is None:
                right = shingler.distinct(g[5])
            if i not in self.sets:
                self.sets[i] = shingler.distinct(x[5])
            both = shared(self.sets[i], right)
            if 100 * both >= self.percent * (len(self.sets[i]) + len(right) - both):
                self.parent[max(a, b)] = min(a, b)
                yield min(x[2], g[2]), max(x[2], g[2])


def _blocks(batches: Iterator[pa.RecordBatch], open_block) -> Iterator[tuple[tuple, Block, tuple | None, bool]]:
    """(place, block, visitor, whether it lives there) in order; the residents of a block come before its guests.

    After a block's last visitor comes one None for it.
    """
    group, block, sealed = None, None, False

    def visitors() -> Iterator[tuple]:
        for x in block.rows:
            if x[0]:
                yield group, block, x, True

    for part in _slices(batches, 512):
        for bucket, band, place, guest, *rest in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if (bucket, band, place) != group:
                if block is not None:
                    if not sealed:
                        block.seal()
                    yield from visitors()
                    yield group, block, None, True
                group, block, sealed = (bucket, band, place), open_block(band), False
            if not guest:
                block.rows.append(tuple(rest))
            elif block.rows:
                if not sealed:
                    block.seal()
                    sealed = True
                yield group, block, tuple(rest), False
    if block is not None:
        if not sealed:
            block.seal()
        yield from visitors()
        yield group, block, None, True


def sieved(dealt: DataFrame, percent: int, m: int, rows: int = ROWS) -> DataFrame:
    """Those of the dealt members that registers alone don't keep from being linked with another one in their block."""
    dealt = dealt.repartition("bucket", "band", "block").sortWithinPartitions("bucket", "band", "block", "guest")
    types = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
    names = [c.split(" ")[0] for c in _MEMBER.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = SetSketch(m)
        met: set[int] = set()
        out: list[tuple] = []
        for place, block, g, lives in _blocks(batches, lambda band: Block(band, sketch, percent, rows)):
            if g is None:
                out += [(*place, False, *block.rows[i][:4]) for i in sorted(met)]
                met = set()
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                    out = []
            elif at := block.near(g, lives):
                met.update(at)
                if lives:
                    met.add(int(np.nonzero(block.ids == g[1])[0][0]))
                else:
                    out.append((*place, True, *g[:4]))
        cols = list(zip(*out, strict=True)) or [()] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return dealt.mapInArrow(run, _MEMBER)


def residual_links(left: DataFrame, percent: int, m: int, rows: int = ROWS, k: int = 5) -> DataFrame:
    """Pairs of components (a, b) that a verified link joins, as many as are needed to join what is connected.

    left: sieved members with registers and text.  Within a block a pair is judged in the first band it shares only:
    by sizes, then registers, then, unless its ends have been joined meanwhile, on the full sets.
    """
    names = [c.split(" ")[0] for c in _MEMBER.split(", ")]
    dealt = left.select(*names, "registers", "text").repartition("bucket", "band", "block").sortWithinPartitions("bucket", "band", "block", "guest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, shingler = SetSketch(m), Shingler(k)
        found: list[tuple[int, int]] = []
        for _, block, g, lives in _blocks(batches, lambda band: Block(band, sketch, percent, rows)):
            if g is None:
                cols = list(zip(*found, strict=True)) or [()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])
                found = []
            else:
                found += block.links(g, lives, shingler)

    return dealt.mapInArrow(run, "a long, b long")


def _narrow(docs: DataFrame, key: str, text: str) -> DataFrame:
    t = docs[text].cast("string")
    return docs.select(docs[key].cast("long").alias("doc_id"), t.alias("text"), F.xxhash64(t).alias("text_hash"))


def _classes(docs: DataFrame, percent: int, k: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The sketches of (doc_id, text, text_hash), and (set_key, first, rows, comp) for each set: its least row, how many
    rows have it, and a number for the sets it is linked with, directly or not."""
    bands = bands_for(percent)
    m = bands * ROWS
    sk = scratch.save(sketches(docs, m, k), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    sets = sk.where("set_key IS NOT NULL").groupBy("set_key").agg(first, F.count("*").alias("rows"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
    # the number of a class is settled by being stored
    nodes = scratch.save(sets.withColumn("node", F.monotonically_increasing_id()), "nodes")
    bound = hot_bound(nodes.count() * bands)

    rows = band_rows(nodes, bands)
    order = F.struct(F.xxhash64(F.col("band") % LEADERS, "node").alias("h"), F.col("node").alias("id"))
    buckets = scratch.save(rows.groupBy("bucket", "band").agg(F.count("*").alias("n"), F.min(order)["id"].alias("leader")).where("n > 1"), "buckets")
    members = join_unique(rows, buckets, buckets.where(F.col("n") > bound), ["bucket", "band"], ["node"]).where("n IS NOT NULL")
    members = scratch.save(members, "members")
    scratch.drop("buckets")

    involved = scratch.save(members.select("node").distinct(), "involved")
    near = nodes.select("node", "n_shingles", "registers").join(involved, "node", "left_semi")
    wanted = nodes.join(involved, "node", "left_semi").select("node", F.struct("first.doc_id", "first.text_hash").alias("who"))
    texts = docs.select(F.struct("doc_id", "text_hash").alias("who"), "text").join(wanted, "who").dropDuplicates(["who"]).select("node", "text")
    texts = scratch.save(texts, "texts")
    ends = members.where("node <> leader").groupBy(F.least("leader", "node").alias("x"), F.greatest("leader", "node").alias("y")).agg(F.max("n").alias("n"), F.min("leader").alias("a"))
    ways = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("n") / PAIRS, F.lit(1.0))))).cast("int")
    star = scratch.save(ends.select("a", F.when(F.col("a") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("b"), ways.alias("ways")), "star")
    tried = scratch.save(likely(star, near, percent, m), "tried")
    found = components(scratch.save(verified(tried, texts, percent, k), "links"), scratch, "star-labels")

    held = members.where("n > 2").join(found.withColumnRenamed("node", "node_"), F.col("node") == F.col("node_"), "left").drop("node_")
    held = scratch.save(held.select("bucket", "band", "node", "n", F.coalesce("component", "node").alias("component")), "held")
    scratch.drop("members")
    # members and the largest component of each bucket; a bucket of one component is done
    sizes = held.groupBy("bucket", "band", "component").agg(F.count("*").alias("c"), F.max("n").alias("n"))
    largest = sizes.groupBy("bucket", "band").agg(F.count("*").alias("parts"), F.max(F.struct("c", "component"))["component"].alias("main"), F.max("n").alias("size")).where("parts > 1")
    largest = scratch.save(largest.drop("parts"), "largest")
    rest = join_unique(held, largest, largest.where(F.col("size") > bound), ["bucket", "band"], ["node"]).where("main IS NOT NULL").join(near, "node").select(
        "bucket", "band", "node", "component", "n_shingles", "registers",
        (F.col("component") != F.col("main")).alias("visits"),
        F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"),
    )
    left = scratch.save(sieved(dealt_members(rest), percent, m), "sieved")
    left = left.join(near.select("node", "registers"), "node").join(texts, "node")
    # what the leftover links join are components; only those few are spread over again
    joined = components(scratch.save(residual_links(left, percent, m, k=k), "more"), scratch, "joined")
    scratch.drop("held")
    upper = joined.select(F.col("node").alias("component"), F.col("component").alias("upper"))
    merged = join_unique(found, upper, upper.join(F.broadcast(_popular(found, "component", bound)), "component", "left_semi"), ["component"], ["node"])
    final = merged.select("node", F.coalesce("upper", "component").alias("comp"))
    lone = joined.join(found.select(F.col("component").alias("node")).distinct(), "node", "left_anti")
    final = scratch.save(final.union(lone.select("node", "component")), "components")
    classes = nodes.select("set_key", "first", "rows", "node").join(final, "node", "left").select("set_key", "first", "rows", F.coalesce("comp", "node").alias("comp"))
    classes = scratch.save(classes, "classes")
    scratch.keep("sketches", "classes")
    return sk, classes


def _popular(rows: DataFrame, key: str, bound: int) -> DataFrame:
    return rows.groupBy(key).count().where(F.col("count") > bound).select(key)


def _same_ids(sk: DataFrame, classes: DataFrame, repeated: DataFrame, bound: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """`classes` with components joined where one id has texts of several, and (doc_id, comp) of the repeated ids."""
    rows = join_unique(sk.where("set_key IS NOT NULL").select("doc_id", "set_key"), repeated, repeated.where(F.col("n") > bound), ["doc_id"], ["set_key"])
    pairs = scratch.save(rows.where("n IS NOT NULL").select("doc_id", "set_key").distinct(), "id-sets")
    comps = classes.select("set_key", "comp")
    many = comps.join(F.broadcast(_popular(pairs, "set_key", bound)), "set_key", "left_semi")
    held = scratch.save(join_unique(pairs, comps, many, ["set_key"], ["doc_id"]).select("doc_id", "comp").distinct(), "id-comps")
    lead = scratch.save(held.groupBy("doc_id").agg(F.min("comp").alias("lead"), F.count("*").alias("n")), "id-leads")
    edges = join_unique(held, lead, lead.where(F.col("n") > bound), ["doc_id"], ["comp"]).select(F.col("comp").alias("a"), F.col("lead").alias("b")).distinct()
    joined = components(scratch.save(edges, "id-links"), scratch, "ids").select(F.col("node").alias("comp"), F.col("component").alias("upper"))
    whole = join_unique(classes, joined, joined.join(F.broadcast(_popular(classes, "comp", bound)), "comp", "left_semi"), ["comp"], ["set_key"])
    classes = scratch.save(whole.select("set_key", "first", "rows", F.coalesce("upper", "comp").alias("comp")), "id-classes")
    leads = lead.select("doc_id", F.col("lead").alias("comp")).join(joined, "comp", "left").select("doc_id", F.coalesce("upper", "comp").alias("comp"))
    return classes, leads


def components_of(docs: DataFrame, percent: int = 80, key: str = "doc_id", text: str = "text", k: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row: links are similarities of `percent` or more."""
    scratch = Scratch(docs.sparkSession, "near")
    sk, classes = _classes(_narrow(docs, key, text), percent, k, scratch)
    total = sk.count()
    bound = hot_bound(total)
    repeated = scratch.save(sk.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    leads = None
    if not repeated.isEmpty():
        classes, leads = _same_ids(sk, classes, repeated, bound, scratch)
    least = classes.groupBy("comp").agg(F.min("first.doc_id").alias("component_id"), F.count("*").alias("n"))
    least = scratch.save(least, "least")
    labels = join_unique(classes.select("set_key", "rows", "comp"), least.drop("n"), least.where(F.col("n") > bound).drop("n"), ["comp"], ["set_key"])
    labels = scratch.save(labels.select("set_key", "rows", "component_id"), "labels")
    own = sk.where("set_key IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    if leads is not None:  # a row without words beside one that has some
        of_id = scratch.save(leads.join(least.drop("n"), "comp").select(F.col("doc_id").alias("id_"), F.col("component_id").alias("of_id")), "of-id")
        own = own.join(of_id, F.col("doc_id") == F.col("id_"), "left").select("doc_id", "n_shingles", F.coalesce("of_id", "component_id").alias("component_id"))
    scratch.keep("sketches", "labels", "of-id")
    rows = sk.where("set_key IS NOT NULL").select("doc_id", "text_hash", "n_shingles", "set_key")
    full = join_unique(rows, labels.drop("rows"), labels.where(F.col("rows") > bound).drop("rows"), ["set_key"], ["doc_id", "text_hash"])
    out = full.select("doc_id", "n_shingles", "component_id").union(own)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def keep_one(docs: DataFrame, percent: int = 80, key: str = "doc_id", text: str = "text", k: int = 5) -> DataFrame:
    """The rows of `docs`, columns unchanged, one of each group of linked texts: the one of the least id, then hash."""
    scratch = Scratch(docs.sparkSession, "keep")
    narrow = _narrow(docs, key, text)
    sk, classes = _classes(narrow, percent, k, scratch)
    bound = hot_bound(sk.count())
    winner = scratch.save(classes.groupBy("comp").agg(F.min("first").alias("first_"), F.count("*").alias("n")), "winners")
    labels = join_unique(classes.select("set_key", "rows", "comp"), winner.drop("n"), winner.where(F.col("n") > bound).drop("n"), ["comp"], ["set_key"])
    labels = scratch.save(labels.select("set_key", "rows", F.struct("first_.doc_id", "first_.text_hash").alias("winner")), "labels")
    rows = sk.select("doc_id", "text_hash", "set_key")
    judged = join_unique(rows, labels.drop("rows"), labels.where(F.col("rows") > bound).drop("rows"), ["set_key"], ["doc_id", "text_hash"])
    who = F.struct("doc_id", "text_hash")
    judged = judged.select(who.alias("who__"), F.col("set_key").isNull().alias("free"), (who == F.col("winner")).alias("wins"))
    judged = scratch.save(judged.select("who__", (F.col("free") | F.col("wins")).alias("stays")).groupBy("who__", "stays").agg(F.count("*").alias("n")), "judged")
    gone = judged.where(~F.col("stays")).select("who__")
    several = judged.where("stays AND n > 1").select("who__")
    scratch.keep("judged")
    t = docs[text].cast("string")
    named = docs.select("*", F.struct(docs[key].cast("long").alias("doc_id"), F.xxhash64(t).alias("text_hash")).alias("who__"))
    kept = named.join(gone, "who__", "left_anti")
    if not several.isEmpty():
        kept = kept.join(several, "who__", "left_anti").unionByName(kept.join(several, "who__", "left_semi").dropDuplicates(["who__"]))
    return kept.select(*docs.columns)
