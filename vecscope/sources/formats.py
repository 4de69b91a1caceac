"""Binary vector and graph files as a Spark data source, "vecfiles".

    spark.dataSource.register(VecFiles)
    spark.read.format("vecfiles").option("kind", "fvecs").load(path)

All numbers are little-endian.  Files of fixed stride are cut into byte ranges, one task each; ragged graph files are
read by one task, record by record.  A folder stands for its files in order of their names, numbered on.

kind        layout                                                        columns
fvecs ivecs each row: int32 d, d numbers                                  vec_id, v
fbin ibin   int32 n, int32 d, then numbers; i8bin the same with int8      vec_id, v
raw_f raw_i numbers only, one for each row                                vec_id, value
knng        ivecs rows as a graph, option "degree" takes the first so many  src, pos, dst
padded      ibin rows as a graph, -1 is no neighbour                      src, pos, dst
adj         each node: uint32 count, ids                                  src, pos, dst
adj_entry   uint32 width, uint32 entry, then as adj                       src, pos, dst
adj64       each node: uint64 count, uint64 ids                           src, pos, dst
ended       each node: ids, then -1                                       src, pos, dst
layered     13 header fields, a slab for level 0, lists of upper levels   level, src, pos, dst
weighted    u8 metric, u16 dim, u32 n, u8 degree; each node: vector, ids, weights, label  src, pos, dst, weight
codebook    int32 M, int32 Ks, int32 length, floats                       vec_id, v

Writers take (key, value) rows: vectors, numbers, or (src, ids) lists; layered takes (src, vector, levels), the lists of
each level from 0 on, weighted takes (src, vector, ids, weights).  adj_entry, layered and weighted have one header for
the whole file, so they are one file, written by one task.  A write lies in drafts until the job commits, and what it
overwrites goes only then.

Options: "rows" keeps the first so many rows, "dims" the first so many numbers of each; "entry" and "width" are what the headers of adj_entry and layered say.  `kind_of` tells the kind from a file's name.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

VECTOR = {"fvecs": "<f4", "ivecs": "<i4", "fbin": "<f4", "ibin": "<i4", "i8bin": "<i1"}
SQL_TYPE = {"<f4": "float", "<i4": "int", "<i1": "tinyint"}
RAW = {"raw_f": "<f4", "raw_i": "<i4"}
RANGE_BYTES = 64 << 20


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def files(path: str) -> list[str]:
    system, root = file_system(path)
    if system.get_file_info(root).type == fs.FileType.Directory:
        found = system.get_file_info(fs.FileSelector(root))
        return sorted(f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))
    return [root]


@dataclass
class Piece(InputPartition):
    """Rows [first, first + n) of a file, whose numbers start at `number`."""

    file: str
    first: int
    n: int
    number: int
    width: int

    def __init__(self, file: str, first: int, n: int, number: int, width: int):
        super().__init__(file)
        self.file, self.first, self.n, self.number, self.width = file, first, n, number, width


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.kind, self.path = options["kind"], options["path"]
        self.rows = int(options["rows"]) if "rows" in options else None
        self.dims = int(options["dims"]) if "dims" in options else None
        self.degree = int(options["degree"]) if "degree" in options else None

    def _shape(self, f: pa.NativeFile, size: int) -> tuple[int, int, int]:
        """(rows, numbers in a row, bytes of a row) of a file of fixed stride."""
        kind = {"knng": "ivecs", "padded": "ibin"}.get(self.kind, self.kind)
        if kind in RAW:
            return size // 4, 1, 4
        if kind in ("fvecs", "ivecs"):
            d = struct.unpack("<i", f.read_at(4, 0))[0] if size else 0
            return (size // (4 + 4 * d) if size else 0), d, 4 + 4 * d
        if kind == "codebook":
            m, ks, length = struct.unpack("<3i", f.read_at(12, 0))
            return m * ks, length, 4 * length
        n, d = struct.unpack("<2i", f.read_at(8, 0))
        return n, d, d * np.dtype(VECTOR[kind]).itemsize

    def partitions(self) -> list[InputPartition]:
        system, _ = file_system(self.path)
        out, number = [], 0
        for name in files(self.path):
            if self.kind in ("adj", "adj_entry", "adj64", "ended", "layered", "weighted"):
                out.append(Piece(name, 0, -1, 0, 0))
                continue
            with system.open_input_file(name) as f:
                n, width, stride = self._shape(f, f.size())
            keep = n if self.rows is None else max(0, min(n, self.rows - number))
            step = max(1, RANGE_BYTES // max(1, stride))
            out += [Piece(name, a, min(step, keep - a), number + a, width) for a in range(0, keep, step)]
            number += n
        return out or [Piece("", 0, 0, 0, 0)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if not piece.file:
            return
        system, _ = file_system(self.path)
        with system.open_input_file(piece.file) as f:
            if piece.n < 0:
                yield from getattr(self, f"_{self.kind}")(f)
                return
            m = self._matrix(f, piece)
        ids = np.arange(piece.number, piece.number + piece.n)
        if self.kind in RAW:
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(m.ravel())], ["vec_id", "value"])
        elif self.kind in ("knng", "padded"):
            m = m[:, : self.degree] if self.degree else m
            src, pos, dst = np.repeat(ids, m.shape[1]), np.tile(np.arange(m.shape[1], dtype=np.int32), len(m)), m.ravel().astype(np.int64)
            ok = dst >= 0
            yield pa.RecordBatch.from_arrays([pa.array(src[ok]), pa.array(pos[ok]), pa.array(dst[ok])], ["src", "pos", "dst"])
        else:
            m = np.ascontiguousarray(m[:, : self.dims] if self.dims else m)
            flat = pa.array(m.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, max(1, m.shape[1]), dtype=np.int32)[: len(m) + 1]), flat)], ["vec_id", "v"])

    def _matrix(self, f: pa.NativeFile, p: Piece) -> np.ndarray:
        kind = {"knng": "ivecs", "padded": "ibin", "codebook": "fbin"}.get(self.kind, self.kind)
        if kind in RAW:
            return np.frombuffer(f.read_at(4 * p.n, 4 * p.first), RAW[kind]).reshape(-1, 1)
        t = np.dtype(VECTOR[kind])
        if kind in ("fvecs", "ivecs"):
            raw = np.frombuffer(f.read_at(p.n * (4 + 4 * p.width), p.first * (4 + 4 * p.width)), "<i4").reshape(p.n, 1 + p.width)
            if (raw[:, 0] != p.width).any():
                raise ValueError("rows differ in width")
            return raw[:, 1:].view("<f4") if kind == "fvecs" else raw[:, 1:]
        head = 12 if self.kind == "codebook" else 8
        return np.frombuffer(f.read_at(p.n * p.width * t.itemsize, head + p.first * p.width * t.itemsize), t).reshape(p.n, p.width)

    # -- ragged files -------------------------------------------------------------------------------------------
    @staticmethod
    def _edges(lists: Iterator[np.ndarray], at_once: int = 4096) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        first = 0
        for done, ids in _with_last(lists):
            if ids is not None:
                held.append(ids)
            if held and (done or len(held) == at_once):
                size = np.array(list(map(len, held)))
                src = np.repeat(np.arange(first, first + len(held)), size)
                pos = np.concatenate([np.arange(n, dtype=np.int32) for n in size])
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(pos), pa.array(np.concatenate(held).astype(np.int64))], ["src", "pos", "dst"])
                first, held = first + len(held), []

    @staticmethod
    def _counted(f: pa.NativeFile, kind: str) -> Iterator[np.ndarray]:
        width = np.dtype(kind).itemsize
        while head := f.read(width):
            n = int(np.frombuffer(head, kind)[0])
            yield np.frombuffer(f.read(n * width), kind)

    def _adj(self, f: pa.NativeFile) -> Iterator[pa.RecordBatch]:
        return self._edges(self._counted(f, "<u4"))

    def _adj_entry(self, f: pa.NativeFile) -> Iterator[pa.RecordBatch]:
        f.read(8)
        return self._edges(self._counted(f, "<u4"))

    def _adj64(self, f: pa.NativeFile) -> Iterator[pa.RecordBatch]:
        return self._edges(self._counted(f, "<u8"))

    def _ended(self, f: pa.NativeFile) -> Iterator[pa.RecordBatch]:
        def lists() -> Iterator[np.ndarray]:
            rest = np.zeros(0, "<i4")
            while raw := f.read(4 << 20):
                rest = np.concatenate([rest, np.frombuffer(raw, "<i4")])
                ends = np.nonzero(rest == -1)[0]
                for a, b in zip([0, *(ends[:-1] + 1)], ends, strict=False):
                    yield rest[a:b]
                if len(ends):
                    rest = rest[ends[-1] + 1 :]

        return self._edges(lists())

    def _layered(self, f: pa.NativeFile) -> Iterator[pa.RecordBatch]:
        head = dict(zip(("links", "most", "n", "stride", "label", "data"), struct.unpack("<6Q", f.read(48)), strict=True))
        f.read(8)
        width = struct.unpack("<3QdQ", f.read(40))[0]
        n, stride, start = head["n"], head["stride"], 96
        # labels first: links are positions
        label = np.zeros(n, np.int64)
        step = max(1, RANGE_BYTES // max(1, stride))
        for a in range(0, n, step):
            raw = np.frombuffer(f.read_at(min(step, n - a) * stride, start + a * stride), np.uint8).reshape(-1, stride)
            label[a : a + len(raw)] = np.ascontiguousarray(raw[:, head["label"] : head["label"] + 8]).view("<u8").ravel()
        held: list[tuple[int, int, np.ndarray]] = []

        def batch() -> pa.RecordBatch:
            size = np.array([len(x) for _, _, x in held], np.int64)
            pos = np.concatenate([np.arange(k, dtype=np.int32) for k in size])
            dst = label[np.concatenate([x for _, _, x in held]).astype(np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([h[0] for h in held], np.int32), size)), pa.array(np.repeat(label[[h[1] for h in held]], size)), pa.array(pos), pa.array(dst)], ["level", "src", "pos", "dst"])

        for a in range(0, n, step):
            raw = f.read_at(min(step, n - a) * stride, start + a * stride)
            for i in range(len(raw) // stride):
                count = struct.unpack_from("<H", raw, i * stride + head["links"])[0]
                held.append((0, a + i, np.frombuffer(raw, "<u4", count, i * stride + head["links"] + 4)))
                if len(held) == 4096:
                    yield batch()
                    held = []
        f.seek(start + n * stride)
        for i in range(n):
            size = struct.unpack("<I", f.read(4))[0]
            raw = f.read(size)
            for level in range(size // (4 * width + 4)):
                at = level * (4 * width + 4)
                held.append((level + 1, i, np.frombuffer(raw, "<u4", struct.unpack_from("<H", raw, at)[0], at + 4)))
            if len(held) >= 4096:
                yield batch()
                held = []
        if held:
            yield batch()

    def _weighted(self, f: pa.NativeFile) -> Iterator[pa.RecordBatch]:
        _, dim, n, degree = struct.unpack("<BHIB", f.read(8))
        node = weighted_node(dim, degree)
        step = max(1, RANGE_BYTES // node.itemsize)
        ranges = [(a, min(step, n - a)) for a in range(0, n, step)]
        part = lambda a, k: np.frombuffer(f.read_at(k * node.itemsize, 8 + a * node.itemsize), node)
        label = np.concatenate([np.zeros(0, np.int64), *[part(a, k)["label"].astype(np.int64) for a, k in ranges]])
        for a, k in ranges:
            raw = part(a, k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(label[a : a + k], degree)), pa.array(np.tile(np.arange(degree, dtype=np.int32), k)), pa.array(label[raw["ids"].ravel()]), pa.array(raw["weights"].ravel())],
                ["src", "pos", "dst", "weight"],
            )


def weighted_node(dim: int, degree: int) -> np.dtype:
    return np.dtype([("v", "<f4", (dim,)), ("ids", "<u4", (degree,)), ("weights", "<f4", (degree,)), ("label", "<u4")])


def _with_last(items: Iterator[np.ndarray]) -> Iterator[tuple[bool, np.ndarray | None]]:
    for x in items:
        yield False, x
    yield True, None


@dataclass
class Draft(WriterCommitMessage):
    """A file that a task has written and the commit moves to its place."""

    draft: str | None
    name: str


class Writer(DataSourceArrowWriter):
    """Writes each partition as one draft file; the commit gives them names that follow the order of the partitions."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.kind, self.path, self.overwrite = options["kind"], options["path"], overwrite
        self.entry, self.width = int(options.get("entry", 0)), int(options.get("width", 0))
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, root = file_system(self.path)
        name = f"part-{task.partitionId():06d}"
        draft, out = f"{root}/_{name}-{task.taskAttemptId()}", None
        pieces = self._whole(batches) if self.kind in ("layered", "weighted") else self._encode(b for b in batches if b.num_rows)
        count = 0
        for raw, rows in pieces:
            out = out or system.open_output_stream(draft, compression=None)
            out.write(raw)
            count += rows
        if out is None:
            return Draft(None, name)
        out.close()
        if self.kind in ("fbin", "ibin", "i8bin"):  # the header needs the number of rows
            with system.open_input_stream(draft, compression=None) as old, system.open_output_stream(draft + "h", compression=None) as new:
                head = struct.unpack("<2i", old.read(8))
                new.write(struct.pack("<2i", count, head[1]))
                while raw := old.read(8 << 20):
                    new.write(raw)
            system.delete_file(draft)
            draft += "h"
        return Draft(draft, name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = file_system(self.path)
        drafts = [m for m in messages if m is not None and m.draft]
        if self.overwrite:
            mine = {m.draft.rsplit("/", 1)[1] for m in drafts}
            for f in system.get_file_info(fs.FileSelector(root)):
                if f.base_name not in mine:
                    system.delete_file(f.path) if f.type == fs.FileType.File else system.delete_dir(f.path)
        for m in drafts:
            system.move(m.draft, f"{root}/{m.name}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _ = file_system(self.path)
        for m in messages:
            if m is not None and m.draft:
                system.delete_file(m.draft)

    def _encode(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, int]]:
        """Pieces of the file with their numbers of rows, one for each batch."""
        first = True
        for b in batches:
            if self.kind in RAW:
                yield np.asarray(b.column(1)).astype(RAW[self.kind]).tobytes(), b.num_rows
            elif self.kind in VECTOR:
                m = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(VECTOR[self.kind])
                if self.kind in ("fvecs", "ivecs"):
                    yield np.concatenate([np.full((len(m), 1), m.shape[1], "<i4"), m.view("<i4")], axis=1).tobytes(), len(m)
                else:
                    yield (struct.pack("<2i", 0, m.shape[1]) if first else b"") + m.tobytes(), len(m)
            else:  # (src, ids) rows in order of src
                out = [struct.pack("<2I", self.width, self.entry)] if first and self.kind == "adj_entry" else []
                for ids in b.column(1).to_pylist():
                    if self.kind in ("adj", "adj_entry"):
                        out.append(np.array([len(ids), *ids], "<u4").tobytes())
                    elif self.kind == "adj64":
                        out.append(np.array([len(ids), *ids], "<u8").tobytes())
                    elif self.kind == "ended":
                        out.append(np.array([*ids, -1], "<i4").tobytes())
                    else:
                        raise ValueError(f"{self.kind} can't be written")
                yield b"".join(out), b.num_rows
            first = False

    def _whole(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, int]]:
        """Files whose links are positions: all rows of the one partition, labels first."""
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        if not rows:
            return
        at = {r[0]: i for i, r in enumerate(rows)}
        dim = len(rows[0][1])
        if self.kind == "weighted":
            degree = len(rows[0][2])
            yield struct.pack("<BHIB", 0, dim, len(rows), degree), 0
            node = weighted_node(dim, degree)
            for label, v, ids, weights in rows:
                yield np.array([(v, [at[i] for i in ids], weights, label)], node).tobytes(), 1
            return
        width = self.width or max((len(ls) for _, _, levels in rows for ls in levels[1:]), default=1)
        most0 = max(2 * width, *(len(levels[0]) for _, _, levels in rows))
        links = 4 * most0 + 4
        stride = links + 4 * dim + 8
        top = max(len(levels) for _, _, levels in rows) - 1
        yield struct.pack("<6Q", 0, len(rows), len(rows), stride, links + 4 * dim, links) + struct.pack("<iI", top, at.get(self.entry, 0)), 0
        yield struct.pack("<3QdQ", width, most0, width, 1.0 / np.log(max(2, width)), 0), 0
        pack = lambda ids, size: struct.pack("<HH", len(ids), 0) + np.array([at[i] for i in ids] + [0] * (size - len(ids)), "<u4").tobytes()
        for label, v, levels in rows:
            yield pack(levels[0], most0) + np.array(v, "<f4").tobytes() + struct.pack("<Q", label), 1
        for _, _, levels in rows:
            raw = b"".join(pack(ls, width) for ls in levels[1:])
            yield struct.pack("<I", len(raw)) + raw, 0


#: Kinds by the ends of file names, the longest that fits.
NAMES = {
    ".fvecs": "fvecs", ".ivecs": "ivecs", ".fbin": "fbin", ".ibin": "ibin", ".i8bin": "i8bin", ".mrng": "adj", ".ssg": "adj", ".taumg": "adj", ".nsg": "adj_entry", ".taumng": "adj_entry",
    ".nsw": "adj64", "_std": "ended", ".hnsw": "layered", ".deg": "weighted", ".efanna": "knng", ".fdat": "codebook", ".ibin_plain": "padded", ".ibin_mrng": "raw_i",
}


def kind_of(path: str) -> str:
    """The kind that a file's name stands for."""
    fits = [end for end in NAMES if path.rstrip("/").endswith(end)]
    if not fits:
        raise ValueError(f"the name of {path} says no kind")
    return NAMES[max(fits, key=len)]


class VecFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vecfiles"

    def schema(self) -> str:
        kind = self.options["kind"]
        if kind in VECTOR or kind == "codebook":
            return f"vec_id long, v array<{SQL_TYPE[VECTOR.get(kind, '<f4')]}>"
        if kind in RAW:
            return f"vec_id long, value {SQL_TYPE[RAW[kind]]}"
        return {"layered": "level int, src long, pos int, dst long", "weighted": "src long, pos int, dst long, weight float"}.get(kind, "src long, pos int, dst long")

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return Writer(dict(self.options), overwrite)


def read(spark: SparkSession, path: str, kind: str | None = None, **options: int) -> DataFrame:
    spark.dataSource.register(VecFiles)
    r = spark.read.format("vecfiles").option("kind", kind or kind_of(path))
    for k, v in options.items():
        r = r.option(k, str(v))
    return r.load(path)


def write(df: DataFrame, path: str, kind: str | None = None, parts: int = 1, **options: int) -> None:
    """Write rows in order of their first column: vectors, numbers, or neighbour lists, as the kind asks for."""
    df.sparkSession.dataSource.register(VecFiles)
    kind = kind or kind_of(path)
    if kind in ("adj_entry", "layered", "weighted") and parts != 1:
        raise ValueError(f"{kind} is one file")
    key = df.columns[0]
    rows = df.repartitionByRange(parts, key).sortWithinPartitions(key) if parts > 1 else df.coalesce(1).sortWithinPartitions(key)
    w = rows.write.format("vecfiles").option("kind", kind)
    for k, v in options.items():
        w = w.option(k, str(v))
    w.mode("overwrite").save(path)


def write_edge_csv(edges: DataFrame, path: str) -> None:
    """source,target,weight lines of a subgraph."""
    edges.select(*[edges[c].alias(n) for c, n in zip(edges.columns, ("source", "target", "weight"), strict=False)]).write.mode("overwrite").option("header", True).csv(path)


def read_effort_log(spark: SparkSession, path: str, least: int = 30) -> DataFrame:
    """(line, q_id, ndc) from comma lists in a text file; lines shorter than `least` are notes."""
    from pyspark.sql import functions as F

    lines = spark.read.text(path).where(F.length("value") >= least).select(F.md5("value").alias("line"), F.split(F.regexp_replace("value", r"[,\s]+$", ""), r"\s*,\s*").alias("x"))
    return lines.select("line", F.posexplode("x").alias("q_id", "ndc")).select("line", F.col("q_id").cast("long"), F.expr("try_cast(ndc AS double)").alias("ndc")).where("ndc IS NOT NULL")
