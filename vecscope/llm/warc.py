"""WARC archives with a two-level capture index.

Archives hold one gzip member for each record, so a record is read by its offset and length alone.  Of captures with
equal payloads of MIN_REVISIT bytes or more, the one with the least id is stored as a response and the others as
revisits that name it.  The index lists captures by reversed-host key, LINES of them to a compressed block; a sparse
directory has the first key, file, offset and length of each block.  A lookup searches the directory, reads the
blocks that can hold the key, and then only the records' own byte ranges.

Executors write whole files below the shared folder through pyarrow's file systems, under names that no other attempt
uses.  What a task reports about its files is kept in a table in the same folder, and only reported files are read,
so what lost or repeated attempts leave behind does no harm.

Defined results
  null html            an empty payload; null url: the record has no target and the key is empty
  very long pages      memory grows with one record; archives are closed beyond ARCHIVE_BYTES
  ties                 the least id is the response; rows that share an id and a payload are all responses
  repeated rows        each gets its record
  empty table          no archives, an empty index, no rows
  extra columns        only id, url and html are stored
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import itertools
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import spread
from .common import Scratch, file_system

MIN_REVISIT = 100
ARCHIVE_BYTES = 256 << 20
LINES = 3000
#: Byte range of one archive whose records are read together.
READ_BYTES = 4 << 20
LEVEL = 3
BROADCAST_ROWS = 100_000
SALTS = 64
DATE = "2000-01-01T00:00:00Z"

_MANIFEST = "page_id long, key string, file string, offset long, length long"
_DIRECTORY = "first_key string, first_id long, file string, offset long, length long, n_lines long"


def surt(url: Column) -> Column:
    """Reversed-host key of a url: com,example,www)/path?query; '' for null or no ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^:/?#]*://(.*)$", 1)
    host = F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.when(rest == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_replace(tail, r"[\t\r\n]", " ")))


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC 1.1 record, uncompressed."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {size}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]", " ", url))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http
    if refers_to is None:
        body += payload
    else:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode(errors="surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


@dataclass
class Record:
    """A record as read back."""

    headers: dict[str, str]
    payload: bytes

    @classmethod
    def parse(cls, raw: bytes) -> Record:
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode(errors="surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        body = rest[: int(headers["content-length"])]
        if rest[len(body) :] != b"\r\n\r\n":
            raise ValueError("the record does not end where its length says")
        return cls(headers, body.partition(b"\r\n\r\n")[2])

    def page(self, field: str = "warc-record-id") -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d+)>", self.headers.get(field, ""))
        return int(m[1]) if m else None

    @property
    def kind(self) -> str:
        return self.headers["warc-type"]

    @property
    def digest(self) -> str:
        """Of the stored payload for a response, which must agree with its header; else as recorded."""
        said = self.headers["warc-payload-digest"].removeprefix("sha256:")
        if self.kind == "response" and hashlib.sha256(self.payload).hexdigest() != said:
            raise ValueError("a payload differs from its digest")
        return said

    @property
    def size(self) -> int:
        return len(self.payload) if self.kind == "response" else int(self.headers["x-payload-length"])


def with_types(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(page_id, url, payload, size, digest, refers_to): payload is null for revisits."""
    raw = F.coalesce("html", F.lit("")).cast("binary")
    hashed = pages.select("page_id", "url", "html", F.sha2(raw, 256).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("size"))
    groups = hashed.where(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first_"), F.count("*").alias("n_")).where("n_ > 1 AND first_ IS NOT NULL")
    groups = scratch.save(groups.select("digest", "first_"), "groups")
    if groups.count() <= BROADCAST_ROWS:
        joined = hashed.join(F.broadcast(groups), "digest", "left")
    else:  # salted, as one payload may have a large share of the rows
        dealt = groups.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
        joined = hashed.withColumn("salt_", salt).join(dealt, ["digest", "salt_"], "left").drop("salt_")
    refers = F.when(F.col("first_").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first_"))), F.col("first_"))
    return joined.select("page_id", "url", F.when(refers.isNull(), F.coalesce("html", F.lit("")).cast("binary")).alias("payload"), "size", "digest", refers.alias("refers_to"), surt(F.col("url")).alias("key"))


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write records as archives; the rows say where each lies.  Lazy: save the result once, before it is used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    rows = []
                    for page_id, url, payload, size, digest, refers_to, key in zip(*(c.to_pylist() for c in batch.slice(start, 256).columns), strict=True):
                        if out is None:
                            name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                            out = system.open_output_stream(f"{root}/{name}", compression=None)
                        raw = gzip.compress(record(page_id, url, payload or b"", size, digest, refers_to), LEVEL, mtime=0)
                        out.write(raw)
                        rows.append((page_id, key, name, at, len(raw)))
                        at += len(raw)
                        if at >= ARCHIVE_BYTES:
                            out.close()
                            out = None
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["page_id", "key", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return records.select("page_id", "url", "payload", "size", "digest", "refers_to", "key").mapInArrow(run, _MANIFEST)


def _line(key: str, page_id: int | None, file: str, offset: int, length: int) -> str:
    return "\t".join((key, "" if page_id is None else str(page_id), file, str(offset), str(length)))


def parse_block(raw: bytes) -> list[tuple[str, int | None, str, int, int]]:
    rows = (x.split("\t") for x in zlib.decompress(raw).decode(errors="surrogatepass").split("\n"))
    return [(k, int(i) if i else None, f, int(o), int(n)) for k, i, f, o, n in rows]


def write_index(manifest: DataFrame, folder: str, lines: int = LINES) -> DataFrame:
    """Sort captures by key into compressed blocks; the rows are the sparse directory.  Save the result once."""
    dealt = manifest.repartitionByRange("key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        rows = (r for b in batches for r in zip(b["key"].to_pylist(), b["page_id"].to_pylist(), b["file"].to_pylist(), b["offset"].to_pylist(), b["length"].to_pylist(), strict=True))
        first = next(rows, None)
        if first is None:
            return
        name, at, found = f"{uuid.uuid4().hex}.cdx", 0, []
        rows = itertools.chain([first], rows)
        with system.open_output_stream(f"{root}/{name}", compression=None) as out:
            while block := list(itertools.islice(rows, lines)):
                raw = zlib.compress("\n".join([_line(*r) for r in block]).encode(errors="surrogatepass"), LEVEL)
                out.write(raw)
                found.append((block[0][0], block[0][1], name, at, len(raw), len(block)))
                at += len(raw)
        cols = list(zip(*found, strict=True))
        types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["first_key", "first_id", "file", "offset", "length", "n_lines"])

    return dealt.mapInArrow(run, _DIRECTORY)


class Reader:
    """Range reads below one folder; keeps the last file open."""

    def __init__(self, folder: str):
        self.system, self.root = file_system(folder)
        self.name, self.file = None, None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            if self.file is not None:
                self.file.close()
            self.name, self.file = name, self.system.open_input_file(f"{self.root}/{name}")
        return self.file.read_at(length, offset)


@dataclass
class Archive:
    """Archives and their index in one folder of the shared store."""

    spark: SparkSession
    folder: str
    directory: DataFrame

    @property
    def archives(self) -> str:
        return f"{self.folder}/warc"

    @property
    def index(self) -> str:
        return f"{self.folder}/cdx"

    def captures(self) -> DataFrame:
        """(file, offset, length) of every record the index lists, from one task for each few blocks."""
        index = self.index

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks = Reader(index)
            for batch in batches:
                for name, offset, length in zip(batch["file"].to_pylist(), batch["offset"].to_pylist(), batch["length"].to_pylist(), strict=True):
                    cols = list(zip(*parse_block(blocks.read(name, offset, length)), strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[c], t) for c, t in ((2, pa.string()), (3, pa.int64()), (4, pa.int64()))], ["file", "offset", "length"])

        return spread(self.directory.select("file", "offset", "length"), "file", "offset").mapInArrow(run, "file string, offset long, length long")

    def read_all(self) -> DataFrame:
        """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record the index lists.

        Records are dealt by ranges of READ_BYTES of an archive to a stated number of tasks, each range read in order,
        so tasks grow with the bytes of the archives, not with the index.
        """
        archives = self.archives

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            records = Reader(archives)
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    part = batch.slice(start, 256)
                    rows = []
                    for file, at, size in zip(*(c.to_pylist() for c in part.columns), strict=True):
                        r = Record.parse(gzip.decompress(records.read(file, at, size)))
                        rows.append((r.page(), r.size, r.digest, r.kind, r.page("warc-refers-to")))
                    cols = list(zip(*rows, strict=True))
                    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

        ranges = self.captures().withColumn("range_", F.floor(F.col("offset") / READ_BYTES))
        dealt = spread(ranges, "file", "range_").sortWithinPartitions("file", "offset").select("file", "offset", "length")
        return dealt.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")

    def lookup(self, key: str, directory: list | None = None) -> list[Record]:
        """The captures of one key: binary search in the directory, then the blocks and byte ranges it points to.

        directory: the rows of the sparse directory by first key, where the caller has loaded them; else they are
        narrowed in Spark to the blocks that can hold the key.
        """
        if directory is None:
            before = self.directory.where(F.col("first_key") < key).agg(F.max("first_key")).first()[0]
            can = (F.col("first_key") == key) if before is None else F.col("first_key").between(before, key)
            directory = self.directory.where(can).orderBy("first_key", F.col("first_id").asc_nulls_first()).collect()
        keys = [d["first_key"] for d in directory]
        lo, hi = max(0, bisect.bisect_left(keys, key) - 1), bisect.bisect_right(keys, key)
        blocks, records, out = Reader(self.index), Reader(self.archives), []
        for d in directory[lo:hi]:
            rows = parse_block(blocks.read(d["file"], d["offset"], d["length"]))
            names = [r[0] for r in rows]
            for r in rows[bisect.bisect_left(names, key) : bisect.bisect_right(names, key)]:
                out.append(Record.parse(gzip.decompress(records.read(*r[2:]))))
        return out


def archive(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", folder: str | None = None) -> Archive:
    """Write every row of `pages` to archives with their index, under the shared folder unless another is named."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    root = folder or scratch.root
    narrow = pages.select(pages[key].cast("long").alias("page_id"), pages[url].cast("string").alias("url"), pages[html].cast("string").alias("html"))
    manifest = scratch.save(write_archives(with_types(narrow, scratch), f"{root}/warc"), "manifest")
    directory = scratch.save(write_index(manifest, f"{root}/cdx"), "directory")
    return Archive(spark, root, directory)
