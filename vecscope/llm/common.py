"""What the training-data operators share: table reading, scratch tables, let-bindings for arrays."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys of more rows than this, and than a HOT_KEYS-th of all rows, are hot: so there are HOT_KEYS of them at most.
HOT_ROWS = 512
HOT_KEYS = 100_000

#: Java/RE2 class of the word characters used by every word-based operator here.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.  Read from the session; one of our own only where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vecscope-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


_open: list[list["Scratch"]] = []


class Scratch:
    """Tables written to the shared folder, so that later stages never recompute what an executor lost.

    Each operator run has a folder of its own; keep() removes all tables but those that its result still reads,
    `scratch_scope` removes what was made inside it, and the rest goes when the driver's interpreter ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.names: set[str] = set()
        atexit.register(self.drop)
        for made in _open:
            made.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.names.add(name)
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def keep(self, *names: str) -> None:
        for name in sorted(self.names - set(names)):
            self.drop(name)

    def drop(self, name: str | None = None) -> None:
        self.names = self.names - {name} if name else set()
        if not name:
            atexit.unregister(self.drop)
        try:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session may be gone already; the folder then stays for the cluster's own cleaning
            pass


@contextmanager
def scratch_scope() -> Iterator[None]:
    """What operators put into scratch tables inside goes at the end, so results must have been written by then."""
    made: list[Scratch] = []
    _open.append(made)
    try:
        yield
    finally:
        _open.remove(made)
        for s in made:
            s.drop()


def hot_bound(total: int) -> int:
    """Keys of more rows than this, of `total` rows in all, are hot."""
    return max(HOT_ROWS, total // HOT_KEYS)


def join_unique(rows: DataFrame, table: DataFrame, hot: DataFrame, keys: list[str], scatter: list[str]) -> DataFrame:
    """`rows` left-joined with `table`, which is unique by `keys`, without meeting the rows of a hot key in one task.

    hot: the rows of `table` for hot keys, HOT_KEYS at most by hot_bound; they are broadcast, and rows that have met one
    go through the second join dealt by `scatter`.
    """
    values = [c for c in table.columns if c not in keys]
    near = hot.select(*keys, F.lit(True).alias("hot_"), *[F.col(c).alias(f"hot_{c}") for c in values])
    deal = F.when(F.col("hot_"), F.pmod(F.xxhash64(*scatter), F.lit(1 << 30)) + 1).otherwise(F.lit(0)).cast("long")
    met = rows.join(F.broadcast(near), keys, "left").withColumn("deal_", deal)
    both = met.join(table.withColumn("deal_", F.lit(0).cast("long")), [*keys, "deal_"], "left")
    return both.select(*rows.columns, *[F.when(F.col("hot_"), F.col(f"hot_{c}")).otherwise(F.col(c)).alias(c) for c in values])


def let(value: Column, body) -> Column:
    """Evaluate value once for each row and hand it to body, also inside lambdas of body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text as an array; null gives the empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def salted(*cols: str, n: int = 64) -> Column:
    """A salt that follows from the row itself, so that a retried task deals its rows in the same way."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")
