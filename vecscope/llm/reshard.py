"""Resharding by minimum-cost flow: the block transfers that move the fewest bytes to new capacities.

Rows lie in old shards and, within one, in blocks of a size class, large rows first, numbered by a hash of the row, so
that a class has as many blocks as its rows ask for.  Only the byte totals of blocks reach the driver, at most BLOCKS
of them whatever the corpus.  Old sizes supply and new capacities demand a flow in which bytes that stay cost nothing
and bytes that move cost one each; its solution deals every old shard's blocks, in order, to the new shards.  Blocks
travel whole; only the few that a border crosses are put in order, and are split at rows that the driver then names.
As large rows come first and stay, borders fall among small rows and sizes come out nearly equal.

So where a row goes follows from the row and from two tables of bounded size, without a join.  Affected shards are
rewritten accordingly: rows that stay are written by the tasks that read them, and only rows that move are shuffled,
once.  A row's slot is its place among the rows of its shard's files.

The law is `bytes`: groups of equal texts may be split between shards, as a group may hold more than a shard's share.

Defined results
  null text            size 1, checksum of the empty string
  null ids             rows like others: they are dealt by a number that they get when they are stored
  very long texts      a row is never split; one larger than a capacity fills a shard
  ties, repeated rows  rows that agree in everything are interchangeable; each gets a slot of its own, and as they are
                       told apart by their stored numbers, they fill as many blocks as other rows do
  old shard null or    the row lies nowhere yet: it counts among the bytes that move wherever it goes, and its
  out of range         old_shard is null
  empty table          no rows
  extra columns        `reshard` returns its own columns only; `rewrite` and `reshard_files` keep the input's in files
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Scratch

BLOCKS = 65_536
BLOCK_ROWS = 2_000
CLASSES = 40
BROADCAST_FILES = 200_000


def min_cost_flow(supply: list[int], demand: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Flow from i to j of least total cost that ships every supply within the demands, by successive cheapest paths.

    Costs are not negative and the demands can take all supplies.  Potentials keep the reduced costs non-negative, so
    each path is found by a dense Dijkstra search; the graph has one node for each shard.
    """
    n, m = len(supply), len(demand)
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(demand)
    total = n + m
    potential = [0] * total
    while any(left):
        dist, via, done = [None] * total, [-1] * total, [False] * total
        for i in range(n):
            if left[i]:
                dist[i] = 0
        end = -1
        while True:
            u = min((k for k in range(total) if not done[k] and dist[k] is not None), key=lambda k: (dist[k], k), default=-1)
            if u < 0:
                break
            done[u] = True
            if u < n:
                steps = [(n + j, cost[u][j] + potential[u] - potential[n + j]) for j in range(m)]
            else:
                steps = [(i, -cost[i][u - n] + potential[u] - potential[i]) for i in range(n) if flow[i][u - n]]
            for v, c in steps:
                if dist[v] is None or dist[u] + c < dist[v]:
                    dist[v], via[v] = dist[u] + c, u
        ends = [n + j for j in range(m) if room[j] and dist[n + j] is not None]
        if not ends:
            raise ValueError("the capacities cannot take all bytes")
        end = min(ends, key=lambda v: (dist[v] + potential[v], v))
        far = max(d for d in dist if d is not None)
        path, v = [], end
        while via[v] >= 0:
            path.append((via[v], v))
            v = via[v]
        amount = min([left[v], room[end - n], *[flow[b][a - n] for a, b in path if a >= n]])
        for a, b in path:
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[v] -= amount
        room[end - n] -= amount
        potential = [p + (d if d is not None else far) for p, d in zip(potential, dist, strict=True)]
    return flow


@dataclass(frozen=True)
class Plan:
    """What a solved resharding does: bytes from each old to each new shard, and the borders that follow."""

    flow: list[list[int]]
    homes: int

    @property
    def moved(self) -> int:
        return sum(b for i, row in enumerate(self.flow) for j, b in enumerate(row) if i != j or i >= self.homes)

    @property
    def affected(self) -> list[int]:
        """Shards whose content changes."""
        moves = [(i, j) for i, row in enumerate(self.flow) for j, b in enumerate(row) if b and (i != j or i >= self.homes)]
        return sorted({j for _, j in moves} | {i for i, _ in moves if i < self.homes})

    def borders(self, old: int) -> list[tuple[int, int]]:
        """(upper border in bytes, new shard) of an old shard's bytes in order; what stays comes first."""
        row = self.flow[old]
        home = old < len(row) and old < self.homes
        order = [old] * home + [j for j in range(len(row)) if j != old or not home]
        out, at = [], 0
        for j in order:
            if row[j]:
                at += row[j]
                out.append((at, j))
        return out


def plan(sizes: list[int], capacities: list[int], nowhere: int = 0) -> Plan:
    """The flow from old shards, and from `nowhere` bytes that lie in none, as a last supply without a home."""
    supply = [*sizes, nowhere] if nowhere else sizes
    cost = [[int(i != j or i >= len(sizes)) for j in range(len(capacities))] for i in range(len(supply))]
    return Plan(min_cost_flow(supply, capacities, cost), len(sizes))


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def _class(size) -> Column:
    """Large rows first: the class falls as the size grows."""
    return F.lit(CLASSES) - F.least(F.floor(F.log2(size.cast("double"))).cast("int"), F.lit(CLASSES - 1))


@dataclass(frozen=True)
class Placement:
    """Where rows go: tables of the blocks of each (old, class), and of the targets of each block."""

    plan: Plan
    parts: DataFrame
    targets: DataFrame

    def of(self, rows: DataFrame, size: Column, old: Column, own: Column) -> DataFrame:
        """`rows` with `shard_`; both tables have BLOCKS rows at most and are broadcast."""
        d = rows.withColumns({"size_": size, "class_": _class(size), "from_": old, "own_": own})
        d = d.join(F.broadcast(self.parts), ["from_", "class_"]).withColumn("part_", F.pmod(F.xxhash64("own_"), F.col("parts_")).cast("int"))
        d = d.join(F.broadcast(self.targets), ["from_", "class_", "part_"])
        passed = F.size(F.filter("upto_", lambda u: u < F.struct(F.col("size_").alias("size"), F.col("own_").alias("own"))))
        return d.withColumn("shard_", F.get("target_", F.least(passed, F.size("target_") - 1))).select(*rows.columns, "shard_")


def placement(rows: DataFrame, shards: int, old_shards: int, capacities: list[int] | None = None) -> Placement:
    """Solve for rows (size, from_, own): from_ is 0 to old_shards - 1, or old_shards for rows that lie nowhere; own is a
    long that differs in every row."""
    spark = rows.sparkSession
    per_class = rows.groupBy("from_", _class(F.col("size")).alias("class_")).agg(F.count("*").alias("n")).collect()  # (old_shards + 1) * CLASSES rows
    n = sum(r["n"] for r in per_class)
    block = max(BLOCK_ROWS, -(-n // BLOCKS))
    parts = spark.createDataFrame([(r["from_"], r["class_"], -(-r["n"] // block)) for r in per_class] or [(0, 0, 1)], "from_ int, class_ int, parts_ int")
    place = ["from_", "class_", "part_"]
    dealt = rows.withColumn("class_", _class(F.col("size"))).join(F.broadcast(parts), ["from_", "class_"])
    dealt = dealt.withColumn("part_", F.pmod(F.xxhash64("own"), F.col("parts_")).cast("int")).select(*place, "size", "own")
    blocks = [tuple(r) for r in dealt.groupBy(*place).agg(F.sum("size").alias("bytes")).orderBy(*place).collect()]

    sizes = [0] * (old_shards + 1)
    for old, _, _, size in blocks:
        sizes[old] += size
    solved = plan(sizes[:-1], capacities or even_capacities(sum(sizes), shards), sizes[-1])
    borders = [solved.borders(i) if i < len(solved.flow) else [] for i in range(old_shards + 1)]
    at = [0] * (old_shards + 1)
    whole, split = [], []
    for old, c, p, size in blocks:
        here = [(e - at[old], j) for e, j in borders[old] if e > at[old]] or [(0, borders[old][-1][1])]
        if here[0][0] >= size or len(here) == 1:
            whole.append((old, c, p, [], [here[0][1]]))
        else:
            split.append((old, c, p, [e for e, _ in here], [j for _, j in here]))
        at[old] += size
    if split:  # as many as there are borders at most
        crossed = spark.createDataFrame(split, "from_ int, class_ int, part_ int, ends array<long>, to array<int>")
        w = Window.partitionBy(*place).orderBy("size", "own").rowsBetween(Window.unboundedPreceding, 0)
        inside = dealt.join(F.broadcast(crossed), place).withColumn("middle", F.sum("size").over(w) - F.col("size") / 2)  # a row goes where its middle lies
        target = F.get("to", F.least(F.size(F.filter("ends", lambda u: u <= F.col("middle"))), F.size("to") - 1))
        last = inside.groupBy(*place, target.alias("target")).agg(F.max(F.struct("size", "own")).alias("last")).collect()
        by: dict[tuple, list] = {}
        for r in last:
            by.setdefault((r["from_"], r["class_"], r["part_"]), []).append((tuple(r["last"]), r["target"]))
        whole += [(*k, [u for u, _ in sorted(v)], [t for _, t in sorted(v)]) for k, v in by.items()]
    schema = "from_ int, class_ int, part_ int, upto_ array<struct<size:long,own:long>>, target_ array<int>"
    return Placement(solved, parts, spark.createDataFrame(whole or [(0, 0, 0, [], [0])], schema))


def numbered(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The rows of shard folders with `slot`: their place among the rows of their shard's files, in order of names."""
    d = spark.read.schema(schema).parquet(path).select("*", F.col("_metadata.file_path").alias("file_"), F.col("_metadata.row_index").alias("nth_"))
    files = d.groupBy("shard", "file_").agg(F.count("*").alias("n_"))
    before = Window.partitionBy("shard").orderBy("file_").rowsBetween(Window.unboundedPreceding, -1)
    first = files.withColumn("first_", F.coalesce(F.sum("n_").over(before), F.lit(0))).select("file_", "first_")
    first = F.broadcast(first) if files.count() <= BROADCAST_FILES else first
    return d.join(first, "file_").withColumn("slot", F.col("first_") + F.col("nth_")).drop("file_", "nth_", "first_")


def _from(old: Column, old_shards: int) -> Column:
    return F.when(old.between(0, old_shards - 1), old).otherwise(F.lit(old_shards)).cast("int")


def reshard(docs: DataFrame, shards: int = 16, old_shards: int = 12, old=None, key: str = "doc_id", text: str = "text", capacities: list[int] | None = None, identity: str | None = None) -> DataFrame:
    """(key, size, text_crc32, old_shard, shard, slot) for every row.

    old: a column with the present shard of each row, 0 to old_shards - 1; by default a hash of the id.
    identity: a column that is different in every row and stored with them; it is returned as well.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "reshard")
    raw = F.coalesce(docs[text].cast("string"), F.lit(""))
    place = old if old is not None else F.pmod(F.xxhash64(docs[key]), F.lit(old_shards))
    own = docs[identity].cast("long") if identity else F.monotonically_increasing_id()
    rows = docs.select(docs[key].alias("key"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("crc"), _from(place, old_shards).alias("from_"), own.alias("own"))
    rows = scratch.save(rows, "rows")
    placed = placement(rows, shards, old_shards, capacities).of(rows, F.col("size"), F.col("from_"), F.col("own")).withColumnRenamed("shard_", "shard")
    placed.write.mode("overwrite").partitionBy("shard").parquet(scratch.path("placed"))
    scratch.drop("rows")
    old_shard = F.when(F.col("from_") < old_shards, F.col("from_")).alias("old_shard")
    return numbered(spark, scratch.path("placed"), placed.schema).select(F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), old_shard, "shard", "slot", *([F.col("own").alias(identity)] if identity else []))


def lay_out(docs: DataFrame, out: str, old_shards: int = 12, key: str = "doc_id") -> DataFrame:
    """`docs` as they lie in old shards by a hash of the id, one folder each, read back with `shard` and `row_`, an identity."""
    place = F.pmod(F.xxhash64(docs[key]), F.lit(old_shards)).cast("int")
    d = docs.select("*", F.monotonically_increasing_id().alias("row_"), place.alias("shard"))
    d.write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(out)
    return docs.sparkSession.read.schema(d.schema).parquet(out)


def reshard_files(docs: DataFrame, scratch: Scratch, shards: int = 16, old_shards: int = 12, key: str = "doc_id", text: str = "text", file_bytes: int = 64 << 20) -> DataFrame:
    """(key, size, text_crc32, old_shard, shard, slot) as read from the files of the new shards.

    Old shards are written, planned and rewritten where they change; sizes and checksums are those of the texts read
    back.  Shards that don't change are read from their old files.
    """
    spark = docs.sparkSession
    old = lay_out(docs, scratch.path("old"), old_shards, key)
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    size = (F.octet_length(raw) + 1).cast("long")
    rows = scratch.save(old.select(size.alias("size"), F.col("shard").alias("from_"), F.col("row_").alias("own")), "rows")
    solved = placement(rows, shards, old_shards)
    # a row for each two shards; a flow of fewer bytes than a row has moves none
    going = solved.of(rows, F.col("size"), F.col("from_"), F.col("own")).where("shard_ <> from_").groupBy("from_", "shard_").agg(F.sum("size").alias("bytes")).collect()
    affected = sorted({s for r in going for s in r[:2]})
    read = lambda d, was: d.select(key, size.alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"), F.col(was).alias("old_shard"), "shard", "slot")
    stay = read(numbered(spark, scratch.path("old"), old.schema).where(~F.col("shard").isin(affected)), "shard")
    if not affected:
        return stay
    files = {j: -(-sum(r["bytes"] for r in going if r["shard_"] == j) // file_bytes) for j in {r["shard_"] for r in going}}
    dealt = solved.of(old, size, F.col("shard"), F.col("row_")).where(F.col("shard").isin(affected)).withColumnsRenamed({"shard": "shard_in", "shard_": "shard"})
    part = F.pmod(F.xxhash64("row_"), F.get(F.array(*[F.lit(files.get(j, 1)) for j in range(shards)]), F.col("shard")))
    moving = dealt.where("shard <> shard_in").withColumn("part_", part).repartition("shard", "part_").drop("part_")
    whole = dealt.where("shard = shard_in").unionByName(moving)
    whole.write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(scratch.path("new"))
    return read(numbered(spark, scratch.path("new"), whole.schema), "shard_in").unionByName(stay)


def rewrite(docs: DataFrame, placement: DataFrame, out: str, key: str = "doc_id", rows_per_file: int = 500_000, text: str = "text", identity: str | None = None) -> list[int]:
    """Write the shards that gain or lose rows under `out`, one folder each, in slot order; the rest stay as they are.

    Each row takes one place: that of its identity, a column of both tables, or else, as rows of one id lie in one old
    shard, one of the places of its id, size and checksum.  A shard is written by as many tasks as its rows ask for.
    Input columns named shard, slot or part_ are written with a trailing _in.
    """
    moves = placement.where("old_shard <> shard").select(F.explode(F.array("old_shard", "shard")).alias("s")).distinct()
    affected = sorted(r["s"] for r in moves.collect())
    if affected:
        kept = [F.col(c).alias(f"{c}_in" if c in ("shard", "slot", "part_") else c) for c in docs.columns]
        if identity:
            rows, match = docs.select(F.col(identity).alias("id__"), F.struct(*kept).alias("row__")), ["id__"]
            where = placement.select(F.col(identity).alias("id__"), "shard", "slot")
        else:
            raw = F.coalesce(docs[text].cast("string"), F.lit(""))
            match = ["id__", "none__", "size__", "crc__", "nth__"]
            nth = F.row_number().over(Window.partitionBy(*match[:-1]).orderBy("order__")).alias("nth__")
            # a null id takes part as a stand-in beside a flag, as a join on columns does not meet nulls
            given = lambda c: (F.coalesce(c.cast("string"), F.lit("")).alias("id__"), c.isNull().alias("none__"))
            rows = docs.select(*given(docs[key]), (F.octet_length(raw) + 1).cast("long").alias("size__"), F.crc32(raw.cast("binary")).alias("crc__"), F.struct(*kept).alias("row__"))
            rows = rows.withColumn("order__", F.xxhash64("row__")).select(*match[:-1], nth, "row__")
            where = placement.select(*given(placement[key]), F.col("size").alias("size__"), F.col("text_crc32").alias("crc__"), "shard", "slot", F.struct("shard", "slot").alias("order__"))
            where = where.select(*match[:-1], nth, "shard", "slot")
        data = rows.join(where.where(F.col("shard").isin(affected)), match).select("row__.*", "shard", "slot", F.floor(F.col("slot") / rows_per_file).alias("part_"))
        data.repartition("shard", "part_").sortWithinPartitions("shard", "slot").drop("part_").write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(out)
    return affected
