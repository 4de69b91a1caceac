"""The canonical tables: base(vec_id, v), query(q_id, v), gt(q_id, rank, id, dist), edges(src, pos, dst)."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("v"))


def base_query(spark: SparkSession, sf_dir: str, every: int = 10) -> tuple[DataFrame, DataFrame]:
    """Nine tenths of the vectors as base, every tenth as a query."""
    e = embeddings(spark, sf_dir)
    return e.where(F.col("vec_id") % every != 0), e.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("q_id"), "v")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys to as many tasks as a shuffle has, and at least one for each core.

    For work that costs far more than its bytes suggest: a stated number of partitions is not coalesced at run time.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from the session; one of our own only where none is set and all is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    found = found or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='vecscope-')}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone already; the folder then stays for the cluster's own cleaning
        pass
