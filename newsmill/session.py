"""Session, shared folder and size checks."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Row, SparkSession

# Tables up to this many rows may be turned into literals or broadcast.
SMALL_ROWS = 1000


def get_spark(app: str = "newsmill", cores: str = "*", **conf: str) -> SparkSession:
    """A local session for development; on a cluster use the session you are given."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only where none is set and driver and executors are one process is a temporary one
    made.  On a cluster each executor would write to its own disk, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
        base = tempfile.mkdtemp(prefix="spark-newsmill-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, so columns that depend on the physical partitioning keep
    their values when an executor is lost.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_rows(df: DataFrame, limit: int = SMALL_ROWS) -> list[Row] | None:
    """The rows of a dimension table, or None when it has more than ``limit``."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


# Stored bytes that a range partition is meant to hold; read and decoded they are a few times as many.
CHUNK_BYTES = 64 << 20


def stored_bytes(df: DataFrame) -> int | None:
    """Bytes of the tables that ``df`` reads, None where one is not known."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return None if any(s >= 1 << 60 for s in sizes) else sum(sizes)


def partitions(df: DataFrame, count: int | None = None) -> int:
    """How many partitions ``df`` is cut into: no fewer than shuffles have, and more for large
    input, so that a partition does not grow with it."""
    if count:
        return count
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-(stored_bytes(df) or 0) // CHUNK_BYTES))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over all cores when the input has fewer splits than there are.

    A file that cannot be split goes to one task, which is slow for text and markup
    work.  A large table has more splits than cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
