"""What several operators share: columns in, places of distinct keys, linked groups."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from newsmill.session import durable

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under the operator's own names; all others are left out, so
    extra columns of any name cannot clash with what the operator adds."""
    return df.select(*[F.col(f"`{name}`").alias(own) for own, name in columns.items()])


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def text_key(doc_id: Column, text: Column) -> list[Column]:
    """Two columns that find a row again after a shuffle.

    They are functions of the row alone, so a task that runs again gives the same.  Rows
    with equal keys have equal ids and texts, and so equal results.
    """
    return [
        F.coalesce(doc_id.cast("long"), F.lit(0)).alias("_id"),
        F.xxhash64(doc_id, text).alias("_hash"),
    ]


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dense_names(df: DataFrame, *keys: str, name: str = "name") -> DataFrame:
    """Distinct keys with their rank 1, 2, ... in sort order.

    The keys are range-partitioned and sorted; a rank is the place within the partition
    plus the sizes of the partitions before it (one row a partition).  The ranks do not
    depend on where the partitions are cut.
    """
    placed = durable(
        df.select(*keys)
        .distinct()
        .repartitionByRange(partitions(df), *keys)
        .sortWithinPartitions(*keys)
        .select(
            *keys,
            F.spark_partition_id().alias("_part"),
            F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_place"),
        ),
        "names",
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    return placed.join(F.broadcast(starts), "_part").select(
        *keys, (F.col("_start") + F.col("_place") + 1).alias(name)
    )


def _signature(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v); root is the component's least node.

    Large-star and small-star steps in turn until nothing changes.  A step joins edges with
    the least neighbour of each node; the least neighbours are aggregated before the
    shuffle, and adaptive execution splits a node with very many edges.
    """
    edges = durable(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .where("u != v")
        .distinct(),
        "edges",
    )
    last = None
    while (now := _signature(edges)) != last:
        last = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = durable(
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u != v")
            .distinct(),
            "edges",
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = durable(
            large.join(least, "u")
            .where("v != m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct(),
            "edges",
        )
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def runs(batches: Iterator, key_columns: list[str], value_column: str) -> Iterator:
    """(key, values) of each run of equal keys in sorted Arrow batches."""
    import numpy as np

    key, held = None, []
    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in key_columns]
        values = batch.column(value_column).to_numpy(zero_copy_only=False)
        if not len(values):
            continue
        change = np.zeros(len(values), bool)
        change[0] = True
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change)
        for s, e in zip(starts, [*starts[1:], len(values)]):
            k = tuple(c[s] for c in columns)
            if k != key:
                if held:
                    yield key, np.concatenate(held)
                key, held = k, []
            held.append(values[s:e])
    if held:
        yield key, np.concatenate(held)
