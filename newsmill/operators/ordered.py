"""Ordered logic that does not need a whole group in one task.

A window function keeps each of its groups in one task, and one group may hold a
third of all rows.  Here the rows are range-partitioned by (keys, order) first, so
a large group spreads over many chunks; the window runs inside a chunk, and a
small table with one row per (key, chunk) carries the state over the borders.  The
number of chunks follows the stored bytes of the input, so a chunk stays as large as
it is whatever the table; a key in a million chunks (64 TB) carries a million short rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsmill.functions.arrays import col
from newsmill.session import durable, partitions

CHUNK = "_chunk"


def chunked(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], count: int | None = None
) -> DataFrame:
    """Rows with their chunk number; chunks follow each other in (keys, order)."""
    ranged = df.repartitionByRange(partitions(df, count), *keys, *order)
    # The number of a range partition is only stable once it is written.
    return durable(ranged.withColumn(CHUNK, F.spark_partition_id()), "chunks")


def _border_join(rows: DataFrame, borders: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach the state at the start of each (key, chunk)."""
    on = [*keys, CHUNK]
    named = borders.select(
        *[F.col(k).alias(f"_at_{k}") for k in on], *[c for c in borders.columns if c not in on]
    )
    same = [F.col(k).eqNullSafe(F.col(f"_at_{k}")) for k in keys] + [F.col(CHUNK) == F.col(f"_at_{CHUNK}")]
    return rows.join(named, same, "left").drop(*[f"_at_{k}" for k in on])


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, Column],
    count: int | None = None,
) -> DataFrame:
    """Add running sums; ``order`` must be unique within a key."""
    names = list(values)
    rows = chunked(
        df.select("*", *[v.alias(f"_v_{n}") for n, v in values.items()]), keys, order, count
    )
    totals = rows.groupBy(*keys, CHUNK).agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in names])
    before = (
        Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    )
    borders = totals.select(
        *keys, CHUNK, *[F.sum(f"_s_{n}").over(before).alias(f"_b_{n}") for n in names]
    )
    inside = (
        Window.partitionBy(*keys, CHUNK)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = rows.select("*", *[F.sum(f"_v_{n}").over(inside).alias(f"_l_{n}") for n in names])
    joined = _border_join(local, borders, keys)
    return joined.select(
        *df.columns,
        *[
            (F.coalesce(F.col(f"_b_{n}"), F.lit(0)) + F.col(f"_l_{n}")).alias(n)
            for n in names
        ],
    )


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "n"
) -> DataFrame:
    """Dense row numbers within a key."""
    return running_totals(df, keys, order, {name: F.lit(1).cast("long")})


def carry_forward(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str,
    default: str | None = None,
) -> DataFrame:
    """The last non-null value at or before each row."""
    rows = chunked(df.withColumn("_v", value), keys, order)
    # max_by skips no nulls, so only rows that carry a value take part.
    lasts = (
        rows.where(F.col("_v").isNotNull())
        .groupBy(*keys, CHUNK)
        .agg(F.max_by("_v", F.struct(*order)).alias("_last"))
    )
    every = rows.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_rows"))
    marks = _border_join(every, lasts, keys)
    before = (
        Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    )
    borders = marks.select(
        *keys, CHUNK, F.last("_last", ignorenulls=True).over(before).alias("_border")
    )
    inside = (
        Window.partitionBy(*keys, CHUNK)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = rows.withColumn("_local", F.last("_v", ignorenulls=True).over(inside))
    joined = _border_join(local, borders, keys)
    return joined.select(
        *df.columns,
        F.coalesce("_local", "_border", F.lit(default)).alias(name),
    )


def lookback(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    rows_back: int,
    name: str,
) -> DataFrame:
    """W8, and W9/W13 with one row: the values of the rows before each row, oldest first."""
    rows = chunked(df.withColumn("_v", F.struct(value.alias("v"))), keys, order)
    newest = Window.partitionBy(*keys, CHUNK).orderBy(*[F.desc(o) for o in order])
    tails = (
        rows.select(*keys, CHUNK, *[o for o in order if o not in keys], "_v")
        .withColumn("_r", F.row_number().over(newest))
        .where(F.col("_r") <= rows_back)
    )
    earlier = Window.partitionBy(*keys).orderBy(CHUNK, *order).rowsBetween(-rows_back, -1)
    first = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    borders = (
        tails.withColumn("_border", F.collect_list("_v").over(earlier))
        .withColumn("_f", F.row_number().over(first))
        .where(F.col("_f") == 1)
        .select(*keys, CHUNK, "_border")
    )
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(-rows_back, -1)
    local = rows.withColumn("_local", F.collect_list("_v").over(inside))
    joined = _border_join(local, borders, keys)
    seen = F.concat(F.coalesce("_border", F.filter("_local", lambda x: F.lit(False))), F.col("_local"))
    kept = F.slice(
        F.col("_seen"), F.greatest(F.size("_seen") - rows_back + 1, F.lit(1)), F.lit(rows_back)
    )
    return joined.withColumn("_seen", seen).select(
        *df.columns, F.transform(kept, lambda x: x["v"]).alias(name)
    )


def drop_consecutive(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str
) -> DataFrame:
    """Drop rows whose value equals the row before."""
    marked = lookback(df, keys, order, F.col(value), 1, "_prev")
    return marked.where(
        (F.size("_prev") == 0) | ~F.col(value).eqNullSafe(F.get("_prev", F.lit(0)))
    ).drop("_prev")


def not_decreasing(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cursor: str, name: str = "stalled"
) -> DataFrame:
    """True where a cursor fails to go below the one before it."""
    marked = lookback(df, keys, order, F.col(cursor), 1, "_prev")
    prev = F.get("_prev", F.lit(0))
    return marked.withColumn(name, F.coalesce(F.col(cursor) >= prev, F.lit(False))).drop("_prev")


def islands(df: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """Runs of consecutive numbers as (start, end, size)."""
    ranked = row_numbers(df.select(*keys, number).distinct(), keys, [number], "_n")
    return (
        ranked.groupBy(*keys, (F.col(number) - F.col("_n")).alias("_run"))
        .agg(
            F.min(number).alias("start"),
            F.max(number).alias("end"),
            F.count(F.lit(1)).alias("size"),
        )
        .drop("_run")
    )


def calls_in_last(
    df: DataFrame, keys: Sequence[str], ts: str, seconds: int = 60, name: str = "recent"
) -> DataFrame:
    """Per key and moment, the calls in the ``seconds`` up to and including it.

    Equal moments are counted before the shuffle.  Each count then goes to its
    own time slot and to the next one, so the window runs over (key, slot)
    instead of over a whole key.
    """
    moments = df.groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("calls"))
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    width = seconds * 1_000_000
    own = F.floor(micros / width)
    slots = moments.withColumn("_us", micros).withColumn(
        "_slot", F.explode(F.array(own, own + 1))
    )
    frame = (
        Window.partitionBy(*keys, "_slot").orderBy("_us").rangeBetween(-width, Window.currentRow)
    )
    counted = slots.withColumn(name, F.sum("calls").over(frame))
    return counted.where(F.col("_slot") == F.floor(F.col("_us") / width)).select(
        *keys, ts, "calls", name
    )


def last_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int
) -> DataFrame:
    """The first ``n`` rows per key in this order.

    The filter on the row number is pushed below the shuffle as a group limit,
    so at most ``n`` rows per key and task travel.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def missing_days(df: DataFrame, day: Column | str) -> DataFrame:
    """Days between the first and the last that do not occur."""
    days = df.select(col(day).alias("day")).where(F.col("day").isNotNull()).distinct()
    span = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a is not null")
    every = span.select(F.explode(F.sequence("a", "b")).alias("day"))
    return every.join(days, "day", "left_anti")
