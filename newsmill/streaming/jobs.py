"""T1-T7.

Sources are growing tables.  A stream started with ``availableNow`` works off what
has arrived since its checkpoint and stops, which is also how runs that were missed
while nothing was up are caught up (T7).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from newsmill import fixed
from newsmill.operators.admission import prepare, settle_admission
from newsmill.operators.dedup import keep_first
from newsmill.operators.joins import new_rows


def read_stream(spark: SparkSession, folder: str, schema, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def run_available(writer) -> StreamingQuery:
    """Work off everything that is there, then stop."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def append_stream(
    items: DataFrame, target: str, checkpoint: str, key: str = "url", order: Sequence[str] = ("pos",)
):
    """Each micro-batch appends the rows whose key the target table does not hold.

    A batch is written to its own folder, so a batch that is repeated after a
    failure replaces its rows instead of adding them again, and the target it is
    compared with leaves that folder out.
    """
    spark = items.sparkSession
    stored = StructType([*items.schema.fields, StructField("batch", LongType())])

    def load(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        folder = f"{target}/batch={number:012d}"
        known = (
            session.read.schema(stored)
            .option("basePath", target)
            .parquet(target)
            .where(F.col("batch") != number)
            .select(key)
            if _has_files(spark, target)
            else session.createDataFrame([], batch.select(key).schema)
        )
        fresh = keep_first(new_rows(batch, known, key), [key], list(order), keep_null_keys=True)
        fresh.write.mode("overwrite").parquet(folder)

    return items.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)


def _has_files(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and len(fs.listStatus(p)) > 0


def unseen_ids(
    events: DataFrame, id_column: str, ts: str, days: int = fixed.STATE_TTL_DAYS
) -> DataFrame:
    """The first event per id; an id is forgotten after its time to live."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.withWatermark(ts, f"{days} days").dropDuplicatesWithinWatermark([id_column])


def daily_counters(calls: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Calls and cost per day, for append mode: a day is put out once the watermark has
    passed its end, and then its state goes."""
    timed = calls.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return timed.groupBy(F.window("ts", "1 day")).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("cost").alias("cost_estimate")
    ).select(F.col("window.start").alias("day"), "calls", F.round("cost_estimate", 6).alias("cost_estimate"))


def sliding_minute(
    calls: DataFrame, keys: Sequence[str] = (), slide: str = "10 seconds", lateness: str = "1 minute"
) -> DataFrame:
    """T4: calls per 60-second window that moves by ``slide``, for append mode: windows are put
    out, and forgotten, as the watermark passes them."""
    timed = calls.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return timed.groupBy(*keys, F.window("ts", "60 seconds", slide)).agg(
        F.count(F.lit(1)).alias("calls")
    ).select(*keys, F.col("window.start").alias("start"), "calls")


def merged_totals(
    rows: DataFrame,
    keys: Sequence[str],
    totals: Mapping[str, tuple[str, Column]],
    out: str,
    checkpoint: str,
):
    """Totals per key that go on from batch to batch, kept as a table and not as state.

    ``totals`` names each column with its way of adding up (sum, min or max) and the value of a
    row.  A batch is aggregated on its own, added to the totals that the batch before it left,
    and written to its own folder; repeated after a failure it reads and writes the same.
    :func:`latest_totals` reads the newest."""
    ways = {"sum": F.sum, "min": F.min, "max": F.max}

    def add(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        new = batch.groupBy(*keys).agg(*[ways[way](value).alias(name) for name, (way, value) in totals.items()])
        before = f"{out}/batch={number - 1:012d}"
        if _has_files(session, before):
            both = session.read.schema(new.schema).parquet(before).unionByName(new)
            new = both.groupBy(*keys).agg(*[ways[way](name).alias(name) for name, (way, _) in totals.items()])
        new.write.mode("overwrite").parquet(f"{out}/batch={number:012d}")

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)


def latest_totals(spark: SparkSession, out: str) -> DataFrame:
    """The totals after the last batch."""
    p = spark._jvm.org.apache.hadoop.fs.Path(out)
    folders = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    return spark.read.parquet(max(f.getPath().toString() for f in folders))


def monthly_counters(calls: DataFrame, out: str, checkpoint: str):
    """Calls and cost per calendar month; a new month begins its own row at zero and the one
    before it stays as it ended."""
    month = calls.withColumn("month", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM"))
    cost = F.col("cost").cast("decimal(38,10)")
    return merged_totals(month, ["month"], {"calls": ("sum", F.lit(1).cast("long")), "cost": ("sum", cost)}, out, checkpoint)


def daily_totals(calls: DataFrame, out: str, checkpoint: str):
    """Calls and cost of every day that has calls, the last one included; late calls count too."""
    day = calls.withColumn("day", F.date_trunc("day", F.col("ts").cast("timestamp")))
    cost = F.col("cost").cast("decimal(38,10)")
    return merged_totals(
        day, ["day"], {"calls": ("sum", F.lit(1).cast("long")), "cost_estimate": ("sum", cost)}, out, checkpoint
    )


def sliding_totals(
    calls: DataFrame, out: str, checkpoint: str, keys: Sequence[str] = (), slide: str = "10 seconds"
):
    """T4: calls per 60-second window that moves by ``slide``, for every window that has calls."""
    rows = calls.select(*keys, F.window(F.col("ts").cast("timestamp"), "60 seconds", slide).alias("window"))
    starts = rows.select(*keys, F.col("window.start").alias("start"))
    return merged_totals(starts, [*keys, "start"], {"calls": ("sum", F.lit(1).cast("long"))}, out, checkpoint)


def task_totals_stream(calls: DataFrame, out: str, checkpoint: str):
    """Running totals per task with the last run."""
    last = F.col("ts").cast("timestamp")
    return merged_totals(
        calls, ["task_id"], {"calls": ("sum", F.lit(1).cast("long")), "last_run": ("max", last)}, out, checkpoint
    )


# --- T5 ---------------------------------------------------------------------

STATE = "tenant string, day string, month string, daily long, monthly long, spent double, recent array<double>"


def admission_stream(
    calls: DataFrame,
    out: str,
    state: str,
    checkpoint: str,
    limits: Mapping[str, Any] = fixed.DEFAULT_LIMITS,
    tenant: str = "task_id",
):
    """T5: accept or reject each call as it comes, with a state of a few numbers per tenant.

    Calls of a tenant must come in time order from batch to batch.  A batch is decided
    by :mod:`newsmill.operators.admission`, which streams a busy tenant day by day and
    never holds its calls at once.  Batch ``n`` reads the state that batch ``n - 1``
    wrote and overwrites its own folders, so a repeated batch gives the same result.
    """
    limits = {**fixed.DEFAULT_LIMITS, **limits}

    def decide(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        before = f"{state}/batch={number - 1:012d}"
        initial = session.read.schema(STATE).parquet(before) if _has_files(session, before) else None
        decided, ended = settle_admission(prepare(batch, tenant), limits, initial)
        decided.select("call_id", "tenant", "decision").write.mode("overwrite").parquet(
            f"{out}/batch={number:012d}"
        )
        ended.write.mode("overwrite").parquet(f"{state}/batch={number:012d}")

    return calls.writeStream.foreachBatch(decide).option("checkpointLocation", checkpoint)
