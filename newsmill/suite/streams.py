"""T rows of the inventory: each stream works off the given tables and is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsmill.operators import admission
from newsmill.plans import maintain
from newsmill.session import scratch
from newsmill.streaming import jobs
from newsmill.suite.base import CALLS, COST, priced, query, stamp, stamp_sql, table


def event_files(spark, sf, part=None):
    """The events in three files, one after the other in time, in a folder of their own; with
    ``part`` the folder takes only these of them."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    low, high = (F.lit(x) for x in events.select(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), [0.3, 0.7]).alias("p")).first().p)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    thirds = [events.where(at < low), events.where((at >= low) & (at < high)), events.where(at >= high)]
    folder = scratch(spark, "events")
    for third in thirds[: part or 3]:
        third.coalesce(1).write.mode("append").parquet(folder)
    return folder, events.schema, thirds


def event_stream(spark, sf):
    """A file a batch."""
    folder, schema, _ = event_files(spark, sf)
    return jobs.read_stream(spark, folder, schema, 1)


def call_stream(spark, sf):
    """The usage log of the batch queries as a stream."""
    return priced_calls(event_stream(spark, sf))


def priced_calls(e):
    from newsmill.operators.usage import price_calls

    model = F.lit("other-model")
    names = {
        "click": "gemini-2.5-flash", "view": "models/gemini-2.0-flash", "purchase": "gemini-1.5-pro", "signup": "gemini-2.5-pro",
    }
    for kind, name in names.items():
        model = F.when(F.col("event_type") == kind, name).otherwise(model)
    return price_calls(
        e.select(
            F.col("event_id").alias("call_id"), F.col("ts").cast("timestamp").alias("ts"), model.alias("model"),
            F.concat(F.lit("task"), F.col("user_id").cast("string")).alias("task_id"),
            F.floor(F.col("value") * 1000).alias("input_chars"), F.floor(F.col("value") * 100).alias("output_chars"),
        )
    )


def written(spark, df):
    """Run a stream to the end of its input and read what it appended."""
    out, checkpoint = scratch(spark, "out"), scratch(spark, "checkpoint")
    jobs.run_available(df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append"))
    return spark.read.parquet(out)


def totals(spark, job, *args):
    """Run a job of merged totals to the end of its input and read the newest."""
    out, checkpoint = scratch(spark, "totals"), scratch(spark, "checkpoint")
    jobs.run_available(job(*args, out, checkpoint))
    return jobs.latest_totals(spark, out)


@query("t1_append_new", "SELECT DISTINCT 'u' || user_id || '-' || event_type AS url FROM events")
def t1(spark, sf):
    e = event_stream(spark, sf).select(
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), "event_type").alias("url"), F.col("event_id").alias("pos")
    )
    target, checkpoint = scratch(spark, "target"), scratch(spark, "checkpoint")
    jobs.run_available(jobs.append_stream(e, target, checkpoint))
    return spark.read.option("basePath", target).parquet(target).select("url")


@query("t2_unseen_ids", "SELECT DISTINCT user_id FROM events")
def t2(spark, sf):
    return written(spark, jobs.unseen_ids(event_stream(spark, sf).select("user_id", "ts"), "user_id", "ts")).select("user_id")


@query(
    "t3_daily_counters",
    f"WITH {CALLS} SELECT {stamp_sql('date_trunc(' + chr(39) + 'day' + chr(39) + ', ts)')} AS day, count(*) AS calls, round(sum({COST}), 6) AS cost_estimate FROM calls GROUP BY 1",
)
def t3(spark, sf):
    days = totals(spark, jobs.daily_totals, call_stream(spark, sf))
    return days.select(stamp("day").alias("day"), "calls", F.round(F.col("cost_estimate").cast("double"), 6).alias("cost_estimate"))


@query(
    "t3_monthly_counters",
    f"WITH {CALLS} SELECT strftime(ts, '%Y-%m') AS month, count(*) AS calls, CAST(sum(CAST({COST} AS DECIMAL(38,10))) AS DOUBLE) AS cost FROM calls GROUP BY 1",
)
def t3_months(spark, sf):
    return totals(spark, jobs.monthly_counters, call_stream(spark, sf)).withColumn("cost", F.col("cost").cast("double"))


@query(
    "t4_sliding_minute",
    """WITH e AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events), w AS (SELECT unnest(generate_series(s - s % 10 - 50, s - s % 10, 10)) AS start FROM e)
     SELECT start, count(*) AS calls FROM w GROUP BY start""",
)
def t4(spark, sf):
    return totals(spark, jobs.sliding_totals, call_stream(spark, sf)).select(F.unix_seconds("start").alias("start"), "calls")


LIMITS = {"daily_max_calls": 12, "monthly_max_calls": 200, "monthly_budget_usd": 0.35}


@query("t5_admission_stream")
def t5(spark, sf):
    out, state, checkpoint = (scratch(spark, n) for n in ("out", "state", "checkpoint"))
    jobs.run_available(jobs.admission_stream(call_stream(spark, sf), out, state, checkpoint, LIMITS))
    return spark.read.option("basePath", out).parquet(out).select("call_id", "tenant", "decision")


@query("t5_admission")
def t5b(spark, sf):
    return admission.admit(priced(spark, sf), LIMITS)


@query(
    "t5_admission_open",
    f"WITH {CALLS} SELECT call_id, 'accepted' AS decision FROM calls",
)
def t5c(spark, sf):
    # Without limits every call passes.
    limits = {"enabled": False, "free_tier_only": False}
    return admission.admit(priced(spark, sf), limits).select("call_id", "decision")


@query(
    "t6_task_totals",
    f"WITH {CALLS} SELECT task_id, count(*) AS calls, {stamp_sql('max(ts)')} AS last_run FROM calls GROUP BY task_id",
)
def t6(spark, sf):
    return totals(spark, jobs.task_totals_stream, call_stream(spark, sf)).withColumn("last_run", stamp("last_run"))


@query(
    "t7_catch_up",
    f"WITH {CALLS} SELECT task_id, count(*) AS calls, {stamp_sql('max(ts)')} AS last_run FROM calls GROUP BY task_id",
)
def t7(spark, sf):
    # The totals are stopped after two of the files; the third came while nothing was up.
    folder, schema, thirds = event_files(spark, sf, 2)
    out, checkpoint = scratch(spark, "totals"), scratch(spark, "checkpoint")
    for late in ([], thirds[2:], []):
        for third in late:
            third.coalesce(1).write.mode("append").parquet(folder)
        calls = priced_calls(jobs.read_stream(spark, folder, schema, 1))
        jobs.run_available(jobs.task_totals_stream(calls, out, checkpoint))
    return jobs.latest_totals(spark, out).withColumn("last_run", stamp("last_run"))


@query("t8_resume", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def t8(spark, sf):
    path = scratch(spark, "stage")
    build = lambda: table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    maintain.resume(spark, path, build)
    # The stage is there now, so the second call must not build it again.
    return maintain.resume(spark, path, lambda: build().withColumn("n", F.lit(-1)))
