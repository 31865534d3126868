"""Task tables, retention, sync and media: P33-P35, J11, S19, S21, A17."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsmill import fixed
from newsmill.functions.arrays import col
from newsmill.functions.dates import next_run


def due_tasks(tasks: DataFrame, as_of: Column | str) -> DataFrame:
    """P33."""
    return tasks.where(
        F.col("enabled") & F.col("next_run").isNotNull() & (F.col("next_run") <= col(as_of))
    )


def missed_today(as_of: Column | str) -> Column:
    """A daily task whose time has passed and that has not run today."""
    now = col(as_of)
    at = F.try_to_timestamp(
        F.concat(F.date_format(now, "yyyy-MM-dd "), F.col("run_at_time")), F.lit("yyyy-MM-dd H:mm")
    )
    stale = F.col("last_run").isNull() | (F.to_date("last_run") < F.to_date(now))
    return F.coalesce((F.col("interval") == "daily") & (at <= now) & stale, F.lit(False))


def plan_runs(tasks: DataFrame, as_of: Column | str, catch_up_seconds: int = 10) -> DataFrame:
    """Next run of every enabled task; a missed one runs soon."""
    now = col(as_of)
    soon = now + F.make_interval(secs=F.lit(catch_up_seconds))
    regular = next_run("interval", "run_at_time", "run_on_day", "custom_hours", now)
    missed = missed_today(now)
    return tasks.withColumn("missed", missed).withColumn(
        "next_run", F.when(F.col("enabled"), F.when(missed, soon).otherwise(regular)).otherwise(F.col("next_run"))
    )


# --- retention (P35) --------------------------------------------------------

def old_media(media: DataFrame, as_of: Column | str, days: int = 30) -> DataFrame:
    """Media files older than ``days``, oldest first."""
    cutoff = col(as_of) - F.make_interval(days=F.lit(days))
    return media.where(F.col("modified") < cutoff).select(
        "week", "name",
        F.round(F.col("size") / (1024 * 1024), 1).alias("size_mb"),
        F.date_format("modified", "yyyy-MM-dd").alias("modified_date"),
    ).orderBy("modified_date", "week", "name")


def live_ids(ids: DataFrame, as_of: Column | str, days: int = fixed.STATE_TTL_DAYS) -> DataFrame:
    """Processed ids still within their time to live; compared as day strings."""
    cutoff = F.date_format(F.date_sub(F.to_date(col(as_of)), days), "yyyy-MM-dd")
    return ids.where(F.coalesce(F.col("processed_date"), F.lit("")) >= cutoff)


def live_jobs(
    jobs: DataFrame, as_of: Column | str, max_age: int = 3600, cap: int | None = None
) -> DataFrame:
    """Finished jobs older than an hour go; with a ``cap``, the oldest finished above it too.

    Unfinished jobs always stay, so the number of finished ones that may stay is
    the cap less the unfinished.
    """
    done = F.col("status").isin(fixed.FINISHED_STATUSES)
    at = F.coalesce("completed_at", "created_at")
    old = done & (F.unix_micros(col(as_of)) - F.unix_micros(at) > max_age * 1_000_000)
    kept = jobs.where(~F.coalesce(old, F.lit(False)))
    if cap is None:
        return kept
    running = kept.where(~done)
    room = running.agg(F.greatest(F.lit(cap) - F.count(F.lit(1)), F.lit(0)).alias("n")).scalar()
    # At most ``cap`` finished jobs can stay, so the sort is a top-k.
    finished = kept.where(done).orderBy(F.desc_nulls_last("created_at"), F.desc("job_id")).limit(cap)
    rank = F.row_number().over(Window.orderBy(F.desc_nulls_last("created_at"), F.desc("job_id")))
    return running.unionByName(
        finished.withColumn("_r", rank).where(F.col("_r") <= room).drop("_r")
    )


# --- sync and media ---------------------------------------------------------

def sync_plan(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Every local file with ``upload`` or ``skip``."""
    there = remote.select("week", "name").distinct().withColumn("_there", F.lit(True))
    return local.join(there, ["week", "name"], "left").select(
        *local.columns, F.when(F.col("_there"), "skip").otherwise("upload").alias("action")
    )


def size_report(media: DataFrame, quota_bytes: int) -> DataFrame:
    """Bytes before and after compression, what was saved, and storage used.

    ``media``: size, compressed_size (null when not converted).
    """
    mb = 1024 * 1024
    before = F.sum(F.when(F.col("compressed_size").isNotNull(), F.col("size")))
    after = F.sum("compressed_size")
    used = F.sum(F.coalesce("compressed_size", "size"))
    return media.agg(
        F.count("compressed_size").alias("converted"),
        F.round(before / mb, 1).alias("before_mb"),
        F.round(after / mb, 1).alias("after_mb"),
        F.round((before - after) / mb, 1).alias("saved_mb"),
        F.round((before - after) / before * 100, 1).alias("saved_percent"),
        F.round(used / quota_bytes * 100, 2).alias("storage_percent"),
    )


def feed_items(media: DataFrame, base_url: str) -> DataFrame:
    """One feed item per media file, newest first.

    ``media``: path relative to the root, week (its folder), name, size, modified.
    """
    url = F.concat(F.lit(base_url.rstrip("/") + "/"), F.replace("path", F.lit(" "), F.lit("%20")))
    return media.where(F.lower("name").rlike(r"\.(mp3|wav)$")).select(
        F.concat("week", F.lit(": "), "name").alias("title"),
        url.alias("guid"),
        F.struct(
            url.alias("_url"),
            F.when(F.endswith("name", F.lit(".mp3")), "audio/mpeg").otherwise("audio/wav").alias("_type"),
            F.col("size").cast("string").alias("_length"),
        ).alias("enclosure"),
        F.date_format("modified", "dd MMM yyyy HH:mm:ss '-0000'").alias("pubDate"),
        "modified",
    ).orderBy(F.desc("modified"), "guid")


def feed_xml(items: DataFrame) -> DataFrame:
    """Each item as an XML element."""
    return items.select(
        F.to_xml(
            F.struct("title", "enclosure", "guid", "pubDate"), {"rowTag": "item"}
        ).alias("xml"),
        "modified", "guid",
    )


def write_feed(items: DataFrame, path: str) -> None:
    """The feed body as XML files."""
    items.drop("modified").write.mode("overwrite").format("xml").option("rootTag", "channel").option(
        "rowTag", "item"
    ).save(path)
