"""Keeping the target table: C10, C11, C18, T8."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsmill.operators import load, schedule
from newsmill.operators.joins import uncovered
from newsmill.sources.pages import archive_posts


def backfill_posts(archive_pages: DataFrame, target: DataFrame, since: str | None = None) -> DataFrame:
    """C11, first half: archive posts on days the target has no rows for."""
    posts = archive_posts(archive_pages, since)
    return uncovered(posts, load.covered_days(target))


def backfill(
    posts: DataFrame,
    post_pages: DataFrame,
    target: DataFrame,
    extract: Callable[[DataFrame], DataFrame],
    order: str = "row_no",
) -> tuple[DataFrame, DataFrame]:
    """C11, second half: the new target and the totals of the run.

    ``post_pages``: page_id, url, html of landed posts; a missing post has no html.
    """
    wanted = post_pages.join(posts.select("url").distinct(), "url", "left_semi")
    items = extract(wanted.where("html is not null"))
    result = load.append_new(items, target, order=order)
    totals = load.backfill_totals(
        wanted.select("url", F.col("html").isNull().alias("error")), items.select("url"), target
    )
    return result, totals


def storage_plan(
    local: DataFrame, remote: DataFrame, as_of: Column, days: int = 30
) -> tuple[DataFrame, DataFrame]:
    """What to upload and what may be deleted."""
    return schedule.sync_plan(local, remote), schedule.old_media(remote, as_of, days)


def resume(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The output of a stage; built only when no complete one is there."""
    jvm = spark._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    fs = done.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
