"""Reports: C14, C15, C16."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from newsmill import fixed
from newsmill.functions import dates, text as tx
from newsmill.operators import digest as dg, usage
from newsmill.operators.ordered import last_rows
from newsmill.plans.enrich import with_model_text

FUNNEL = ["date", "chart_topic", "suppressed_topic", "cached", "no_transcript"]


def judge_videos(
    videos: DataFrame,
    transcripts: DataFrame,
    state: DataFrame,
    start: str | None = None,
    end: str | None = None,
    ascii_boundary: bool = False,
) -> DataFrame:
    """C14, first half: videos with the gate they fall at and the cleaned transcript.

    ``videos``: video_id, title, channel, channel_name, published_date.
    """
    known = state.select(F.col("id").alias("video_id")).distinct().withColumn("_known", F.lit(True))
    spoken = transcripts.select(
        "video_id", tx.clean_transcript("vtt", ascii_boundary=ascii_boundary).alias("transcript")
    )
    joined = videos.join(known, "video_id", "left").join(spoken, "video_id", "left")
    source = F.concat_ws(" ", "channel", "channel_name")
    reason = (
        F.when(~dates.in_day_range("published_date", start, end), "date")
        .when(tx.is_chart_topic("title", ascii_boundary), "chart_topic")
        .when(tx.is_suppressed_topic("title", source, ascii_boundary=ascii_boundary), "suppressed_topic")
        .when(F.col("_known"), "cached")
        .when(F.coalesce("transcript", F.lit("")) == "", "no_transcript")
    )
    return joined.withColumn("reject_reason", reason).drop("_known")


def video_items(
    judged: DataFrame,
    per_channel: int | None = None,
    order: str = "pos",
    model: Callable[[list[str]], list[str | None]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """C14, second half: digest items, and the ids to mark as processed.

    A video the model skips is no item but counts as processed (P28).
    """
    ready = judged.where("reject_reason is null")
    if per_channel:
        ready = last_rows(ready, ["channel"], [F.col(order)], per_channel)
    told = with_model_text(ready, "transcript", "summary", model)
    told = told.where("summary <> ''")
    items = told.where(~tx.is_model_skip("summary")).select(
        "title",
        F.concat(F.lit("https://www.youtube.com/watch?v="), "video_id").alias("url"),
        F.col("transcript").alias("content"),
        F.coalesce(F.nullif("channel_name", F.lit("")), F.lit("YouTube")).alias("source_name"),
        F.lit("youtube").alias("source_type"),
        "published_date", "summary",
        F.create_map(F.lit("video_id"), F.col("video_id")).alias("metadata"),
    )
    return items, told.select(F.col("video_id").alias("id"))


def video_funnel(judged: DataFrame) -> DataFrame:
    """A16."""
    return dg.funnel(judged, FUNNEL)


def render_digest(items: DataFrame, calendar_year: bool = False) -> DataFrame:
    """The lines of one digest per ISO week, undated items under ``recent``."""
    labelled = dg.with_week(items, "published_date", calendar_year).withColumn(
        "week", F.when(F.col("published_date").isNull(), "recent").otherwise(F.col("week"))
    )
    return dg.digest_lines(labelled, "week")


def usage_report(
    calls: DataFrame,
    as_of: Column,
    pricing: DataFrame | None = None,
    limits: Mapping[str, Any] = fixed.DEFAULT_LIMITS,
) -> dict[str, DataFrame]:
    """Every table of the usage report."""
    priced = usage.price_calls(calls, pricing)
    running = usage.running_usage(priced)
    return {
        "priced": priced,
        "by_day": usage.rollup(priced, "day"),
        "by_month": usage.rollup(priced, "month"),
        "tasks": usage.task_totals(priced, as_of),
        "history": usage.daily_history(priced, as_of),
        "snapshot": usage.usage_snapshot(priced, as_of, limits),
        "recent": usage.recent_calls(priced),
        "running": running,
        "log": usage.last_calls(priced),
    }
