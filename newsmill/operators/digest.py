"""Digest assembly: A1, A13, A14, A16, O1, O2, S15, S20."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from newsmill import fixed
from newsmill.functions import text as tx, urls
from newsmill.functions.arrays import first_present
from newsmill.functions.dates import week_label
from newsmill.operators.joins import skew_join

ORDER = ["type_rank", "source_first", "source_name_key", "kind", "recency", "item_id", "part"]


def newest_first(items: DataFrame, date: str = "published_date") -> DataFrame:
    """O1."""
    return items.orderBy(F.col(date).desc_nulls_last())


def oldest_first(items: DataFrame, date: str = "newsletter_date") -> DataFrame:
    """O2."""
    return items.orderBy(F.col(date).asc_nulls_first())


def count_by_type(items: DataFrame) -> DataFrame:
    """A1."""
    return items.groupBy("source_type").agg(F.count(F.lit(1)).alias("items"))


def funnel(items: DataFrame, reasons: Sequence[str], reason: str = "reject_reason") -> DataFrame:
    """How many items fell at each gate, and how many are left."""
    return items.agg(
        F.count(F.lit(1)).alias("checked"),
        *[F.count_if(F.col(reason) == r).alias(r) for r in reasons],
        F.count_if(F.col(reason).isNull()).alias("kept"),
    )


def spoken_source(name: Column) -> Column:
    """Readable source of an article; a URL gives way to the name of its host."""
    host = F.replace(urls.netloc(name), F.lit("www."), F.lit(""))
    known = None
    for key, value in fixed.SPOKEN_SOURCE_NAMES.items():
        known = F.when(host == key, value) if known is None else known.when(host == key, value)
    from_url = known.otherwise(urls.title_case(F.substring_index(host, ".", 1)))
    return (
        F.when(F.contains(name, F.lit("http")), from_url)
        .when(F.coalesce(name, F.lit("")) == "", "the newsletter")
        .otherwise(name)
    )


def _item_lines() -> Column:
    """The one or two lines of an item, by its type; null where there is nothing to say."""
    title = tx.spoken_title(F.coalesce("title", F.lit("")))
    date = F.coalesce(F.date_format("published_date", "MMMM dd, yyyy"), F.lit("recent"))
    body = first_present(F.col("summary"), F.col("content"))
    say = lambda fmt, *args: F.format_string(fmt, *args)
    intro = (
        F.when(
            F.col("source_type") == "youtube",
            say("\nRegarding the video titled %s, published %s.\n", title, date),
        )
        .when(
            F.col("source_type") == "article_archive",
            say("\nFrom %s, an article titled %s, dated %s.\n", spoken_source(F.col("source_name")), title, date),
        )
        .when(
            F.col("source_type") == "rss",
            say("\nFrom %s, %s, dated %s.\n", F.col("source_name"), title, date),
        )
    )
    headline = tx.spoken_title(first_present(F.col("summary"), F.col("content"), F.col("title")))
    return F.when(F.col("source_type") == "newsletter", F.array(headline)).otherwise(
        F.array(intro, F.concat(body, F.lit("\n")))
    )


def _type_rank() -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in fixed.SOURCE_TYPE_ORDER]), F.col("source_type"))


def digest_lines(items: DataFrame, digest: str = "digest") -> DataFrame:
    """Every line of every digest with the keys that put it in its place.

    Items are ordered by type, newsletters also by source in order of first
    appearance, then newest first.  A digest may be larger than a task, so its
    lines stay rows; :func:`write_digests` sorts them into files.
    """
    placed = items.where(F.col("source_type").isin(fixed.SOURCE_TYPE_ORDER)).select(
        digest, "item_id", "source_type",
        F.when(F.col("source_type") == "newsletter", F.coalesce("source_name", F.lit("")))
        .otherwise("").alias("source_name_key"),
        _type_rank().cast("long").alias("type_rank"),
        # Sorting by falling date: the later the date, the smaller the number.
        F.coalesce(F.negate(F.unix_micros(F.col("published_date").cast("timestamp"))), F.lit(2**62)).alias("recency"),
        _item_lines().alias("_lines"),
    )
    group = [digest, "source_type", "type_rank", "source_name_key"]
    sources = placed.groupBy(*group).agg(
        F.min(F.struct("recency", "item_id")).alias("_first")
    ).withColumn(
        # Only newsletters are split by source.
        "source_first",
        F.when(F.col("source_type") == "newsletter", F.col("_first.recency")).otherwise(F.lit(0)),
    )
    intro = (
        F.when(F.col("source_type") == "youtube", "\nFrom YouTube videos:\n")
        .when(F.col("source_type") == "article_archive", "\nFrom articles:\n")
        .when(F.col("source_type") == "rss", "\nFrom RSS feeds:\n")
        .otherwise(F.concat(F.lit("\nFrom "), F.col("source_name_key"), F.lit(" Newsletter:\n")))
    )
    headers = sources.select(
        digest, "type_rank", "source_first", "source_name_key", F.lit(0).alias("kind"),
        F.lit(0).cast("long").alias("recency"), F.lit(0).cast("long").alias("item_id"),
        F.lit(0).alias("part"), intro.alias("line"),
    )
    grouped = placed.withColumn("_g", F.concat_ws("\x01", F.col(digest), "source_type", "source_name_key"))
    firsts = sources.select(
        F.concat_ws("\x01", F.col(digest), "source_type", "source_name_key").alias("_g"), "source_first"
    )
    lines = skew_join(grouped, firsts, "_g").select(
        digest, "type_rank", "source_first", "source_name_key", F.lit(1).alias("kind"),
        "recency", F.col("item_id").cast("long").alias("item_id"),
        F.posexplode("_lines").alias("part", "line"),
    )
    return headers.unionByName(lines.where(F.col("line").isNotNull() & (F.col("line") != "")))


def write_digests(lines: DataFrame, path: str, digest: str = "week") -> None:
    """Text files in one folder per week, lines in order.

    The rows are range-partitioned in digest order, so a large week spans several
    files whose names sort like their content.
    """
    (
        lines.repartitionByRange(digest, *ORDER)
        .sortWithinPartitions(digest, *ORDER)
        .select(digest, "line")
        .write.mode("overwrite").partitionBy(digest).text(path)
    )


def flatten_results(results: DataFrame) -> DataFrame:
    """Summaries in type order."""
    rank = F.array_position(F.array(*[F.lit(t) for t in fixed.RESULT_TYPE_ORDER]), F.col("source_type"))
    return results.where(rank > 0).withColumn("type_rank", rank.cast("long"))


def recent_digests(digests: DataFrame, audio: DataFrame, limit: int = 10) -> DataFrame:
    """Newest digests with a preview and an audio flag.

    ``digests``: folder, name, content; ``audio``: folder, name of media files.
    """
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    top = digests.orderBy(F.desc("folder"), F.desc("name")).limit(limit)
    have = audio.select(
        "folder", F.regexp_replace("name", r"\.(wav|mp3)$", "").alias("_audio")
    ).distinct().withColumn("has_audio", F.lit(True))
    return (
        top.withColumn("_audio", F.replace(stem, F.lit("summary"), F.lit("audio_quality")))
        .join(have, ["folder", "_audio"], "left")
        .select(
            "folder", "name",
            F.replace(stem, F.lit("summary_"), F.lit("")).alias("date"),
            F.when(
                F.length("content") > 200, F.concat(F.left("content", F.lit(200)), F.lit("..."))
            ).otherwise(F.col("content")).alias("preview"),
            F.coalesce("has_audio", F.lit(False)).alias("has_audio"),
        )
    )


def with_week(items: DataFrame, ts: str, calendar_year: bool = False) -> DataFrame:
    """F17 as the digest key."""
    return items.withColumn("week", week_label(ts, calendar_year))
