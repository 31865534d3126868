"""Feeds: S4, S5, F15 on videos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsmill.functions import dates, markup, urls
from newsmill.functions.arrays import first_present, let, squeeze
from newsmill.operators.rows import unnest

_ENTRY = (
    "struct<title:string, link:array<struct<_href:string,_VALUE:string>>, description:string, "
    "summary:string, content:string, pubDate:string, published:string, updated:string, "
    "author:struct<_VALUE:string,name:string>, creator:string>"
)
_FEED = f"struct<title:string, entry:array<{_ENTRY}>, channel:struct<title:string, item:array<{_ENTRY}>>>"
_OPTIONS = {"ignoreNamespace": "true", "mode": "PERMISSIVE"}

_VIDEO = "struct<videoId:string, title:string, published:string, author:struct<name:string>>"
_VIDEO_FEED = f"struct<entry:array<{_VIDEO}>>"


def feed_entries(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """Entries of RSS and Atom documents; entries without a link are dropped.

    ``feeds``: url of the feed and its XML.
    """
    doc = F.from_xml(F.col(xml), _FEED, _OPTIONS)

    def named(d: Column) -> Column:
        items, entries = d["channel"]["item"], d["entry"]
        title = F.trim(F.coalesce(d["channel"]["title"], d["title"]))
        return F.transform(
            F.when(F.coalesce(F.size(items), F.lit(0)) > 0, items).otherwise(entries),
            lambda e: F.struct(title.alias("feed"), e.alias("e")),
        )

    rows = unnest(
        feeds, let(doc, named), "x", "pos", F.col("url").alias("source_url")
    ).select(
        "source_url", "pos", F.col("x.e").alias("e"),
        first_present(F.col("x.feed"), urls.netloc("source_url")).alias("source_name"),
    )
    link = F.get("e.link", F.lit(0))
    target = first_present(link["_href"], F.trim(link["_VALUE"]))
    body = first_present(F.col("e.description"), F.col("e.summary"), F.col("e.content"))
    return rows.select(
        "source_url", "source_name", "pos",
        F.coalesce(squeeze("e.title"), F.lit("")).alias("title"),
        target.alias("link"),
        F.coalesce(F.trim(body), F.lit("")).alias("body"),
        F.coalesce(
            F.trim(first_present(F.col("e.pubDate"), F.col("e.published"), F.col("e.updated"))), F.lit("")
        ).alias("date_text"),
        F.coalesce(
            F.trim(first_present(F.col("e.author.name"), F.col("e.author._VALUE"), F.col("e.creator"))), F.lit("")
        ).alias("author"),
    ).where(F.col("link").isNotNull())


def feed_content(body: Column | str) -> Column:
    """Plain text of an entry body, which may hold markup."""
    return markup.plain_text(body, "")


def video_entries(feeds: DataFrame, limit: int | None = None, xml: str = "xml") -> DataFrame:
    """The videos of each channel feed (channel, xml), or its first ``limit``."""
    doc = F.from_xml(F.col(xml), _VIDEO_FEED, _OPTIONS)
    rows = unnest(feeds, doc["entry"] if limit is None else F.slice(doc["entry"], 1, limit), "v", "pos", "channel")
    return rows.select(
        "channel", "pos",
        F.col("v.videoId").alias("video_id"),
        F.coalesce("v.title", F.lit("")).alias("title"),
        F.coalesce("v.author.name", F.lit("")).alias("channel_name"),
        F.try_to_timestamp("v.published").alias("published"),
        F.col("v.published").alias("published_text"),
    ).where("video_id <> ''")


def scraped_videos(videos: DataFrame) -> DataFrame:
    """Flat form of nested video records (channel, pos, video)."""
    v = F.col("video")
    return videos.select(
        "channel", "pos",
        v["videoId"].alias("video_id"),
        F.get(v["title"]["runs"], F.lit(0))["text"].alias("title"),
        F.coalesce(F.get(v["ownerText"]["runs"], F.lit(0))["text"], F.lit("")).alias("channel_name"),
        v["publishedTimeText"]["simpleText"].alias("age_text"),
    )


def with_age(videos: DataFrame, as_of: Column) -> DataFrame:
    """F15."""
    return videos.withColumn("age_text", dates.age_text("published", as_of))
