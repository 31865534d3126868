"""Landed pages: S3, S6-S9 and the article bodies of F2."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from newsmill import fixed
from newsmill.functions import dates, markup, urls
from newsmill.functions.arrays import first_present, let, squeeze
from newsmill.operators.dedup import keep_first
from newsmill.operators.joins import skew_join
from newsmill.operators.ordered import last_rows
from newsmill.operators.rows import settle, unnest


def read_pages(spark: SparkSession, path: str, cap: int | None = None) -> DataFrame:
    """S3: landed pages with their whole bodies, or the first ``cap`` characters."""
    return spark.read.parquet(path).withColumn("html", markup.landed("html", cap))


def article_bodies(pages: DataFrame, key: str = "page_id", cap: int | None = None) -> DataFrame:
    """article text per page."""
    return pages.select(key, markup.article_text("html", cap).alias("article"))


# --- S6: post archives ------------------------------------------------------

_POST_TOKEN = r"(?is)(<a\b[^>]*>|<time\b[^>]*>[^<]*)"


def _post_tokens(html: Column) -> Column:
    tokens = F.regexp_extract_all(markup.drop_comments(html), F.lit(_POST_TOKEN), F.lit(1))
    return F.transform(
        tokens,
        lambda t, i: F.struct(
            i.alias("i"),
            F.when(
                F.startswith(F.lower(t), F.lit("<a")) & F.contains(markup.attribute(t, "href"), F.lit("/p/")),
                markup.attribute(t, "href"),
            ).alias("href"),
            F.when(
                F.startswith(F.lower(t), F.lit("<time")),
                first_present(markup.attribute(t, "datetime"), squeeze(F.regexp_replace(t, "(?s)<[^>]*>", ""))),
            ).alias("time"),
        ),
    )


def archive_posts(pages: DataFrame, since: str | None = None) -> DataFrame:
    """Post links of archive pages, one per slug, oldest first.

    ``pages``: archive, page_no, url, html.  The date is that of the nearest
    ``<time>``: after the link and before the next post, else before the link and
    after the previous post.  Posts from the first one older than ``since`` on are
    dropped, as a crawl would stop there.
    """
    tokens = pages.select("archive", "page_no", "url", _post_tokens(F.col("html")).alias("_t"))
    posts = unnest(
        tokens, F.filter("_t", lambda t: t["href"].isNotNull()), "a", "_i", "*"
    ).withColumn("slug", urls.post_slug("a.href"))
    t, a = F.col("_t"), F.col("a")
    other = lambda x: x["href"].isNotNull() & (urls.post_slug(x["href"]) != F.col("slug"))
    upper = F.coalesce(
        F.get(F.filter(t, lambda x: other(x) & (x["i"] > a["i"])), F.lit(0))["i"], F.size(t)
    )
    lower = F.coalesce(
        F.try_element_at(F.filter(t, lambda x: other(x) & (x["i"] < a["i"])), F.lit(-1))["i"], F.lit(-1)
    )
    timed = lambda x: x["time"].isNotNull()
    behind = F.filter(t, lambda x: timed(x) & (x["i"] > a["i"]) & (x["i"] < upper))
    ahead = F.filter(t, lambda x: timed(x) & (x["i"] < a["i"]) & (x["i"] > lower))
    found = F.coalesce(
        F.get(behind, F.lit(0))["time"], F.try_element_at(ahead, F.lit(-1))["time"]
    )
    rows = posts.select(
        "archive", "page_no", a["i"].alias("pos"), "slug",
        urls.absolute_url(a["href"], "url").alias("post_url"),
        dates.parse_archive_date(found).alias("day"),
    )
    first = keep_first(settle(rows), ["archive", "slug"], ["page_no", "pos"])
    if since:
        too_old = first.where(F.col("day") < F.to_date(F.lit(since))).groupBy("archive").agg(
            F.min(F.struct("page_no", "pos")).alias("_stop")
        )
        first = skew_join(first, too_old, "archive", "left").where(
            F.col("_stop").isNull() | (F.struct("page_no", "pos") < F.col("_stop"))
        ).drop("_stop")
    return first.select(
        "archive", F.col("post_url").alias("url"),
        F.date_format("day", "yyyy-MM-dd").alias("date"), "page_no", "pos",
    ).orderBy("archive", F.desc("page_no"), F.desc("pos"))


def latest_post(pages: DataFrame) -> DataFrame:
    """The first post link of each archive page."""
    hrefs = F.filter(
        markup.links("html"), lambda a: F.contains(a["href"], F.lit("/p/")) & a["href"].rlike("^(?:/|http)")
    )
    first = F.get(hrefs, F.lit(0))["href"]
    return pages.select("url", urls.absolute_url(first, "url").alias("latest")).where(
        F.col("latest").isNotNull()
    )


def post_links(pages: DataFrame) -> DataFrame:
    """S6, listing form: distinct post URLs of the page's own site, in page order."""
    rows = unnest(pages, markup.links("html"), "a", "pos", "url").select(
        "url", "pos", urls.absolute_url("a.href", "url").alias("post_url")
    )
    own = settle(rows).where(
        F.contains(urls.netloc("post_url"), urls.netloc("url"))
        & F.contains(F.lower(urls.path("post_url")), F.lit("/p/"))
    )
    return keep_first(own, ["url", "post_url"], ["pos"])


# --- S7: article archives ---------------------------------------------------

def archive_links(pages: DataFrame) -> DataFrame:
    """Candidate articles of an archive page.

    Links in article-like containers are taken first; a page without any gives
    the links whose path looks like an article.  Titles fall through heading, title
    class, surrounding heading, cleaned link text, URL.
    """
    h = markup.drop_comments("html")
    container = (
        r"""(?is)<(?:article|div)\b[^>]*\sclass\s*=\s*["']?[^"'>]*(?:post|article|entry|item)"""
        r"""[^>]*>(.*?)(?=<(?:article|div)\b[^>]*\sclass\s*=\s*["']?[^"'>]*(?:post|article|entry|item)|$)"""
    )
    cards = F.regexp_extract_all(h, F.lit(container), F.lit(1))
    carded = F.filter(
        F.transform(cards, lambda c: F.struct(F.get(markup.links(c), F.lit(0)).alias("a"), c.alias("around"))),
        lambda x: x["a"].isNotNull(),
    )
    by_path = F.transform(
        F.filter(markup.links("html"), lambda a: a["href"].rlike(fixed.ARCHIVE_PATH_PATTERN)),
        lambda a: F.struct(a.alias("a"), F.lit("").alias("around")),
    )
    either = let(carded, lambda c: F.when(F.size(c) > 0, c).otherwise(by_path))
    found = unnest(pages, either, "x", "pos", F.col("url").alias("page_url"))
    href, inner = F.col("x.a.href"), F.col("x.a.inner")
    usable = found.where(href.rlike("^(?:/|http)"))
    heading = lambda c: markup.plain_text(
        F.regexp_extract(c, r"(?is)<(h[1-6])\b[^>]*>(.*?)</\1\s*>", 2), ""
    )
    titled = lambda c: markup.plain_text(
        F.regexp_extract(c, r"""(?is)<([a-z]+)\b[^>]*\sclass\s*=\s*["']?[^"'>]*title[^>]*>(.*?)</\1\s*>""", 2), ""
    )
    raw = squeeze(
        F.regexp_replace(F.regexp_replace(F.col("x.a.text"), r"(?i)\d+\s*min\s*read", ""), r"[•·|]", " ")
    )
    slug = F.regexp_replace(
        F.element_at(F.filter(F.split(href, "/"), lambda p: (p != "") & ~F.startswith(p, F.lit("?"))), -1),
        r"(?i)\.(html?|php|aspx?).*$", "",
    )
    title = first_present(
        heading(inner), titled(inner), heading(F.col("x.around")), titled(F.col("x.around")),
        F.when((F.length(raw) > 10) & ~raw.rlike("^[A-Za-z]{1,20}$"), raw),
        urls.title_case(F.regexp_replace(slug, "[-_]", " ")),
        F.lit("(Untitled)"),
    )
    time_tag = markup.start_tag(F.col("x.around"), "time")
    date_text = first_present(
        markup.attribute(time_tag, "datetime"), markup.plain_text(markup.element(F.col("x.around"), "time"))
    )
    rows = usable.select(
        "page_url", "pos", urls.absolute_url(href, "page_url").alias("url"),
        title.alias("title"), date_text.alias("date_str"),
        dates.parse_feed_date(date_text).alias("date"), F.lit(True).alias("selected"),
    )
    return keep_first(settle(rows), ["page_url", "url"], ["pos"])


# --- S8, S9: message channels -----------------------------------------------

def _class_div(html: Column, name: str) -> Column:
    return F.regexp_extract(
        html, rf"""(?is)<div\b[^>]*\sclass\s*=\s*["']?[^"'>]*\b{name}\b[^>]*>(.*?)</div\s*>""", 1
    )


def best_link(hrefs: Column) -> Column:
    """The last article-like link, else the last link."""
    articles = F.filter(hrefs, lambda h: urls.is_article(h))
    return F.coalesce(F.try_element_at(articles, F.lit(-1)), F.try_element_at(hrefs, F.lit(-1)))


def page_messages(html: Column | str) -> Column:
    """Messages of a channel page as an array, in page order."""
    wrap = r"""(?i)<div\b[^>]*\btgme_widget_message_wrap\b[^>]*>"""
    blocks = F.split(markup.drop_comments(html), wrap)

    def message(block: Column, i: Column) -> Column:
        body = _class_div(block, "tgme_widget_message_text")
        hrefs = F.transform(markup.links(body), lambda a: a["href"])
        external = F.filter(
            hrefs, lambda x: F.startswith(x, F.lit("http")) & ~F.contains(x, F.lit("t.me"))
        )
        link = markup.attribute(markup.start_tag(block, "a", r"""\btgme_widget_message_date\b"""), "href")
        return F.struct(
            i.alias("pos"),
            markup.plain_text(body, "").alias("text"),
            markup.attribute(markup.start_tag(block, "time"), "datetime").alias("date_published"),
            let(external, best_link).alias("best_link"),
            F.nullif(link, F.lit("")).alias("permalink"),
            F.regexp_extract(link, r"/(\d+)$", 1).try_cast("long").alias("message_id"),
        )

    found = let(
        blocks, lambda b: F.transform(F.slice(b, F.lit(2), F.greatest(F.size(b) - 1, F.lit(0))), message)
    )
    return F.filter(found, lambda m: m["text"] != "")


def _named_channel(html: Column | str) -> Column:
    return first_present(
        markup.plain_text(_class_div(markup.drop_comments(html), "tgme_channel_info_header_title"), ""),
        F.lit("Telegram Channel"),
    )


def _message_rows(pages: DataFrame) -> DataFrame:
    rows = unnest(pages, "_m", "m", "_i", "channel", "page_no", "url", "source_name")
    return rows.select(
        "channel", "page_no", "url", "source_name", "m.*",
    ).withColumn("permalink", F.coalesce("permalink", "url"))


def channel_messages(pages: DataFrame) -> DataFrame:
    """One row per message of a channel page: text, time, links, permalink.

    ``pages``: channel, page_no, url, html.
    """
    return _message_rows(
        pages.select(
            "channel", "page_no", "url", _named_channel("html").alias("source_name"),
            page_messages("html").alias("_m"),
        )
    )


def channel_history(pages: DataFrame, start: str | None, max_pages: int | None = None) -> DataFrame:
    """Messages of the pages that a backwards reading of a channel takes.

    Reading stops after a page whose smallest message id is not below that of the
    page before, or whose messages reach back beyond ``start``; without ``start``
    only the first page is read.  ``max_pages`` can limit a reading, so that so many pages
    per channel are taken before any of them is parsed.
    """
    order = Window.partitionBy("channel").orderBy("page_no")
    most = max_pages if start else 1
    first = pages if most is None else last_rows(pages, ["channel"], [F.col("page_no")], most)
    parsed = settle(
        first.select(
            "channel", "page_no", "url", _named_channel("html").alias("source_name"),
            page_messages("html").alias("_m"),
        )
    )
    ids = F.transform("_m", lambda m: m["message_id"])
    days = F.transform("_m", lambda m: dates.parse_item_date(m["date_published"]))
    stats = parsed.withColumn("oldest_id", F.array_min(ids)).withColumn("oldest", F.array_min(days))
    ends = F.col("oldest_id").isNull() | F.coalesce(
        F.col("oldest_id") >= F.lag("oldest_id").over(order), F.lit(False)
    )
    if start:
        ends = ends | F.coalesce(F.col("oldest") < F.to_timestamp(F.lit(start)), F.lit(False))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    marked = stats.withColumn("_end", ends).withColumn(
        "_done", F.coalesce(F.max("_end").over(before), F.lit(False))
    )
    return _message_rows(marked.where(~F.col("_done")))
