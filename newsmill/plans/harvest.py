"""From landed pages to item rows: C1-C5, C17, X1."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from newsmill import fixed
from newsmill.functions import dates, markup, text as tx, urls
from newsmill.functions.arrays import first_present, let, squeeze
from newsmill.operators import rules as rl
from newsmill.operators.dedup import drop_contained, keep_first
from newsmill.operators.joins import resolve_redirects
from newsmill.operators.ordered import last_rows
from newsmill.sources import feeds as fd, pages as pg
from newsmill.operators.rows import settle, unnest

ITEM_COLUMNS = [
    "title", "url", "original_url", "source_name", "source_url", "category", "description",
    "author", "date_published",
]


POST_CONTENT = r"""(?is)<div\b[^>]*\sclass\s*=\s*["']?[^"'>]*\bpost-content\b[^>]*>(.*)$"""


def _as_items(df: DataFrame, order: Sequence[str], **values: Column) -> DataFrame:
    return df.select(
        *[values.get(c, F.lit("")).alias(c) for c in ITEM_COLUMNS], *order
    )


def _follow(df: DataFrame, redirects: DataFrame | None, url: str) -> DataFrame:
    """J4 where a redirect table is given."""
    if redirects is None:
        return df.withColumn("_final", F.col(url))
    return resolve_redirects(df, redirects, url, "_final")


def page_links(pages: DataFrame) -> DataFrame:
    """The minimum slice: every link of every page, absolute and canonical."""
    rows = unnest(pages, markup.links("html"), "a", "pos", "page_id", "url")
    return rows.where(~urls.is_skippable("a.href")).select(
        "page_id", F.col("url").alias("source_url"), "pos",
        F.col("a.href").alias("href"),
        F.col("a.text").alias("text"),
        urls.clean_url(urls.absolute_url("a.href", "url")).alias("url"),
    )


def link_hosts(pages: DataFrame) -> DataFrame:
    """Distinct links per source host: the flagship query."""
    first = keep_first(settle(page_links(pages)), ["page_id", "url"], ["pos"])
    return (
        first.groupBy(urls.hostname("source_url").alias("host"))
        .agg(
            F.count(F.lit(1)).alias("links"),
            F.min("url").alias("first_url"),
            F.max("url").alias("last_url"),
        )
    )


def harvest_links(
    pages: DataFrame,
    rules: DataFrame | None = None,
    redirects: DataFrame | None = None,
    overrides: Mapping[str, Any] | None = None,
    apply_rules: bool = True,
    keep_rejected: bool = False,
) -> DataFrame:
    """Links of newsletter pages with category, context, source and day.

    A URL counts as seen before it is filtered, so a rejected first hit hides a later
    one.  ``keep_rejected`` keeps the rejected rows with their ``reject_reason``.
    """
    content = first_present(
        markup.element(F.col("html"), "article"), markup.element(F.col("html"), "body"), F.col("html")
    )
    post = F.regexp_extract("html", POST_CONTENT, 1)
    sections = pages.select(
        "page_id", "url",
        markup.site_name("html", "url").alias("source_name"),
        markup.published_day("html", "url").alias("date_published"),
        markup.blocks(first_present(post, content)).alias("_blocks"),
    ).withColumn("_body", markup.with_sections(F.col("_blocks"), markup.is_heading))
    blocks = unnest(sections, "_body", "b", "_i", "page_id", "url", "source_name", "date_published")
    found = unnest(
        blocks, markup.links("b.body"), "a", "pos",
        "page_id", F.col("url").alias("source_url"), "source_name", "date_published",
        F.col("b.section").alias("category"), F.col("b.pos").alias("block"),
        markup.link_context("b.text").alias("description"),
    )
    usable = found.where(
        ~urls.is_skippable("a.href") & ~urls.is_internal_mark("a.href")
    ).withColumn("_href", urls.unwrap_redirect("a.href"))
    final = _follow(usable, redirects, "_href").withColumn("url", urls.clean_url("_final"))
    first = keep_first(settle(final), ["page_id", "url"], ["block", "pos"])
    items = _as_items(
        first, ["page_id", "block", "pos"],
        title=first_present(F.col("a.text"), urls.slug_title("url")),
        url=F.col("url"),
        original_url=F.col("a.href"),
        source_name=F.col("source_name"),
        source_url=F.col("source_url"),
        category=F.col("category"),
        description=F.col("description"),
        date_published=F.coalesce("date_published", F.lit("")),
    )
    return filter_items(items, rules, overrides, keep_rejected) if apply_rules else items


def filter_items(
    items: DataFrame,
    rules: DataFrame | None,
    overrides: Mapping[str, Any] | None = None,
    keep_rejected: bool = False,
    page: str = "source_url",
) -> DataFrame:
    """The rule set of the page decides about its items."""
    if rules is None and not overrides:
        return items.withColumn("reject_reason", F.lit(None).cast("string")) if keep_rejected else items
    if rules is None:
        rule, base = rl.rule_columns(overrides), items
    else:
        base = rl.attach_rules(items, rules, page, overrides)
        rule = rl.columns_of(base)
    judged = base.withColumn(
        "reject_reason", rl.reject_reason("url", "title", "description", "category", rule)
    ).select(*items.columns, "reject_reason")
    if not keep_rejected:
        judged = settle(judged)
    return judged if keep_rejected else judged.where("reject_reason is null").drop("reject_reason")


def harvest_generic(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """All external links of any page."""
    rows = unnest(
        pages, markup.links("html"), "a", "pos",
        "page_id", "url", markup.page_name("html", "url").alias("source_name"),
    ).where(~urls.is_skippable("a.href")).withColumn("_abs", urls.absolute_url("a.href", "url"))
    external = settle(rows).where(urls.netloc("_abs") != urls.netloc("url")).withColumnRenamed("url", "source_url")
    final = _follow(external, redirects, "_abs").withColumn("url", urls.clean_url("_final"))
    return _as_items(
        final, ["page_id", "pos"],
        title=first_present(F.col("a.text"), urls.slug_title("url", True)),
        url=F.col("url"),
        original_url=F.col("_abs"),
        source_name=F.col("source_name"),
        source_url=F.col("source_url"),
        category=F.lit("External Link"),
    )


def harvest_feed(
    feeds: DataFrame,
    start: str | None = None,
    end: str | None = None,
    per_feed: int | None = None,
) -> DataFrame:
    """Items of feeds, by day range (undated ones stay) and per-feed limit."""
    entries = fd.feed_entries(feeds).withColumn("published_date", dates.parse_feed_date("date_text"))
    entries = settle(entries).where(dates.in_day_range("published_date", start, end))
    if per_feed:
        entries = last_rows(entries, ["source_url"], [F.col("pos")], per_feed)
    items = _as_items(
        entries, ["pos", "published_date"],
        title=F.col("title"),
        url=urls.clean_url("link"),
        original_url=F.col("link"),
        source_name=F.col("source_name"),
        source_url=F.col("source_url"),
        category=F.lit("RSS Feed"),
        description=fd.feed_content("body"),
        author=F.col("author"),
        date_published=F.col("date_text"),
    )
    return items


def harvest_channel(
    pages: DataFrame, start: str | None = None, end: str | None = None, max_pages: int | None = None
) -> DataFrame:
    """C4: one item per message of a channel, over its landed history."""
    rows = pg.channel_history(pages, start, max_pages)
    url = F.when(F.col("best_link").isNotNull(), urls.clean_url("best_link")).otherwise(F.col("permalink"))
    keyed = settle(rows.withColumn("_url", url))
    first = keep_first(keyed, ["channel", "_url"], ["page_no", "pos"])
    items = _as_items(
        first, ["channel", "page_no", "pos"],
        title=F.col("text"),
        url=F.col("_url"),
        original_url=F.coalesce("best_link", "permalink"),
        source_name=F.col("source_name"),
        source_url=F.col("url"),
        category=F.lit("Telegram"),
        date_published=F.coalesce("date_published", F.lit("")),
    )
    day = dates.parse_item_date("date_published")
    dated = settle(items.withColumn("_day", day))
    return dated.where(dates.in_date_range("_day", start, end)).drop("_day")


def harvest_headlines(
    pages: DataFrame,
    rule: Mapping[str, Any],
    as_of: Column,
    source_name: Column | None = None,
) -> DataFrame:
    """Headline texts of newsletter issues.

    All order inside an issue (sections, repeats, containment) is settled on arrays of
    that issue; pages never meet.
    """
    r = rl.rule_columns(rule)
    body = markup.drop_elements(
        markup.drop_comments("html"),
        ["script", "style", "nav", "footer", "iframe", "header", "aside"],
    )
    content_of = lambda h: first_present(
        F.regexp_extract(h, POST_CONTENT, 1),
        *[markup.element(h, t) for t in ("article", "main", "body")],
        h,
    )
    strong = lambda b: markup.plain_text(markup.element(b["body"], "strong"), "")
    is_strong = lambda b: (
        (b["tag"] == "p") & (F.length(strong(b)) < 30) & F.lower(strong(b)).isin(fixed.STRONG_SECTIONS)
    )
    is_header = lambda b: (F.startswith(b["tag"], F.lit("h")) & (b["text"] != "")) | is_strong(b)
    header_text = lambda b: F.when(F.startswith(b["tag"], F.lit("h")), b["text"]).otherwise(strong(b))
    staged = pages.select("page_id", "url", let(body, content_of).alias("_content")).select(
        "page_id", "url", markup.blocks("_content", ("h2", "h3", "p", "li")).alias("_b")
    )
    headers = F.transform(
        F.filter("_b", is_header), lambda b: F.struct(b["pos"].alias("pos"), header_text(b).alias("text"))
    )
    staged = staged.withColumn("_h", headers)
    excluded = lambda h: rl.in_sections(h["text"], r["exclude_sections"])

    def place(b: Column) -> Column:
        before = F.filter("_h", lambda h: h["pos"] < b["pos"])
        open_ones = F.filter(before, lambda h: ~excluded(h))
        last = F.try_element_at(before, F.lit(-1))
        return F.struct(
            b["pos"].alias("pos"), b["tag"].alias("tag"), squeeze(b["text"]).alias("text"),
            b["body"].alias("body"),
            F.coalesce(F.try_element_at(open_ones, F.lit(-1))["text"], F.lit("General")).alias("section"),
            F.coalesce(excluded(last), F.lit(False)).alias("out"),
        )

    placed = staged.withColumn("_p", F.transform(F.filter("_b", lambda b: ~is_header(b)), place))
    exempt = F.array(*[F.lit(s) for s in fixed.OPEN_SECTIONS])

    def wanted(b: Column) -> Column:
        in_open = F.array_contains(exempt, F.lower(b["section"]))
        href = F.get(markup.links(b["body"]), F.lit(0))["href"]
        ok = (
            ~b["out"]
            & ((b["tag"] != "li") | in_open)
            & (F.length(b["text"]) >= 30)
            & ~tx.is_navigation(b["text"])
            & rl.is_trusted(href, b["section"], r["allowed_source_domains"], exempt)
            & ~rl.is_excluded(b["text"], r["exclude_patterns"])
        )
        if rule.get("require_include_pattern"):
            ok = ok & rl.is_included(b["text"], r["include_patterns"])
        return ok

    kept = placed.withColumn("_k", F.filter("_p", wanted))
    kept = kept.withColumn("_t", drop_contained(F.transform("_k", lambda b: b["text"])))
    rows = unnest(kept, "_t", "title", "pos", "page_id", "url", "_k")
    section = F.get(F.filter("_k", lambda b: b["text"] == F.col("title")), F.lit(0))["section"]
    return rows.select(
        "page_id", "pos", "title", "url", F.col("title").alias("content"),
        (source_name if source_name is not None else F.lit(rule.get("name") or "Newsletter")).alias("source_name"),
        F.lit("newsletter").alias("source_type"),
        as_of.alias("published_date"),
        F.col("title").alias("summary"),
        F.create_map(F.lit("section"), section).alias("metadata"),
    )


# --- routing (C17, X1) ------------------------------------------------------

@dataclass(frozen=True)
class Extractor:
    """Which pages an extractor takes, how it rewrites their URL, what it makes of them."""

    name: str
    can_handle: Callable[[str], Column]
    extract: Callable[[DataFrame], DataFrame]
    preprocess: Callable[[str], Column] = F.col


def default_extractors(redirects: DataFrame | None = None) -> list[Extractor]:
    kind = lambda name: (lambda url: urls.extractor(url) == name)
    channel = lambda p: harvest_channel(
        p.select(F.col("url").alias("channel"), F.lit(0).alias("page_no"), "url", "html")
    )
    feed = lambda p: harvest_feed(p.select("url", F.col("html").alias("xml")))
    return [
        Extractor("newsletter", kind("newsletter"), lambda p: harvest_links(p, redirects=redirects)),
        Extractor("channel", kind("channel"), channel, urls.channel_preview_url),
        Extractor("feed", kind("feed"), feed),
        Extractor("generic", lambda url: F.lit(True), lambda p: harvest_generic(p, redirects)),
    ]


def harvest_all(
    pages: DataFrame,
    extractors: Sequence[Extractor] | None = None,
    rules: DataFrame | None = None,
    rules_for: Sequence[str] | None = None,
) -> DataFrame:
    """Every page goes to the first extractor that takes it.

    Rules apply to all extractors, or only to those named in ``rules_for``.
    """
    out = None
    taken = F.lit(False)
    for e in extractors or default_extractors():
        mine = ~taken & e.can_handle("url")
        part = pages.where(mine).withColumn("url", e.preprocess("url"))
        items = e.extract(part).select(*ITEM_COLUMNS).withColumn("extractor", F.lit(e.name))
        if rules is not None and (rules_for is None or e.name in rules_for):
            items = filter_items(items, rules)
        out = items if out is None else out.unionByName(items)
        taken = taken | e.can_handle("url")
    return out


def route_sources(sources: DataFrame, by_host: bool = True) -> DataFrame:
    """C17: enabled sources with the type that decides how they are read."""
    inferred = urls.source_type_by_host("url") if by_host else urls.source_type("url")
    return sources.where("enabled").withColumn("type", first_present(F.col("type"), inferred))
