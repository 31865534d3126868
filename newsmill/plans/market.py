"""Market newsletters: C6, C7."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from newsmill import fixed
from newsmill.functions import dates, markup, text as tx, urls
from newsmill.functions.arrays import contains_any, let
from newsmill.operators import rules as rl
from newsmill.operators.dedup import keep_first, keep_first_prefix
from newsmill.operators.joins import resolve_redirects
from newsmill.operators.rows import settle, unnest
from newsmill.session import durable

def _in_section(lines: Column, is_start, ends) -> Column:
    """Lines between a start line and the next line that holds an end marker.

    A line belongs to a section when the last marker line before it is a start.
    """
    found = F.filter(
        F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))),
        lambda m: is_start(m["x"]) | contains_any(m["x"], ends),
    )

    def pick(marks: Column) -> Column:
        def stretch(m: Column, i: Column) -> Column:
            # lines between a marker and the next; Spark counts a slice from 1
            after = F.coalesce(F.get(marks, i + 1)["i"], F.size(lines))
            return F.when(is_start(m["x"]), F.slice(lines, m["i"] + 2, after - m["i"] - 1)).otherwise(F.array())

        return F.flatten(F.transform(marks, stretch))

    return let(found, pick)


def section_lines(pages: DataFrame) -> DataFrame:
    """Lines of the markets and roundup sections of each issue."""
    market = lambda x: x.isin(fixed.MARKET_STARTS) | F.startswith(x, F.lit("*Markets"))
    roundup = lambda x: x == fixed.ROUNDUP_START
    market_ends = [m for m in fixed.MARKET_ENDS if m != "*Markets"]
    staged = pages.select("page_id", "url", markup.text_lines("html").alias("_l"))
    return staged.select(
        "page_id", "url",
        _in_section(F.col("_l"), market, market_ends).alias("market_lines"),
        _in_section(F.col("_l"), roundup, fixed.ROUNDUP_ENDS).alias("roundup_lines"),
    )


def _passes(text: Column, rule: Mapping[str, Any], r: Mapping[str, Column]) -> Column:
    ok = ~rl.is_excluded(text, r["exclude_patterns"])
    if rule.get("require_include_pattern"):
        ok = ok & rl.is_included(text, r["include_patterns"])
    return ok


def market_lines(pages: DataFrame, rule: Mapping[str, Any]) -> DataFrame:
    """Market bullets (P21) and roundup headlines (P22), one per opening of 50 characters."""
    r = rl.rule_columns(rule)
    s = section_lines(pages)
    label = lambda lines, section: F.transform(
        F.col(lines), lambda x, i: F.struct(F.lit(section).alias("section"), i.alias("pos"), x.alias("line"))
    )
    parts = [label("roundup_lines", "Headline Roundup")]
    if rule.get("extract_markets_section", True):
        parts.insert(0, label("market_lines", "Markets"))
    # The lines of a page are read once, for both sections.
    rows = unnest(s, F.concat(*parts), "x", "_i", "page_id", "url").select("page_id", "url", "x.*")
    line, market = F.col("line"), F.col("section") == "Markets"
    judged = settle(
        rows.select(
            "page_id", "url", "pos", "section",
            F.when(market, F.when((F.length(line) >= 15) & tx.is_market_line(line), line))
            .when(tx.is_headline(line), tx.strip_suffixes(line)).alias("title"),
        )
    ).where("title is not null")
    first = keep_first_prefix(judged, "title", ["pos"], within=["page_id", "section"])
    text = F.when(market, "Markets section bullet point").otherwise("Headline Roundup")
    return first.where(_passes(F.col("title"), rule, r)).select("page_id", "url", "pos", "title", "section", text.alias("description"))


def linked_headlines(pages: DataFrame, rule: Mapping[str, Any]) -> DataFrame:
    """Linked headlines with section, context and source."""
    r = rl.rule_columns(rule)
    tags = ("h1", "h2", "h3", "h4", "p", "li", "div")
    staged = pages.where(markup.may_link("html")).select("page_id", "url", markup.blocks("html", tags).alias("_b"))
    named = F.transform(
        F.col("_b"),
        lambda b: F.struct(
            b["pos"].alias("pos"),
            F.coalesce(
                markup.keyword_section(b["text"], None),
                F.lit(None).cast("string"),
            ).alias("name"),
        ),
    )
    names = F.filter(named, lambda n: n["name"].isNotNull())

    def placed(heads: Column) -> Column:
        # each block under the last heading up to it: as often as there are blocks to the next
        stretch = lambda n, i: F.array_repeat(
            n["name"], F.coalesce(F.get(heads, i + 1)["pos"], F.size("_b")) - n["pos"]
        )
        before = F.array_repeat(F.lit("General"), F.coalesce(F.get(heads, F.lit(0))["pos"], F.size("_b")))
        return F.concat(before, F.flatten(F.transform(heads, stretch)))

    under = F.arrays_zip(F.col("_b").alias("b"), let(names, placed).alias("section"))
    linked = F.filter(under, lambda x: F.contains(F.lower(x["b"]["body"]), F.lit("<a")))
    rows = unnest(
        unnest(staged, linked, "x", "_i", "page_id", "url"), markup.links("x.b.body"), "a", "pos",
        "page_id", F.col("url").alias("page_url"), "x.section", F.col("x.b.pos").alias("block"),
        F.col("x.b.text").alias("parent_text"),
    ).where(F.startswith("a.href", F.lit("http")))
    rows = settle(rows.withColumn("url", urls.clean_url_prefixes("a.href")))
    first = keep_first(rows, ["page_id", "url"], ["block", "pos"])
    out = first.where(~rl.is_blocked("url", r["blocked_domains"])).select(
        "page_id", "page_url", "url", "block", "pos",
        tx.linked_headline("a.text", "parent_text").alias("title"),
        "parent_text", "section",
    )
    combined = F.concat_ws(" ", "title", "parent_text")
    return settle(out).where(
        tx.is_linked_headline("title")
        & ~rl.in_sections("section", r["exclude_sections"])
        & _passes(combined, rule, r)
    )


def market_digest(pages: DataFrame, rule: Mapping[str, Any]) -> DataFrame:
    """All headlines of the issues, oldest issue first, undated issues before all."""
    # Read for the digest and for what its links repeat.
    lines = durable(market_lines(pages, rule), "market_lines")
    seen = lines.select("page_id", F.lower(F.left("title", F.lit(50))).alias("_k")).distinct()
    links = linked_headlines(pages, rule).withColumn("_k", F.lower(F.left("title", F.lit(50))))
    links = links.join(seen, ["page_id", "_k"], "left_anti")
    plain = lines.select(
        "page_id", F.lit(None).cast("string").alias("url"), "title", "description", "section",
        F.lit(fixed.MARKET_SOURCE).alias("source"),
        F.when(F.col("section") == "Markets", 0).otherwise(1).alias("part"),
        F.lit(0).alias("block"), "pos",
    )
    linked = links.select(
        "page_id", "url", "title", F.col("parent_text").alias("description"), "section",
        urls.source_display_name("url").alias("source"), F.lit(2).alias("part"), "block", "pos",
    )
    issue = settle(
        pages.select("page_id", F.col("url").alias("source_url"), markup.newsletter_date_text("html").alias("newsletter_date"))
    )
    issue = settle(issue.withColumn("issue_date", dates.parse_newsletter_date("newsletter_date")))
    out = plain.unionByName(linked).join(issue, "page_id").withColumn(
        "newsletter_date", F.when(F.col("part") == 2, F.col("newsletter_date"))
    )
    return out.orderBy(F.col("issue_date").asc_nulls_first(), "page_id", "part", "block", "pos")


def digest_speech(items: DataFrame) -> DataFrame:
    """The spoken lines of the digest."""
    return items.where(tx.is_speakable("title")).withColumn(
        "line", tx.spoken_headline(F.trim("title"))
    )


def training_links(
    pages: DataFrame, rule: Mapping[str, Any], redirects: DataFrame | None = None
) -> DataFrame:
    """Every outbound link with its section and whether the rules reject it."""
    r = rl.rule_columns(rule)
    headed = markup.blocks("html", ("h1", "h2", "h3", "h4", "strong", "b", "p", "li", "div"))
    staged = pages.select("page_id", "url", headed.alias("_b"))
    heads = F.filter("_b", lambda b: b["tag"].isin("h1", "h2", "h3", "h4", "strong", "b") & (b["text"] != ""))
    staged = staged.withColumn(
        "_h",
        F.filter(
            F.transform(heads, lambda b: F.struct(b["pos"].alias("pos"), markup.training_section(b["text"]).alias("name"))),
            lambda h: h["name"] != "Unknown",
        ),
    )
    rows = unnest(
        unnest(staged, "_b", "b", "_i", "page_id", "_h"), markup.links("b.body"), "a", "pos",
        "page_id", "_h", F.col("b.pos").alias("block"), F.col("b.text").alias("parent_text"),
    ).where(F.startswith("a.href", F.lit("http")))
    first = keep_first(rows.withColumn("raw_url", F.col("a.href")), ["page_id", "raw_url"], ["block", "pos"])
    section = F.coalesce(
        F.try_element_at(F.filter("_h", lambda h: h["pos"] < F.col("block")), F.lit(-1))["name"],
        F.lit("Unknown"),
    )
    judged = first.select(
        "page_id", "block", "pos", "raw_url", F.col("a.text").alias("title"),
        F.col("parent_text").alias("description"), section.alias("section"),
        rl.is_blocked("raw_url", r["blocked_domains"]).alias("is_blocked"),
        rl.is_excluded(F.concat_ws(" ", F.col("a.text"), "parent_text"), r["exclude_patterns"]).alias("matches_exclude"),
    )
    if redirects is not None:
        judged = resolve_redirects(judged, redirects, "raw_url", "_resolved")
    else:
        judged = judged.withColumn("_resolved", F.col("raw_url"))
    target = F.when(F.col("is_blocked"), F.col("raw_url")).otherwise(F.col("_resolved"))
    out = judged.withColumn("url", urls.clean_url_prefixes(target))
    return out.withColumn("source", urls.source_abbreviation("url")).drop("_resolved")
