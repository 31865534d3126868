"""P rows of the inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsmill import fixed
from newsmill.functions import dates, markup, text as tx, urls
from newsmill.functions.arrays import trimmed
from newsmill.operators import rules as rl
from newsmill.suite.base import (
    LINKS, NEWS, absolute_sql, clean_url_sql, ends_any, has_any, links, netloc_sql, news,
    pairs_sql, path_sql, q, query, rebuild_sql, scheme_sql, squeeze_sql, sub, table, unescape_sql,
)
from newsmill.operators.rows import unnest


@query("p1_clean_url", f"SELECT page_id, {clean_url_sql('url', fixed.TRACKING_NAMES)} AS clean_url FROM pages")
def p1(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.clean_url("url").alias("clean_url"))


@query(
    "p2_clean_url_prefixes",
    "SELECT page_id, "
    + rebuild_sql(
        "url",
        f"list_filter({pairs_sql('url')}, lambda p: NOT ("
        + " OR ".join(f"starts_with(lower(split_part(p, '=', 1)), {q(x)})" for x in fixed.TRACKING_PREFIXES)
        + "))",
    )
    + " AS clean_url FROM pages",
)
def p2(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.clean_url_prefixes("url").alias("clean_url"))


@query("p3_absolute_url", f"WITH {LINKS} SELECT page_id, pos, {absolute_sql('href', 'url')} AS link FROM links")
def p3(spark, sf):
    return links(spark, sf).select("page_id", "pos", urls.absolute_url("href", "url").alias("link"))


@query(
    "p4_internal_links",
    f"""WITH {LINKS}, a AS (SELECT page_id, pos, url, href, {absolute_sql('href', 'url')} AS link FROM links)
    SELECT page_id, count(*) AS links,
           count(*) FILTER (WHERE {has_any('lower(href)', fixed.INTERNAL_MARKS)}) AS platform_links,
           count(*) FILTER (WHERE {has_any('lower(href)', fixed.INTERNAL_MARKS_DIGEST)}) AS navigation_links,
           count(*) FILTER (WHERE contains({netloc_sql('link')}, {netloc_sql('url')})) AS same_site
    FROM a GROUP BY page_id""",
)
def p4(spark, sf):
    a = links(spark, sf).withColumn("link", urls.absolute_url("href", "url"))
    return a.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("links"),
        F.count_if(urls.is_internal_mark("href")).alias("platform_links"),
        F.count_if(urls.is_internal_mark("href", fixed.INTERNAL_MARKS_DIGEST)).alias("navigation_links"),
        F.count_if(urls.is_same_site("link", "url")).alias("same_site"),
    )


_WRAPPED = (
    "SELECT page_id, url AS target, CASE WHEN starts_with(url, 'https') "
    "THEN 'https://links.beehiiv.com/c?x=1&dest=' || url_encode(url) "
    "ELSE 'https://mail.beehiiv.com/r/go?k=' || url_encode(url) END AS href FROM pages"
)


@query("p5_redirect_target", "SELECT page_id, target FROM (" + _WRAPPED + ")")
def p5(spark, sf):
    wrapped = table(spark, sf, "pages").select(
        "page_id",
        F.when(
            F.startswith("url", F.lit("https")),
            F.concat(F.lit("https://links.beehiiv.com/c?x=1&dest="), F.url_encode("url")),
        ).otherwise(F.concat(F.lit("https://mail.beehiiv.com/r/go?k="), F.url_encode("url"))).alias("href"),
    )
    return wrapped.select("page_id", urls.unwrap_redirect("href").alias("target"))


@query(
    "p6_usable_links",
    f"""WITH {LINKS} SELECT page_id, pos, href FROM links
    WHERE href <> '' AND NOT starts_with(href, '#') AND NOT starts_with(href, 'mailto:')""",
)
def p6(spark, sf):
    return links(spark, sf).where(~urls.is_skippable("href")).select("page_id", "pos", "href")


RULE = {
    "require_url": True,
    "exclude_categories": ["FR"],
    "include_patterns": ["The", "en"],
    "exclude_patterns": ["Spam", "pills"],
    "allowed_domains": ["example"],
    "blocked_domains": ["example.net"],
}


def _low(values):
    return [v.lower() for v in values]


REASON = f"""CASE WHEN trim(url) IN ('', '#') THEN 'no_url'
     WHEN category <> '' AND {has_any('lower(category)', _low(RULE['exclude_categories']))} THEN 'category'
     WHEN NOT {has_any("lower(url || ' ' || title || ' ' || description)", _low(RULE['include_patterns']))} THEN 'not_included'
     WHEN {has_any("lower(url || ' ' || title || ' ' || description)", _low(RULE['exclude_patterns']))} THEN 'excluded'
     WHEN NOT {has_any(netloc_sql('url'), RULE['allowed_domains'])} THEN 'domain_not_allowed'
     WHEN {has_any(netloc_sql('url'), RULE['blocked_domains'])} THEN 'domain_blocked' END"""

PAGE_ITEMS = f"""page_items AS (
  SELECT page_id, url, regexp_extract({path_sql('url')}, '^/([^/]*)', 1) AS category,
         {squeeze_sql(unescape_sql(sub("regexp_extract(html, '<title>(.*?)</title>', 1, 's')", '<[^>]*>', '')))} AS title,
         {squeeze_sql(unescape_sql(sub("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')", '<[^>]*>', ' ')))} AS description
  FROM pages)"""


def page_items(spark, sf):
    """Items made of whole pages: title, first heading as description, language as category."""
    return table(spark, sf, "pages").select(
        "page_id", "url",
        F.regexp_extract(urls.path("url"), "^/([^/]*)", 1).alias("category"),
        markup.page_title("html").alias("title"),
        markup.plain_text(markup.element(F.col("html"), "h1")).alias("description"),
    )


@query("p7_rule_filter", f"WITH {PAGE_ITEMS} SELECT page_id, {REASON} AS reject_reason FROM page_items")
def p7(spark, sf):
    rule = rl.rule_columns(RULE)
    return page_items(spark, sf).select(
        "page_id", rl.reject_reason("url", "title", "description", "category", rule).alias("reject_reason")
    )


# Dates of orders written in the formats that sources use.
DATE_TEXT = """date_text AS (SELECT o_orderkey, o_orderdate, CASE
    WHEN o_orderpriority = '1-URGENT' THEN strftime(o_orderdate, '%Y-%m-%d')
    WHEN o_orderpriority = '2-HIGH' THEN strftime(o_orderdate, '%d/%m/%Y')
    WHEN o_orderpriority = '3-MEDIUM' THEN strftime(o_orderdate, '%B %-d, %Y')
    WHEN o_orderpriority = '4-NOT SPECIFIED' THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')
    ELSE 'on ' || strftime(o_orderdate, '%Y') END AS txt FROM orders)"""


def date_text(spark, sf):
    o = table(spark, sf, "orders").withColumn("d", F.col("o_orderdate").cast("timestamp"))
    kind = F.col("o_orderpriority")
    return o.select(
        "o_orderkey", "d",
        F.when(kind == "1-URGENT", F.date_format("d", "yyyy-MM-dd"))
        .when(kind == "2-HIGH", F.date_format("d", "dd/MM/yyyy"))
        .when(kind == "3-MEDIUM", F.date_format("d", "MMMM d, yyyy"))
        .when(kind == "4-NOT SPECIFIED", F.date_format("d", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .otherwise(F.concat(F.lit("on "), F.date_format("d", "yyyy"))).alias("txt"),
    )


PARSED = f"""{DATE_TEXT}, parsed AS (SELECT o_orderkey, txt, CASE WHEN contains(txt, 'T') THEN
     try_strptime(replace(txt, 'Z', ''), '%Y-%m-%dT%H:%M:%S')
   ELSE coalesce(try_strptime(txt, '%Y-%m-%d'), try_strptime(txt, '%d/%m/%Y'), try_strptime(txt, '%m/%d/%Y'),
                 try_strptime(txt, '%B %d, %Y')) END AS d FROM date_text)"""


@query(
    "p8_date_range",
    f"""WITH {PARSED} SELECT o_orderkey, txt FROM parsed WHERE d IS NULL
     OR d BETWEEN TIMESTAMP '1996-03-01 00:00:00' AND TIMESTAMP '1998-06-30 23:59:59'""",
)
def p8(spark, sf):
    d = dates.parse_item_date("txt")
    return date_text(spark, sf).where(dates.in_date_range(d, "1996-03-01", "1998-06-30")).select("o_orderkey", "txt")


@query(
    "p9_dated_only",
    f"""WITH {NEWS} SELECT count(*) FILTER (WHERE published_date IS NOT NULL AND CAST(published_date AS DATE) = DATE '1998-10-03') AS on_day,
      count(*) FILTER (WHERE published_date IS NOT NULL AND published_date >= TIMESTAMP '1997-01-01 00:00:00') AS since
     FROM news""",
)
def p9(spark, sf):
    return news(spark, sf).agg(
        F.count_if(dates.on_day("published_date", "1998-10-03")).alias("on_day"),
        F.count_if(dates.since("published_date", "1997-01-01 00:00:00")).alias("since"),
    )


@query(
    "p10_day_range",
    f"""WITH {NEWS} SELECT item_id FROM news WHERE published_date IS NULL
     OR CAST(published_date AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1999-12-31'""",
)
def p10(spark, sf):
    return news(spark, sf).where(dates.in_day_range("published_date", "1995-01-01", "1999-12-31")).select("item_id")


_TYPE_A = (
    f"CASE WHEN {has_any('lower(url)', fixed.VIDEO_HOSTS)} THEN 'youtube' "
    f"WHEN {has_any('lower(url)', fixed.FEED_MARKS)} THEN 'rss' ELSE 'article_archive' END"
)
_TYPE_B = (
    f"CASE WHEN {has_any('lower(' + netloc_sql('url') + ')', fixed.VIDEO_HOSTS)} THEN 'youtube' "
    f"WHEN {has_any('lower(' + netloc_sql('url') + ')', fixed.NEWSLETTER_HOSTS)} THEN 'newsletter' "
    "WHEN contains(url, '/feed') OR contains(url, '/rss') OR ends_with(url, '.xml') THEN 'rss' ELSE 'newsletter' END"
)
_ROUTE = (
    f"CASE WHEN contains({netloc_sql('url')}, 'beehiiv.com') THEN 'newsletter' WHEN {netloc_sql('url')} = 't.me' THEN 'channel' "
    f"WHEN {has_any('lower(url)', fixed.FEED_MARKS_ROUTING)} THEN 'feed' ELSE 'generic' END"
)
# Source URLs of several kinds, derived from the page URLs by language.
SOURCES = f"""sources AS (SELECT page_id, CASE regexp_extract({path_sql('url')}, '^/([^/]*)', 1)
    WHEN 'en' THEN url WHEN 'de' THEN 'https://www.youtube.com/channel/' || page_id
    WHEN 'fr' THEN 'https://' || page_id || '.beehiiv.com/archive' WHEN 'es' THEN 'https://t.me/' || page_id
    ELSE regexp_extract(url, '^[^?#]*') || '/feed' END AS url FROM pages
    UNION ALL SELECT page_id, regexp_extract(url, '^[^?#]*') || '/feed.xml' AS url FROM pages)"""


def sources(spark, sf):
    p = table(spark, sf, "pages")
    lang, pid = F.regexp_extract(urls.path("url"), "^/([^/]*)", 1), F.col("page_id").cast("string")
    bare = F.regexp_extract("url", "^[^?#]*", 0)
    made = (
        F.when(lang == "en", F.col("url"))
        .when(lang == "de", F.concat(F.lit("https://www.youtube.com/channel/"), pid))
        .when(lang == "fr", F.concat(F.lit("https://"), pid, F.lit(".beehiiv.com/archive")))
        .when(lang == "es", F.concat(F.lit("https://t.me/"), pid))
        .otherwise(F.concat(bare, F.lit("/feed")))
    )
    return p.select("page_id", made.alias("url")).unionByName(
        p.select("page_id", F.concat(bare, F.lit("/feed.xml")).alias("url"))
    )


@query("p11_source_type", f"WITH {SOURCES} SELECT page_id, url, {_TYPE_A} AS source_type FROM sources")
def p11(spark, sf):
    return sources(spark, sf).select("page_id", "url", urls.source_type("url").alias("source_type"))


@query("p12_source_type_by_host", f"WITH {SOURCES} SELECT page_id, url, {_TYPE_B} AS source_type FROM sources")
def p12(spark, sf):
    return sources(spark, sf).select("page_id", "url", urls.source_type_by_host("url").alias("source_type"))


@query("p13_extractor", f"WITH {SOURCES} SELECT page_id, url, {_ROUTE} AS extractor FROM sources")
def p13(spark, sf):
    return sources(spark, sf).select("page_id", "url", urls.extractor("url").alias("extractor"))


@query(
    "p14_channel_preview",
    f"""WITH {SOURCES} SELECT page_id, CASE WHEN {netloc_sql('url')} = 't.me'
     THEN 'https://t.me/s/' || trim({path_sql('url')}, '/') ELSE url END AS url FROM sources""",
)
def p14(spark, sf):
    return sources(spark, sf).select("page_id", urls.channel_preview_url("url").alias("url"))


_P = f"trim({path_sql('url')}, '/')"


@query(
    "p15_article_url",
    f"SELECT page_id, (({_P} <> '' AND contains({_P}, '/')) OR length({_P}) > 20) AS is_article FROM pages",
)
def p15(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.is_article("url").alias("is_article"))


_TOPIC = "(?i)" + "|".join(fixed.CHART_TOPIC_PATTERNS)


@query(
    "p16_topic_filter",
    f"""SELECT doc_id, (regexp_matches(text, {q(_TOPIC)}) OR {has_any('lower(text)', fixed.CHART_TOPIC_KEYWORDS)}) AS is_topic,
     (regexp_matches(text, '(?i)\\bthe\\b.*\\band\\b')) AS has_words FROM documents""",
)
def p16(spark, sf):
    from newsmill.functions.patterns import bounded

    return table(spark, sf, "documents").select(
        "doc_id", tx.is_chart_topic("text", ascii_boundary=True).alias("is_topic"),
        F.col("text").rlike("(?i)" + bounded(r"\bthe\b.*\band\b", True)).alias("has_words"),
    )


@query(
    "p17_topic_suppression",
    f"""SELECT doc_id, source FROM documents WHERE NOT ({has_any("replace(lower(source), ' ', '')", ['src1', 'src7'])}
     AND regexp_matches(text, '(?i)\\bthan\\b'))""",
)
def p17(spark, sf):
    hit = tx.is_suppressed_topic("text", "source", ["src1", "src7"], r"\bthan\b", ascii_boundary=True)
    return table(spark, sf, "documents").where(~hit).select("doc_id", "source")


@query(
    "p18_navigation_text",
    f"""WITH {LINKS}, t AS (SELECT page_id, pos, text, trim(lower(text)) AS l FROM links)
    SELECT page_id, pos, (l IN ({', '.join(q(w) for w in fixed.NAV_WORDS)}) OR (length(text) < 15 AND NOT contains(text, ' '))
      OR {has_any('l', fixed.PROMO_PHRASES)} OR {' OR '.join(f"starts_with(l, {q(h)})" for h in fixed.SECTION_HEADERS)}) AS navigation FROM t""",
)
def p18(spark, sf):
    return links(spark, sf).select("page_id", "pos", tx.is_navigation("text").alias("navigation"))


@query(
    "p19_trusted_links",
    f"""WITH {LINKS}, a AS (SELECT page_id, pos, {absolute_sql('href', 'url')} AS link,
       regexp_extract({path_sql('url')}, '^/([^/]*)', 1) AS section FROM links)
    SELECT page_id, pos FROM a WHERE {has_any('lower(link)', ['example.com', 'example.org'])} OR lower(section) = 'de'""",
)
def p19(spark, sf):
    from newsmill.functions.arrays import strings

    a = links(spark, sf).select(
        "page_id", "pos", urls.absolute_url("href", "url").alias("link"),
        F.regexp_extract(urls.path("url"), "^/([^/]*)", 1).alias("section"),
    )
    ok = rl.is_trusted("link", "section", strings(["example.com", "example.org"]), strings(["de"]))
    return a.where(ok).select("page_id", "pos")


LINES = """lines AS (SELECT doc_id, unnest(range(len(l))) AS pos, trim(unnest(l)) AS line
   FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) s)"""


def doc_lines(spark, sf):
    lines = trimmed(F.split("text", "\n"))
    return unnest(table(spark, sf, "documents"), lines, "line", "pos", "doc_id")


def spoken_sql(t: str) -> str:
    for s in fixed.SPOKEN_SUFFIXES:
        t = f"trim(replace({t}, {q(s)}, ''))"
    t = f"regexp_replace({t}, '\\s*\\(\\s*$', '')"
    for a, b in fixed.SPOKEN_REPLACEMENTS:
        t = f"replace({t}, {q(a)}, {q(b)})"
    return f"trim({sub(t, '  +', ' ')})"


@query(
    "p20_speakable_lines",
    f"""WITH {LINES} SELECT doc_id, pos, line FROM lines WHERE length(line) >= 10
     AND NOT {has_any('lower(line)', fixed.DIGEST_SKIP_PHRASES)} AND NOT {ends_any('line', fixed.TRUNCATED_ENDINGS_DIGEST)}
     AND length({spoken_sql('line')}) > 10""",
)
def p20(spark, sf):
    return doc_lines(spark, sf).where(tx.is_speakable("line")).select("doc_id", "pos", "line")


@query(
    "p21_market_lines",
    f"""WITH {LINES} SELECT doc_id, pos FROM lines WHERE length(line) > 20
     AND NOT {has_any('lower(line)', fixed.MARKET_SKIP_WORDS)} AND {has_any('lower(line)', fixed.MARKET_WORDS)}""",
)
def p21(spark, sf):
    return doc_lines(spark, sf).where(tx.is_market_line("line")).select("doc_id", "pos")


def _strip(t: str, suffixes) -> str:
    for s in suffixes:
        t = f"trim(replace({t}, {q(s)}, ''))"
    return t


def words_sql(t: str) -> str:
    return f"list_filter(string_split({squeeze_sql(t)}, ' '), lambda w: w <> '')"


@query(
    "p22_headlines",
    f"""WITH {LINES} SELECT doc_id, pos, {_strip('line', fixed.HEADLINE_SUFFIXES)} AS headline FROM lines
     WHERE length(line) >= 20 AND NOT {has_any('lower(line)', fixed.ROUNDUP_SKIP_WORDS)}
       AND (len({words_sql('line')}) >= 5 OR regexp_matches(line, {q(fixed.HEADLINE_SOURCE_PATTERN)}))
       AND NOT {ends_any(_strip('line', fixed.HEADLINE_SUFFIXES), fixed.TRUNCATED_ENDINGS)}
       AND length({_strip('line', fixed.HEADLINE_SUFFIXES)}) >= 15""",
)
def p22(spark, sf):
    return doc_lines(spark, sf).where(tx.is_headline("line")).select(
        "doc_id", "pos", tx.strip_suffixes("line").alias("headline")
    )


@query(
    "p23_shared_predicates",
    f"""WITH {PAGE_ITEMS} SELECT page_id,
     {has_any("replace(lower(" + netloc_sql('url') + "), 'www.', '')", ['example.net', 'spam'])} AS blocked,
     {has_any('lower(title)', ['the', 'que'])} AS excluded, {has_any('lower(title)', ['un', 'and'])} AS included,
     {has_any('lower(category)', ['fr', 'es'])} AS in_section FROM page_items""",
)
def p23(spark, sf):
    from newsmill.functions.arrays import strings

    return page_items(spark, sf).select(
        "page_id",
        rl.is_blocked("url", strings(["example.net", "spam"])).alias("blocked"),
        rl.is_excluded("title", strings(["The", "Que"])).alias("excluded"),
        rl.is_included("title", strings(["Un", "And"])).alias("included"),
        rl.in_sections("category", strings(["FR", "es"])).alias("in_section"),
    )


@query(
    "p24_researchable",
    f"""WITH {PAGE_ITEMS} SELECT i.page_id FROM page_items i LEFT JOIN labels l ON l.doc_id = i.page_id
     WHERE {has_any('lower(category)', ['en', 'de'])} AND NOT {has_any('lower(category)', fixed.RESEARCH_EXCLUDED)}
     AND NOT coalesce(l.quality = 1, false) AND starts_with(url, 'http')""",
)
def p24(spark, sf):
    flags = table(spark, sf, "labels").select(
        F.col("doc_id").alias("page_id"), (F.col("quality") == 1).alias("matched")
    )
    items = page_items(spark, sf).join(flags, "page_id", "left")
    return items.where(tx.is_researchable("category", "url", "matched", ["EN", "DE"])).select("page_id")


# A target sheet with blank rows: what is missing in the labels makes cells empty.
SHEET = """sheet AS (SELECT d.doc_id AS row_no, CASE WHEN l.doc_id IS NULL THEN '' ELSE 'https://x.example.com/' || d.source || '/' || d.n_chars END AS url,
   CASE WHEN l.quality = 1 THEN split_part(d.text, chr(10), 1) ELSE '' END AS title,
   CASE WHEN l.toxic = 1 THEN 'TRUE' ELSE 'FALSE' END AS "Processed"
   FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def sheet(spark, sf):
    flags = table(spark, sf, "labels").withColumn("_there", F.lit(True))
    d = table(spark, sf, "documents").join(flags, "doc_id", "left")
    return d.select(
        F.col("doc_id").alias("row_no"),
        F.when(
            F.col("_there"),
            F.concat(F.lit("https://x.example.com/"), "source", F.lit("/"), F.col("n_chars").cast("string")),
        ).otherwise("").alias("url"),
        F.when(F.col("quality") == 1, F.substring_index("text", "\n", 1)).otherwise("").alias("title"),
        F.when(F.col("toxic") == 1, "TRUE").otherwise("FALSE").alias("Processed"),
    )


BLANK = """(trim(url) = '' AND (trim(title) = '' OR upper(trim(title)) = 'FALSE') AND upper(trim("Processed")) IN ('', 'FALSE'))"""


@query("p25_blank_rows", f"WITH {SHEET} SELECT row_no FROM sheet WHERE {BLANK}")
def p25(spark, sf):
    return sheet(spark, sf).where(tx.is_blank_row("url", "title", "Processed")).select("row_no")


@query(
    "p26_needs_matching",
    f"""WITH {SHEET}, s AS (SELECT s.row_no, s.url, CASE WHEN l.toxic = 1 THEN 'true' ELSE '' END AS skip,
       CASE WHEN l.quality = 1 THEN 'TRUE' WHEN l.quality = 0 AND l.toxic = 1 THEN 'False' ELSE '' END AS matched
       FROM sheet s LEFT JOIN labels l ON l.doc_id = s.row_no)
    SELECT row_no FROM s WHERE upper(trim(skip)) <> 'TRUE' AND upper(trim(matched)) NOT IN ('TRUE', 'FALSE') AND trim(url) <> ''""",
)
def p26(spark, sf):
    flags = table(spark, sf, "labels").withColumnRenamed("doc_id", "row_no")
    s = sheet(spark, sf).join(flags, "row_no", "left").select(
        "row_no", "url",
        F.when(F.col("toxic") == 1, "true").otherwise("").alias("skip"),
        F.when(F.col("quality") == 1, "TRUE")
        .when((F.col("quality") == 0) & (F.col("toxic") == 1), "False").otherwise("").alias("matched"),
    )
    return s.where(tx.needs_matching("skip", "matched", "url")).select("row_no")


@query(
    "p27_short_text_gate",
    """SELECT doc_id, length(CASE WHEN length(text) < 1500 THEN text WHEN lang = 'en' THEN source
     ELSE text END) AS shown FROM documents""",
)
def p27(spark, sf):
    summary = F.when(F.col("lang") == "en", F.col("source"))
    return table(spark, sf, "documents").select(
        "doc_id", F.length(tx.keep_or_summarise("text", summary)).alias("shown")
    )


SUMMARIES = """summaries AS (SELECT c.conv_id, c.turn, CASE WHEN c.role = 'user' THEN 'SKIP_TA ' || c.text
   WHEN c.turn > 2 THEN 'Skipped: Technical Analysis ' || c.text ELSE c.text END AS summary FROM conversations c)"""


@query(
    "p28_model_skip",
    f"""WITH {SUMMARIES} SELECT conv_id, turn, (starts_with(trim(summary), 'SKIP_TA') OR (starts_with(trim(summary), 'Skipped')
      AND contains(lower(summary), 'technical analysis'))) AS skipped, true AS processed FROM summaries""",
)
def p28(spark, sf):
    c = table(spark, sf, "conversations")
    summary = (
        F.when(F.col("role") == "user", F.concat(F.lit("SKIP_TA "), "text"))
        .when(F.col("turn") > 2, F.concat(F.lit("Skipped: Technical Analysis "), "text"))
        .otherwise(F.col("text"))
    )
    return c.select("conv_id", "turn", tx.is_model_skip(summary).alias("skipped"), F.lit(True).alias("processed"))


@query(
    "p29_capabilities",
    """SELECT doc_id, quality = 1 AS has_export, array_to_string(list_sort(list_filter([CASE WHEN quality = 1 THEN 'csv_export' END,
      CASE WHEN toxic = 1 THEN 'grid_enrichment' END], lambda x: x IS NOT NULL)), ',') AS enabled FROM labels""",
)
def p29(spark, sf):
    caps = F.create_map(
        F.lit("csv_export"), F.col("quality") == 1, F.lit("grid_enrichment"), F.col("toxic") == 1
    )
    return table(spark, sf, "labels").select(
        "doc_id", rl.has_capability(caps, "csv_export").alias("has_export"),
        F.array_join(rl.enabled_capabilities(caps), ",").alias("enabled"),
    )


# Hosts as addresses, built from order keys.
ADDR = """addr AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'http://10.' WHEN 'O' THEN 'https://172.' ELSE 'ftp://8.' END
   || (o_custkey % 40) || '.' || (o_orderkey % 250) || '.7/x' AS url FROM orders)"""


@query(
    "p30_url_safety",
    f"""WITH {ADDR} SELECT o_orderkey, {scheme_sql('url')} IN ('http', 'https') AND NOT regexp_matches({netloc_sql('url')},
     '^(10\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.)') AS safe FROM addr""",
)
def p30(spark, sf):
    o = table(spark, sf, "orders")
    head = (
        F.when(F.col("o_orderstatus") == "F", "http://10.").when(F.col("o_orderstatus") == "O", "https://172.")
        .otherwise("ftp://8.")
    )
    url = F.concat(
        head, (F.col("o_custkey") % 40).cast("string"), F.lit("."), (F.col("o_orderkey") % 250).cast("string"), F.lit(".7/x")
    )
    return o.select("o_orderkey", urls.is_safe(url).alias("safe"))


@query(
    "p32_identifiers",
    """SELECT page_id, 'v' || page_id AS video, 'UC' || lpad(CAST(page_id AS VARCHAR), 22, '0') AS channel,
     's' || page_id AS sheet, 'f' || page_id AS folder, 'p' || page_id AS slug, 'open' AS action FROM pages""",
)
def p32(spark, sf):
    pid = F.col("page_id").cast("string")
    p = table(spark, sf, "pages")
    video = F.when(
        F.startswith("url", F.lit("https")), F.concat(F.lit("https://youtube.com/watch?v=v"), pid, F.lit("&t=1"))
    ).otherwise(F.concat(F.lit("https://youtu.be/v"), pid, F.lit("?t=1")))
    return p.select(
        "page_id",
        urls.video_id(video).alias("video"),
        urls.channel_id(F.concat(F.lit("https://youtube.com/channel/UC"), F.lpad(pid, 22, "0"))).alias("channel"),
        urls.sheet_id(F.concat(F.lit("https://docs.google.com/spreadsheets/d/s"), pid, F.lit("/edit#gid=0"))).alias("sheet"),
        urls.folder_id(F.concat(F.lit("https://drive.google.com/drive/folders/f"), pid, F.lit("?usp=x"))).alias("folder"),
        urls.post_slug(F.concat(F.lit("https://a.example.com/p/p"), pid, F.lit("?x=1"))).alias("slug"),
        urls.app_link(F.concat(F.lit("news://open?id="), pid))["action"].alias("action"),
    )


# Tasks from customers: segment -> interval, balance -> time of day.
TASKS = """tasks AS (SELECT c_custkey AS task_id, c_acctbal > 0 AS enabled, CASE c_mktsegment WHEN 'BUILDING' THEN 'daily' WHEN 'MACHINERY' THEN 'weekly'
     WHEN 'HOUSEHOLD' THEN 'hourly' WHEN 'FURNITURE' THEN 'custom_hours' ELSE 'every_6_hours' END AS interval,
   lpad(CAST(c_nationkey % 24 AS VARCHAR), 2, '0') || ':30' AS run_at_time, c_nationkey % 7 AS run_on_day, 1 + c_nationkey % 5 AS custom_hours,
   CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE TIMESTAMP '2024-05-01 00:00:00' + INTERVAL 1 HOUR * (c_custkey % 800) END AS last_run,
   TIMESTAMP '2024-05-10 00:00:00' + INTERVAL 1 MINUTE * (c_custkey % 20000) AS next_run FROM customer)"""
AS_OF = "2024-05-15 12:30:00"


def tasks(spark, sf):
    c = table(spark, sf, "customer")
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    seg = F.col("c_mktsegment")
    interval = (
        F.when(seg == "BUILDING", "daily").when(seg == "MACHINERY", "weekly").when(seg == "HOUSEHOLD", "hourly")
        .when(seg == "FURNITURE", "custom_hours").otherwise("every_6_hours")
    )
    at = lambda text: F.to_timestamp(F.lit(text))
    return c.select(
        k.alias("task_id"), (F.col("c_acctbal") > 0).alias("enabled"), interval.alias("interval"),
        F.concat(F.lpad((n % 24).cast("string"), 2, "0"), F.lit(":30")).alias("run_at_time"),
        (n % 7).cast("int").alias("run_on_day"), (1 + n % 5).cast("int").alias("custom_hours"),
        F.when(k % 4 == 0, F.lit(None)).otherwise(
            at("2024-05-01 00:00:00") + F.make_interval(hours=(k % 800).cast("int"))
        ).cast("timestamp").alias("last_run"),
        (at("2024-05-10 00:00:00") + F.make_interval(mins=(k % 20000).cast("int"))).alias("next_run"),
    )


@query("p33_due_tasks", f"WITH {TASKS} SELECT task_id FROM tasks WHERE enabled AND next_run <= TIMESTAMP '{AS_OF}'")
def p33(spark, sf):
    from newsmill.operators.schedule import due_tasks

    return due_tasks(tasks(spark, sf), F.to_timestamp(F.lit(AS_OF))).select("task_id")


@query(
    "p34_missed_runs",
    f"""WITH {TASKS} SELECT task_id FROM tasks WHERE interval = 'daily' AND (last_run IS NULL OR CAST(last_run AS DATE) < DATE '2024-05-15')
     AND TIMESTAMP '2024-05-15 00:00:00' + INTERVAL 1 HOUR * CAST(split_part(run_at_time, ':', 1) AS INT) + INTERVAL 30 MINUTE <= TIMESTAMP '{AS_OF}'""",
)
def p34(spark, sf):
    from newsmill.operators.schedule import missed_today

    return tasks(spark, sf).where(missed_today(F.to_timestamp(F.lit(AS_OF)))).select("task_id")


@query(
    "p35_retention_media",
    """SELECT week, name, size_mb, modified_date FROM (SELECT 'Week_' || weekofyear(o_orderdate) || '_' || isoyear(o_orderdate) AS week,
     'audio_' || o_orderkey || '.mp3' AS name, round(floor(o_totalprice * 100) / 1048576.0, 1) AS size_mb,
     strftime(o_orderdate, '%Y-%m-%d') AS modified_date, o_orderdate AS m FROM orders)
     WHERE m < TIMESTAMP '1998-01-01 00:00:00' - INTERVAL 30 DAY""",
)
def p35(spark, sf):
    from newsmill.operators.schedule import old_media

    return old_media(media(spark, sf), F.to_timestamp(F.lit("1998-01-01 00:00:00")), 30)


def media(spark, sf):
    """Media files from orders: week folder, name, size, time."""
    o = table(spark, sf, "orders")
    d = F.col("o_orderdate").cast("timestamp")
    name = F.concat(F.lit("audio_"), F.col("o_orderkey").cast("string"), F.lit(".mp3"))
    return o.select(
        "o_orderkey", dates.week_label(d).alias("week"), name.alias("name"),
        F.concat(dates.week_label(d), F.lit("/"), name).alias("path"),
        F.floor(F.col("o_totalprice") * 100).alias("size"), d.alias("modified"), "o_orderstatus",
    )


@query(
    "p35_retention_ids",
    """SELECT event_id AS id, strftime(ts, '%Y-%m-%d') AS processed_date FROM events
     WHERE strftime(ts, '%Y-%m-%d') >= strftime(DATE '2024-02-14' - INTERVAL 30 DAY, '%Y-%m-%d')""",
)
def p35b(spark, sf):
    from newsmill.operators.schedule import live_ids

    ids = table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd").alias("processed_date")
    )
    return live_ids(ids, F.to_timestamp(F.lit("2024-02-14 08:00:00")))


@query(
    "p35_retention_jobs",
    """WITH j AS (SELECT event_id AS job_id, CASE event_type WHEN 'click' THEN 'completed' WHEN 'view' THEN 'failed' WHEN 'error' THEN 'timeout'
       ELSE 'running' END AS status, ts FROM events WHERE true),
     k AS (SELECT * FROM j WHERE NOT (status <> 'running' AND epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts) > 432000000000))
    SELECT job_id, status FROM k""",
)
def p35c(spark, sf):
    from newsmill.operators.schedule import live_jobs

    kind = F.col("event_type")
    jobs = table(spark, sf, "events").select(
        F.col("event_id").alias("job_id"),
        F.when(kind == "click", "completed").when(kind == "view", "failed").when(kind == "error", "timeout")
        .otherwise("running").alias("status"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.col("ts").cast("timestamp").alias("completed_at"),
    )
    kept = live_jobs(jobs, F.to_timestamp(F.lit("2024-01-31 00:00:00")), 432000)
    return kept.select("job_id", "status")
