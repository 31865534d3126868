"""A rows of the inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsmill import fixed
from newsmill.functions import text as tx
from newsmill.operators import dedup, digest as dg, entities as en, load, schedule, usage
from newsmill.suite.base import (
    CALLS, NEWS, PRICED, lst, news, priced, q, query, stamp, stamp_sql, table,
)
from newsmill.suite.dedup_joins import MATCHES, doc_items, doc_matches
from newsmill.suite.functions import sentences_raw_sql, spoken_title_sql
from newsmill.suite.predicates import BLANK, PAGE_ITEMS, REASON, RULE, SHEET, media, page_items, sheet


@query("a1_by_source_type", f"WITH {NEWS} SELECT source_type, count(*) AS items FROM news GROUP BY source_type")
def a1(spark, sf):
    return dg.count_by_type(news(spark, sf))


@query(
    "a2_matched_total",
    f"WITH {MATCHES} SELECT (SELECT count(DISTINCT doc_id) FROM matches) AS matched, count(*) AS total FROM documents",
)
def a2(spark, sf):
    items = doc_items(spark, sf)
    full = en.with_match_columns(items, en.match_summary(doc_matches(spark, sf), ["doc_id"]), ["doc_id"])
    return en.matched_total(full)


_TERMS = ["than", "that", "the", "sch", "une"]
_HITS = f"regexp_extract_all(text, '(?i)\\b({'|'.join(_TERMS)})\\b', 1)"


@query(
    "a3_term_counts",
    f"""WITH h AS (SELECT doc_id, unnest({_HITS}) AS h, unnest(range(len({_HITS}))) AS pos FROM documents),
     c AS (SELECT doc_id, upper(h[1:1]) || lower(h[2:]) AS term, count(*) AS n, min(pos) AS pos FROM h GROUP BY ALL)
    SELECT doc_id, string_agg(term || ' (' || n || 'x)', ', ' ORDER BY n DESC, pos) AS mentions FROM c GROUP BY doc_id""",
)
def a3(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", tx.count_label(tx.term_hits("text", _TERMS, ascii_boundary=True)).alias("mentions")
    )
    return d.where("mentions <> ''")


@query(
    "a4_usage_by_day",
    f"WITH {PRICED} SELECT {stamp_sql('date_trunc(' + q('day') + ', ts)')} AS day, count(*) AS calls, round(sum(cost), 6) AS cost_estimate FROM priced GROUP BY 1",
)
def a4(spark, sf):
    return usage.rollup(priced(spark, sf), "day").withColumn("day", stamp("day"))


@query(
    "a4_usage_by_month_and_task",
    f"WITH {PRICED} SELECT task_id, strftime(ts, '%Y-%m') AS month, count(*) AS calls, round(sum(cost), 6) AS cost_estimate FROM priced GROUP BY 1, 2",
)
def a4b(spark, sf):
    return usage.rollup(priced(spark, sf), "month", ["task_id"]).withColumn("month", F.date_format("month", "yyyy-MM"))


NOW = "2024-01-20 15:00:00"


@query(
    "a5_task_totals",
    f"""WITH {CALLS} SELECT task_id, count(*) FILTER (WHERE CAST(ts AS DATE) = DATE '2024-01-20') AS calls_today,
      count(*) FILTER (WHERE strftime(ts, '%Y-%m') = '2024-01') AS calls_this_month, {stamp_sql('max(ts)')} AS last_run FROM calls GROUP BY task_id""",
)
def a5(spark, sf):
    return usage.task_totals(priced(spark, sf), F.to_timestamp(F.lit(NOW))).withColumn("last_run", stamp("last_run"))


@query(
    "a6_daily_history",
    f"""WITH {PRICED} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS calls, round(sum(cost), 6) AS cost_estimate FROM priced
     WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1 ORDER BY day DESC LIMIT 10""",
)
def a6(spark, sf):
    h = usage.daily_history(priced(spark, sf), F.to_timestamp(F.lit(NOW)), 10)
    return h.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    "a7_usage_snapshot",
    f"""WITH {PRICED}, s AS (SELECT count(*) FILTER (WHERE CAST(ts AS DATE) = DATE '2024-01-20') AS daily_calls, count(*) FILTER (WHERE strftime(ts, '%Y-%m') = '2024-01') AS monthly_calls,
       round(sum(cost) FILTER (WHERE CAST(ts AS DATE) = DATE '2024-01-20'), 6) AS daily_cost_estimate, round(sum(cost) FILTER (WHERE strftime(ts, '%Y-%m') = '2024-01'), 6) AS monthly_cost_estimate FROM priced)
    SELECT *, CAST(500 AS BIGINT) AS daily_limit, CAST(10000 AS BIGINT) AS monthly_limit, 2.5::DOUBLE AS monthly_budget_usd, daily_calls < 500 AND monthly_calls < 10000 AS within_limits,
      monthly_cost_estimate >= 2.5 AS over_budget, monthly_cost_estimate >= 2.5 AS cooldown_active FROM s""",
)
def a7(spark, sf):
    return usage.usage_snapshot(priced(spark, sf), F.to_timestamp(F.lit(NOW)), {"monthly_budget_usd": 2.5})


@query(
    "a8_dedup_report",
    f"""WITH {SHEET}, k AS (SELECT count(*) AS before_count, count(DISTINCT CASE WHEN NOT {BLANK} THEN nullif(trim(url), '') END) + count(*) FILTER (WHERE NOT {BLANK} AND trim(url) = '') AS after_count FROM sheet)
    SELECT *, before_count - after_count AS removed_count FROM k""",
)
def a8(spark, sf):
    return dedup.dedup_report(sheet(spark, sf), "url", ["url", "title", "Processed"])


@query(
    "a8_clean_table",
    f"""WITH {SHEET}, f AS (SELECT * FROM sheet WHERE NOT {BLANK}) SELECT row_no FROM f WHERE trim(url) = '' UNION ALL
     (SELECT row_no FROM f WHERE trim(url) <> '' QUALIFY row_number() OVER (PARTITION BY trim(url) ORDER BY row_no) = 1)""",
)
def a8b(spark, sf):
    return dedup.clean_table(sheet(spark, sf), "url", ["row_no"], ["url", "title", "Processed"]).select("row_no")


@query(
    "a9_day_bounds",
    "SELECT min(d) AS earliest, max(d) AS latest, count(DISTINCT d) AS covered FROM (SELECT strftime(l_shipdate, '%Y-%m-%d') AS d FROM lineitem)",
)
def a9(spark, sf):
    t = table(spark, sf, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm").alias("date_published"))
    return load.day_bounds(t)


@query(
    "a10_smallest_message",
    "SELECT 'c' || conv_id AS channel, CAST(turn AS INT) AS page_no, min(100 - turn) AS oldest_id FROM conversations GROUP BY conv_id, turn",
)
def a10(spark, sf):
    from newsmill.sources.pages import channel_messages
    from newsmill.suite.scans import channel_pages

    return channel_messages(channel_pages(spark, sf)).groupBy("channel", "page_no").agg(F.min("message_id").alias("oldest_id"))


@query(
    "a11_review_counts",
    f"""WITH {PAGE_ITEMS}, m AS (SELECT contains(url, 'example.net') OR contains(lower(title), 'the') AS m FROM page_items)
     SELECT count(*) FILTER (WHERE m) AS pre_marked, count(*) FILTER (WHERE NOT m) AS needs_review FROM m""",
)
def a11(spark, sf):
    from newsmill.suite.scans import training_input

    return load.review_counts(training_input(spark, sf))


def _first(kind, field):
    return f"coalesce(first({field} ORDER BY score DESC, pos, rank, entity_id) FILTER (WHERE type = '{kind}'), '')"


@query(
    "a12_match_summary",
    f"""WITH {MATCHES} SELECT doc_id, {_first('asset', 'entity_id')} AS grid_asset_id, true AS grid_matched, {_first('profile', 'entity_id')} AS grid_profile_id,
      round(max(score), 2) AS grid_confidence, {_first('entity', 'name')} AS grid_entity_name, count(*) AS grid_match_count, {_first('product', 'entity_id')} AS grid_product_id,
      {_first('profile', 'name')} AS grid_profile_name, {_first('product', 'name')} AS grid_product_name, {_first('entity', 'entity_id')} AS grid_entity_id,
      {_first('asset', 'name')} AS grid_asset_name, string_agg(name, ', ' ORDER BY score DESC, pos, rank, entity_id) AS grid_subjects, {_first('asset', 'ticker')} AS grid_asset_ticker
     FROM matches GROUP BY doc_id""",
)
def a12(spark, sf):
    return en.match_summary(doc_matches(spark, sf), ["doc_id"])


# Lines of a digest per week, or "recent" for undated items.
_DATE = "coalesce(strftime(published_date, '%B %d, %Y'), 'recent')"
DIGEST = f"""items AS (SELECT item_id, source_type, source_name, title, content, published_date,
     CASE WHEN published_date IS NULL THEN 'recent' ELSE 'Week_' || weekofyear(published_date) || '_' || isoyear(published_date) END AS week FROM news),
  l AS (SELECT week, source_type, source_name, item_id, published_date, 1 AS kind, 0 AS part, CASE source_type
       WHEN 'youtube' THEN chr(10) || 'Regarding the video titled ' || {spoken_title_sql('title')} || ', published ' || {_DATE} || '.' || chr(10)
       WHEN 'article_archive' THEN chr(10) || 'From ' || source_name || ', an article titled ' || {spoken_title_sql('title')} || ', dated ' || {_DATE} || '.' || chr(10)
       WHEN 'rss' THEN chr(10) || 'From ' || source_name || ', ' || {spoken_title_sql('title')} || ', dated ' || {_DATE} || '.' || chr(10)
       ELSE {spoken_title_sql('content')} END AS line FROM items
     UNION ALL SELECT week, source_type, source_name, item_id, published_date, 1, 1, content || chr(10) FROM items WHERE source_type <> 'newsletter'
     UNION ALL SELECT DISTINCT week, source_type, CASE WHEN source_type = 'newsletter' THEN source_name END, NULL, NULL, 0, 0, CASE source_type WHEN 'youtube' THEN chr(10) || 'From YouTube videos:' || chr(10)
       WHEN 'article_archive' THEN chr(10) || 'From articles:' || chr(10) WHEN 'rss' THEN chr(10) || 'From RSS feeds:' || chr(10) ELSE chr(10) || 'From ' || source_name || ' Newsletter:' || chr(10) END FROM items)"""


def digest_items(spark, sf):
    return news(spark, sf).select(
        "item_id", "title", F.lit(None).cast("string").alias("summary"), "content", "source_name", "source_type", "published_date"
    )


@query("a13_digest_lines", f"WITH {NEWS}, {DIGEST} SELECT week, kind, part, coalesce(item_id, 0) AS item_id, line FROM l WHERE line <> ''")
def a13(spark, sf):
    from newsmill.plans.report import render_digest

    return render_digest(digest_items(spark, sf)).select("week", "kind", "part", "item_id", "line")


@query(
    "a14_results_in_order",
    f"WITH {NEWS} SELECT item_id, list_position({lst(fixed.RESULT_TYPE_ORDER)}, source_type) AS type_rank FROM news WHERE source_type <> 'article_archive'",
)
def a14(spark, sf):
    return dg.flatten_results(news(spark, sf)).select("item_id", "type_rank")


@query(
    "a15_backfill_totals",
    f"""WITH {PAGE_ITEMS} SELECT count(*) AS posts, (SELECT count(*) FROM page_items WHERE category = 'en') AS items,
     (SELECT count(*) FROM page_items WHERE category = 'en' AND url NOT IN (SELECT url FROM pages WHERE starts_with(url, 'https'))) AS new_rows,
     count(*) FILTER (WHERE category = 'fr') AS errors FROM page_items""",
)
def a15(spark, sf):
    p = page_items(spark, sf)
    posts = p.select("url", (F.col("category") == "fr").alias("error"))
    target = p.where(F.startswith("url", F.lit("https"))).select("url")
    return load.backfill_totals(posts, p.where("category = 'en'").select("url"), target)


@query(
    "a16_funnel",
    f"""WITH {PAGE_ITEMS}, r AS (SELECT {REASON} AS r FROM page_items) SELECT count(*) AS checked, count(*) FILTER (WHERE r = 'category') AS category,
     count(*) FILTER (WHERE r = 'not_included') AS not_included, count(*) FILTER (WHERE r = 'excluded') AS excluded,
     count(*) FILTER (WHERE r = 'domain_blocked') AS domain_blocked, count(*) FILTER (WHERE r IS NULL) AS kept FROM r""",
)
def a16(spark, sf):
    from newsmill.operators import rules as rl

    rule = rl.rule_columns(RULE)
    judged = page_items(spark, sf).select(
        rl.reject_reason("url", "title", "description", "category", rule).alias("reject_reason")
    )
    return dg.funnel(judged, ["category", "not_included", "excluded", "domain_blocked"])


@query(
    "a17_size_report",
    """WITH m AS (SELECT CAST(floor(o_totalprice * 100) AS BIGINT) AS size, CASE WHEN o_orderstatus = 'F' THEN CAST(floor(o_totalprice * 10) AS BIGINT) END AS c FROM orders)
    SELECT count(c) AS converted, round(sum(size) FILTER (WHERE c IS NOT NULL) / 1048576.0::DOUBLE, 1) AS before_mb, round(sum(c) / 1048576.0::DOUBLE, 1) AS after_mb,
      round((sum(size) FILTER (WHERE c IS NOT NULL) - sum(c)) / 1048576.0::DOUBLE, 1) AS saved_mb,
      round((sum(size) FILTER (WHERE c IS NOT NULL) - sum(c)) / (sum(size) FILTER (WHERE c IS NOT NULL))::DOUBLE * 100, 1) AS saved_percent,
      round(sum(coalesce(c, size)) / 1e12::DOUBLE * 100, 2) AS storage_percent FROM m""",
)
def a17(spark, sf):
    m = media(spark, sf).withColumn(
        "compressed_size", F.when(F.col("o_orderstatus") == "F", F.floor(F.col("size") / 10))
    )
    return schedule.size_report(m, 10**12)


_ENT = "list_distinct(list_filter(" + " || ".join(
    f"regexp_extract_all(text, {q(p)}, 1)" for p in fixed.ENTITY_PATTERNS
) + f", lambda x: length(x) > 3 AND NOT list_contains({lst(fixed.COMMON_WORDS)}, x)))"


@query("a18_entities", f"SELECT doc_id, len({_ENT}) AS n, array_to_string(list_sort({_ENT}), '|') AS names FROM documents")
def a18(spark, sf):
    names = tx.mentioned_entities("text", None, None, ascii_boundary=True)
    d = table(spark, sf, "documents").select("doc_id", names.alias("e"))
    return d.select("doc_id", F.size("e").alias("n"), F.array_join(F.array_sort("e"), "|").alias("names"))


@query(
    "a19_digest_length",
    f"SELECT doc_id, len(list_filter(list_transform({sentences_raw_sql('text')}, lambda x: trim(x)), lambda x: x <> '')) * 3 + 60 AS seconds FROM documents",
)
def a19(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.digest_seconds("text").alias("seconds"))
