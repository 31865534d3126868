"""Registry, and the tables that several queries derive from the given ones."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsmill.functions import markup, urls
from newsmill.operators.rows import unnest
from newsmill.session import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# Tables with long texts, and the key that spreads them evenly.
TEXTS = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df, TEXTS[name]) if name in TEXTS else df


# --- SQL text helpers -------------------------------------------------------

def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def lst(values: Iterable[str]) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def has_any(text: str, values: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(v)})" for v in values) + ")"


def ends_any(text: str, values: Iterable[str]) -> str:
    return "(" + " OR ".join(f"ends_with({text}, {q(v)})" for v in values) + ")"


def sub(text: str, pattern: str, by: str) -> str:
    return f"regexp_replace({text}, {q(pattern)}, {q(by)}, 'g')"


def squeeze_sql(text: str) -> str:
    return f"trim({sub(text, chr(92) + 's+', ' ')})"


def case_of(text: str, pairs: Iterable[tuple[str, str]], otherwise: str, test: str = "contains") -> str:
    whens = " ".join(f"WHEN {test}({text}, {q(k)}) THEN {q(v)}" for k, v in pairs)
    return f"CASE {whens} ELSE {otherwise} END"


# URL parts in SQL.
def netloc_sql(u: str) -> str:
    return f"regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"


def path_sql(u: str) -> str:
    return f"regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


def scheme_sql(u: str) -> str:
    return f"lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"


def title_sql(text: str) -> str:
    """Capitalise runs of letters."""
    return (
        f"array_to_string(list_transform(regexp_extract_all({text}, '(\\p{{L}}+|[^\\p{{L}}]+)', 1), "
        "lambda w: replace(upper(w[1:1]), 'ẞ', 'Ss') || lower(w[2:])), '')"
    )


def pairs_sql(u: str) -> str:
    return (
        f"list_filter(string_split(regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '')"
    )


def rebuild_sql(u: str, pairs: str) -> str:
    base = f"regexp_extract({u}, '^[^?#]*')"
    low = (
        f"lower(regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) || "
        f"substr({base}, length(regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) + 1)"
    )
    return (
        f"CASE WHEN len({pairs}) = 0 THEN {low} "
        f"ELSE {low} || '?' || array_to_string({pairs}, '&') END"
    )


def clean_url_sql(u: str, names: Iterable[str]) -> str:
    kept = f"list_filter({pairs_sql(u)}, lambda p: NOT list_contains({lst(names)}, lower(split_part(p, '=', 1))))"
    return f"regexp_replace({rebuild_sql(u, kept)}, '\\?+$', '')"


def absolute_sql(h: str, b: str) -> str:
    return (
        f"CASE WHEN starts_with({h}, 'http') THEN {h} WHEN starts_with({h}, '//') THEN 'https:' || {h} "
        f"WHEN starts_with({h}, '/') THEN {scheme_sql(b)} || '://' || {netloc_sql(b)} || {h} "
        f"ELSE regexp_replace({b}, '/+$', '') || '/' || {h} END"
    )


def _map_sql(names: dict[str, str]) -> str:
    keys, values = (f"string_split({q(chr(1).join(side))}, chr(1))" for side in (names, names.values()))
    return f"MAP({keys}, {values})"


def unescape_sql(text: str) -> str:
    """All references of the standard, each read once: by name, with or without the semicolon where
    the standard has both, and by number."""
    from newsmill import fixed

    hexed = "'0x' || nullif(regexp_extract(r, '^&#[xX]0*([0-9A-Fa-f]+)', 1), '')"
    number = f"coalesce(TRY_CAST({hexed} AS BIGINT), TRY_CAST(regexp_extract(r, '^&#([0-9]+)', 1) AS BIGINT), 0)"
    known = f"CASE WHEN {number} BETWEEN 1 AND 1114111 AND {number} NOT BETWEEN 55296 AND 57343 THEN {number} ELSE 65533 END"
    by_number = f"translate(chr(CAST({known} AS INTEGER)), {q(''.join(markup._OLD))}, {q(''.join(markup._OLD.values()))})"
    common, every = _map_sql(dict(fixed.CHARACTER_ENTITIES)), _map_sql(markup._NAMES)
    char = (
        f"CASE WHEN NOT starts_with(r, '&') OR r = '&' THEN r WHEN starts_with(r, '&#') THEN {by_number} "
        f"ELSE coalesce({common}[r], {every}[r], r) END"
    )
    return f"array_to_string(list_transform(regexp_extract_all({text}, {q(markup._REFERENCE)}, 1), lambda r: {char}), '')"


def plain_sql(html: str, sep: str = " ") -> str:
    return squeeze_sql(unescape_sql(f"regexp_replace({html}, '<[^>]*>', '{sep}', 'gs')"))


def drop_elements_sql(html: str, tags: Iterable[str]) -> str:
    for t in tags:
        html = f"regexp_replace({html}, '<{t}\\b[^>]*>.*?</{t}\\s*>', ' ', 'gis')"
    return html


def no_comments_sql(html: str) -> str:
    return f"regexp_replace({html}, '<!--.*?-->', ' ', 'gs')"


def element_sql(html: str, tag: str) -> str:
    return f"regexp_extract({html}, '<{tag}\\b[^>]*>(.*?)(?:</{tag}\\s*>|$)', 1, 'is')"


ANCHOR = (
    """<a\\b[^>]*?\\shref\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s>]+)[^>]*>(.*?)</a\\s*>"""
)

# Links of every page: page_id, url (of the page), pos, href, text.
LINKS = f"""links AS (
  SELECT page_id, url, unnest(range(len(h))) AS pos,
         trim({unescape_sql("regexp_replace(unnest(h), '^[\"'']|[\"'']$', '', 'g')")}) AS href,
         {plain_sql("unnest(t)", "")} AS text
  FROM (SELECT page_id, url,
               regexp_extract_all({no_comments_sql('html')}, '{ANCHOR}', 1, 'is') AS h,
               regexp_extract_all({no_comments_sql('html')}, '{ANCHOR}', 2, 'is') AS t
        FROM pages) s)"""


def links(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    return unnest(pages, markup.links("html"), "a", "pos", "page_id", "url").select("page_id", "url", "pos", F.col("a.href").alias("href"), F.col("a.text").alias("text"))


# News items: the first line of a document is its title, and the order of the same number
# gives its day; documents whose order is pending, or that have none, are undated.
NEWS = """news AS (
  SELECT d.doc_id AS item_id, split_part(d.text, chr(10), 1) AS title, d.text AS content,
         'https://' || d.source || '.example.com/' || d.lang || '/' || d.doc_id AS url,
         d.source AS source_name, d.lang AS category,
         CASE d.lang WHEN 'de' THEN 'youtube' WHEN 'fr' THEN 'article_archive'
              WHEN 'en' THEN 'newsletter' ELSE 'rss' END AS source_type,
         o.o_orderdate AS published_date
  FROM documents d LEFT JOIN orders o ON o.o_orderkey = d.doc_id AND o.o_orderstatus <> 'P')"""


def news(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    o = table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").cast("timestamp").alias("published_date")
    )
    kind = (
        F.when(F.col("lang") == "de", "youtube").when(F.col("lang") == "fr", "article_archive")
        .when(F.col("lang") == "en", "newsletter").otherwise("rss")
    )
    return d.join(o, "doc_id", "left").select(
        F.col("doc_id").alias("item_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("content"),
        F.concat(
            F.lit("https://"), "source", F.lit(".example.com/"), "lang", F.lit("/"), F.col("doc_id").cast("string")
        ).alias("url"),
        F.col("source").alias("source_name"),
        F.col("lang").alias("category"),
        kind.alias("source_type"),
        "published_date",
    )


# Usage log: one call per event.
MODELS = {
    "click": "gemini-2.5-flash", "view": "models/gemini-2.0-flash", "purchase": "gemini-1.5-pro",
    "signup": "gemini-2.5-pro", "error": "other-model",
}
CALLS = """calls AS (
  SELECT event_id AS call_id, ts,
         CASE event_type WHEN 'click' THEN 'gemini-2.5-flash' WHEN 'view' THEN 'models/gemini-2.0-flash'
              WHEN 'purchase' THEN 'gemini-1.5-pro' WHEN 'signup' THEN 'gemini-2.5-pro'
              ELSE 'other-model' END AS model,
         'task' || user_id AS task_id,
         CAST(floor(value * 1000) AS BIGINT) AS input_chars, CAST(floor(value * 100) AS BIGINT) AS output_chars
  FROM events)"""

_RAW_COST = """input_chars / 4.0::DOUBLE * (CASE WHEN contains(model, 'gemini-2.5-flash') THEN 0.15::DOUBLE
      WHEN contains(model, 'gemini-2.5-pro') THEN 1.25::DOUBLE WHEN contains(model, 'gemini-2.0-flash') THEN 0.10::DOUBLE
      WHEN contains(model, 'gemini-1.5-flash') THEN 0.075::DOUBLE WHEN contains(model, 'gemini-1.5-pro') THEN 1.25::DOUBLE
      ELSE 0.10::DOUBLE END) / 1000000
   + output_chars / 4.0::DOUBLE * (CASE WHEN contains(model, '2.5') THEN 5 ELSE 1 END)
     * (CASE WHEN contains(model, 'gemini-2.5-flash') THEN 0.60::DOUBLE WHEN contains(model, 'gemini-2.5-pro') THEN 10.0::DOUBLE
        WHEN contains(model, 'gemini-2.0-flash') THEN 0.40::DOUBLE WHEN contains(model, 'gemini-1.5-flash') THEN 0.30::DOUBLE
        WHEN contains(model, 'gemini-1.5-pro') THEN 5.0::DOUBLE ELSE 0.40::DOUBLE END) / 1000000"""
COST = f"CAST(round(CAST(CAST({_RAW_COST} AS VARCHAR) AS DECIMAL(38,26)), 6) AS DOUBLE)"
PRICED = f"{CALLS}, priced AS (SELECT *, {COST} AS cost FROM calls)"


def calls(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    model = F.lit("other-model")
    for kind in ("click", "view", "purchase", "signup"):
        model = F.when(F.col("event_type") == kind, MODELS[kind]).otherwise(model)
    return e.select(
        F.col("event_id").alias("call_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        model.alias("model"),
        F.concat(F.lit("task"), F.col("user_id").cast("string")).alias("task_id"),
        F.floor(F.col("value") * 1000).alias("input_chars"),
        F.floor(F.col("value") * 100).alias("output_chars"),
    )


def priced(spark: SparkSession, sf: str) -> DataFrame:
    from newsmill.operators.usage import price_calls

    return price_calls(calls(spark, sf))


def stamp(c: Column | str) -> Column:
    # Years before 0 have no leading zeros in SQL.
    return F.regexp_replace(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), "^-0+(?=[0-9]+-)", "-")


def stamp_sql(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def page_host_label(url: str = "url") -> Column:
    return urls.host_label(url)
