"""URL expressions: P1-P6, P11-P15, P30, P32, F6, J12.

Parts are taken with regular expressions, not with a strict URI parser: landed
links hold spaces, pipes and other characters that a strict parser rejects.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from newsmill import fixed
from newsmill.functions.arrays import (
    col, contains_any, first_chars, first_present, lookup, starts_with_any, strings,
)


# --- parts ------------------------------------------------------------------

def scheme(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(url), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def netloc(url: Column | str) -> Column:
    return F.regexp_extract(col(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def hostname(url: Column | str) -> Column:
    """Lower-cased host without credentials and port."""
    host = F.regexp_replace(netloc(url), r"^[^@]*@", "")
    return F.lower(F.regexp_replace(host, r":\d*$", ""))


def bare_host(url: Column | str) -> Column:
    """Lower-cased network location without ``www.``."""
    return F.replace(F.lower(netloc(url)), F.lit("www."), F.lit(""))


def path(url: Column | str) -> Column:
    return F.regexp_extract(
        col(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1
    )


def query(url: Column | str) -> Column:
    return F.regexp_extract(col(url), r"^[^?#]*\?([^#]*)", 1)


def _query_pairs(url: Column | str) -> Column:
    return F.filter(F.split(query(url), "&"), lambda p: p != "")


def _key(pair: Column) -> Column:
    return F.substring_index(pair, "=", 1)


def _value(pair: Column) -> Column:
    return F.when(F.contains(pair, F.lit("=")), F.regexp_replace(pair, r"^[^=]*=", "")).otherwise("")


def query_value(url: Column | str, name: str) -> Column:
    """First decoded value of a query key, or null."""
    hit = F.get(F.filter(_query_pairs(url), lambda p: _key(p) == name), F.lit(0))
    return F.try_url_decode(_value(hit))


# --- canonical form ---------------------------------------------------------

def _encode(text: Column) -> Column:
    # The Java encoder keeps "*" and escapes "~"; the wanted form is the opposite.
    encoded = F.url_encode(text)
    return F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _rebuild(url: Column, pairs: Column, reencode: bool) -> Column:
    base = F.regexp_extract(url, r"^[^?#]*", 0)
    prefix = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    base = F.concat(F.lower(prefix), F.substr(base, F.length(prefix) + 1))
    if reencode:
        decoded = F.transform(
            pairs,
            lambda p: F.struct(
                F.coalesce(F.try_url_decode(_key(p)), _key(p)).alias("k"),
                F.coalesce(F.try_url_decode(_value(p)), _value(p)).alias("v"),
            ),
        )
        keys = F.array_distinct(F.transform(decoded, lambda d: d["k"]))
        grouped = F.flatten(
            F.transform(keys, lambda k: F.filter(decoded, lambda d: d["k"] == k))
        )
        pairs = F.transform(
            grouped, lambda d: F.concat(_encode(d["k"]), F.lit("="), _encode(d["v"]))
        )
    text = F.array_join(pairs, "&")
    return F.when(text == "", base).otherwise(F.concat(base, F.lit("?"), text))


def clean_url(
    url: Column | str,
    names: Iterable[str] = fixed.TRACKING_NAMES,
    reencode: bool = False,
) -> Column:
    """Drop tracking keys by exact name, the fragment and a trailing ``?``.

    Query parts are kept verbatim and in order.  ``reencode`` decodes and
    encodes them again and groups repeated keys.
    """
    u = col(url)
    dropped = strings(n.lower() for n in names)
    kept = F.filter(_query_pairs(u), lambda p: ~F.array_contains(dropped, F.lower(_key(p))))
    return F.regexp_replace(_rebuild(u, kept, reencode), r"\?+$", "")


def clean_url_prefixes(
    url: Column | str,
    prefixes: Iterable[str] = fixed.TRACKING_PREFIXES,
    reencode: bool = False,
) -> Column:
    """Drop tracking keys by prefix, and the fragment."""
    u = col(url)
    prefixes = list(prefixes)
    kept = F.filter(
        _query_pairs(u),
        lambda p: ~starts_with_any(F.lower(_key(p)), prefixes),
    )
    return _rebuild(u, kept, reencode)


def absolute_url(href: Column | str, base: Column | str) -> Column:
    """Absolute form of a link found on ``base``."""
    h, b = col(href), col(base)
    return (
        F.when(F.startswith(h, F.lit("http")), h)
        .when(F.startswith(h, F.lit("//")), F.concat(F.lit("https:"), h))
        .when(F.startswith(h, F.lit("/")), F.concat(scheme(b), F.lit("://"), netloc(b), h))
        .otherwise(F.concat(F.regexp_replace(b, r"/+$", ""), F.lit("/"), h))
    )


# --- link predicates --------------------------------------------------------

def is_internal_mark(href: Column | str, marks: Iterable[str] = fixed.INTERNAL_MARKS) -> Column:
    """The link belongs to the publishing platform."""
    return contains_any(F.lower(col(href)), marks)


def is_same_site(url: Column | str, base: Column | str) -> Column:
    """The host of ``url`` holds the host of ``base``."""
    return F.contains(netloc(url), netloc(base))


def is_skippable(href: Column | str) -> Column:
    """Empty, anchor and mail links."""
    h = col(href)
    return (
        h.isNull() | (h == "") | F.startswith(h, F.lit("#")) | F.startswith(h, F.lit("mailto:"))
    )


def redirect_target(url: Column | str) -> Column:
    """P5: target carried in the query: ``dest``, ``url``, else the first http value."""
    u = col(url)
    values = F.transform(_query_pairs(u), lambda p: F.try_url_decode(_value(p)))
    first_http = F.get(F.filter(values, lambda v: F.startswith(v, F.lit("http"))), F.lit(0))
    return first_present(query_value(u, "dest"), query_value(u, "url"), first_http)


def unwrap_redirect(href: Column | str) -> Column:
    """Replace a platform redirect link by the target it carries."""
    h = col(href)
    return F.when(
        contains_any(h, fixed.REDIRECT_MARKS), F.coalesce(redirect_target(h), h)
    ).otherwise(h)


def is_article(url: Column | str) -> Column:
    """``(path and '/' in path) or len(path) > 20``."""
    p = F.trim(path(url), F.lit("/"))
    return ((p != "") & F.contains(p, F.lit("/"))) | (F.length(p) > 20)


def is_safe(url: Column | str) -> Column:
    """http(s), a host, and no private, loopback, link-local or reserved address."""
    host = F.regexp_replace(hostname(url), r"[\[\]]", "")
    private_v4 = host.rlike(
        r"^(?:(?:0|10|127)\.\d{1,3}\.\d{1,3}\.\d{1,3}"
        r"|169\.254\.\d{1,3}\.\d{1,3}"
        r"|192\.168\.\d{1,3}\.\d{1,3}"
        r"|172\.(?:1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}"
        r"|(?:24\d|25[0-5])\.\d{1,3}\.\d{1,3}\.\d{1,3}"
        r"|192\.0\.(?:0|2)\.\d{1,3}|198\.1[89]\.\d{1,3}\.\d{1,3}"
        r"|198\.51\.100\.\d{1,3}|203\.0\.113\.\d{1,3})$"
    )
    private_v6 = host.rlike(r"^(?:::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*)$")
    local = host == "localhost"
    return scheme(url).isin("http", "https") & (host != "") & ~(private_v4 | private_v6 | local)


# --- routing ----------------------------------------------------------------

def source_type(url: Column | str) -> Column:
    """Type of a source by substrings of its URL; default archive."""
    u = F.lower(col(url))
    return (
        F.when(contains_any(u, fixed.VIDEO_HOSTS), "youtube")
        .when(contains_any(u, fixed.FEED_MARKS), "rss")
        .otherwise("article_archive")
    )


def source_type_by_host(url: Column | str) -> Column:
    """Type of a source by its host; default newsletter."""
    u = col(url)
    host = F.lower(netloc(u))
    feed = contains_any(u, ["/feed", "/rss"]) | F.endswith(u, F.lit(".xml"))
    return (
        F.when(contains_any(host, fixed.VIDEO_HOSTS), "youtube")
        .when(contains_any(host, fixed.NEWSLETTER_HOSTS), "newsletter")
        .when(feed, "rss")
        .otherwise("newsletter")
    )


def extractor(url: Column | str) -> Column:
    """Which extractor takes a page; the first match wins."""
    u = col(url)
    host = netloc(u)
    return (
        F.when(F.contains(host, F.lit(fixed.NEWSLETTER_ROUTING_HOST)), "newsletter")
        .when(host == fixed.CHANNEL_HOST, "channel")
        .when(contains_any(F.lower(u), fixed.FEED_MARKS_ROUTING), "feed")
        .otherwise("generic")
    )


def channel_preview_url(url: Column | str) -> Column:
    """Rewrite ``t.me/x`` to the public preview ``t.me/s/x``."""
    u = col(url)
    rewrite = (netloc(u) == fixed.CHANNEL_HOST) & ~F.contains(path(u), F.lit("/s/"))
    return F.when(
        rewrite, F.concat(F.lit(f"https://{fixed.CHANNEL_HOST}/s/"), F.trim(path(u), F.lit("/")))
    ).otherwise(u)


# --- names ------------------------------------------------------------------

def _last_segment(url: Column | str) -> Column:
    return F.element_at(F.split(F.trim(path(url), F.lit("/")), "/"), -1)


def slug_title(url: Column | str, fall_back_to_host: bool = False, cap: int | None = None) -> Column:
    """readable title from the last path segment."""
    words = F.regexp_replace(_last_segment(url), "[-_]", " ")
    title = first_chars(title_case(words), cap)
    return F.coalesce(F.nullif(title, F.lit("")), netloc(url)) if fall_back_to_host else title


def title_case(text: Column) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the others."""
    pieces = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(pieces, F.initcap), "")


def host_label(url: Column | str) -> Column:
    """First label of the host, capitalised."""
    return title_case(F.substring_index(F.replace(netloc(url), F.lit("www."), F.lit("")), ".", 1))


def _first_contained(host: Column, mapping: dict[str, str], default: Column) -> Column:
    hit = None
    for key, value in mapping.items():
        test = F.contains(host, F.lit(key))
        hit = F.when(test, value) if hit is None else hit.when(test, value)
    return hit.otherwise(default)


def source_display_name(url: Column | str) -> Column:
    """Display name of a news host."""
    host = bare_host(url)
    return _first_contained(
        host, fixed.SOURCE_NAMES, title_case(F.substring_index(host, ".", 1))
    )


def source_abbreviation(url: Column | str) -> Column:
    """Short code of a news host."""
    host = bare_host(url)
    return _first_contained(
        host,
        fixed.SOURCE_ABBREVIATIONS,
        F.left(F.upper(F.substring_index(host, ".", 1)), F.lit(6)),
    )


def host_rule_set(url: Column | str) -> Column:
    """Rule set chosen by host, or null."""
    return _first_contained(bare_host(url), fixed.HOST_RULE_SETS, F.lit(None).cast("string"))


def ticker_name(ticker: Column | str) -> Column:
    return F.try_element_at(lookup(fixed.TICKER_NAMES), col(ticker))


def alias_name(ticker: Column | str) -> Column:
    return F.try_element_at(lookup(fixed.NAME_ALIASES), F.lower(col(ticker)))


# --- identifiers (P32) ------------------------------------------------------

def sheet_id(text: Column | str) -> Column:
    t = F.trim(col(text))
    return first_present(F.regexp_extract(t, r"/spreadsheets/d/([a-zA-Z0-9\-_]+)", 1), t)


def folder_id(text: Column | str) -> Column:
    t = F.trim(col(text))
    tail = F.trim(F.regexp_replace(F.substring_index(t, "/folders/", -1), r"[?#].*$", ""), F.lit("/"))
    return F.when(F.contains(t, F.lit("/folders/")), tail).otherwise(t)


def video_id(url: Column | str) -> Column:
    u = col(url)
    return first_present(
        F.regexp_extract(u, r"watch\?v=([^&?]+)", 1),
        F.regexp_extract(u, r"/shorts/([^?]+)", 1),
        F.regexp_extract(u, r"/live/([^?]+)", 1),
        F.regexp_extract(u, r"youtu\.be/([^?]+)", 1),
    )


def channel_id(url: Column | str, html: Column | str | None = None) -> Column:
    """Channel id from the URL, else from the landed channel page."""
    tail = "(UC[A-Za-z0-9_-]{20,})"
    found = [F.regexp_extract(col(url), f"/channel/{tail}", 1)]
    if html is not None:
        page = col(html)
        site = r"https?://www\.youtube\.com/channel/"
        found += [
            F.regexp_extract(page, rf'(?i)<link\s+rel="canonical"\s+href="{site}{tail}"', 1),
            F.regexp_extract(page, rf'(?i)<meta\s+property="og:url"\s+content="{site}{tail}"', 1),
            F.regexp_extract(page, rf'"channelId"\s*:\s*"{tail}"', 1),
            F.regexp_extract(page, rf'"browseId"\s*:\s*"{tail}"', 1),
        ]
    return first_present(*found)


def post_slug(url: Column | str) -> Column:
    u = col(url)
    return first_present(F.regexp_extract(u, r"/p/([^/?#]+)", 1), u)


def app_link(url: Column | str) -> Column:
    """Action and parameters of an application link such as ``app://action?k=v``."""
    u = col(url)
    pairs = F.filter(_query_pairs(u), lambda p: F.contains(p, F.lit("=")))
    entries = F.transform(
        pairs,
        lambda p: F.struct(
            _key(p).alias("k"), F.coalesce(F.try_url_decode(_value(p)), _value(p)).alias("v")
        ),
    )
    first_of_key = F.filter(
        entries,
        lambda e, i: F.array_position(F.transform(entries, lambda x: x["k"]), e["k"])
        == (i + 1).cast("long"),
    )
    return F.struct(
        F.trim(F.concat(netloc(u), path(u)), F.lit("/")).alias("action"),
        F.map_from_entries(first_of_key).alias("params"),
    )
