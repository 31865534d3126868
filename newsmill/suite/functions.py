"""F rows of the inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsmill import fixed
from newsmill.functions import dates, markup, text as tx, urls
from newsmill.operators.rows import unnest
from newsmill.suite.base import (
    LINKS, NEWS, PRICED, drop_elements_sql, element_sql, links, lst, netloc_sql, news,
    no_comments_sql, path_sql, plain_sql, priced, q, query, squeeze_sql, stamp, stamp_sql, sub,
    table, title_sql, unescape_sql,
)
from newsmill.suite.predicates import AS_OF, DATE_TEXT, LINES, TASKS, date_text, doc_lines, spoken_sql, tasks, words_sql


@query("f1_links", f"WITH {LINKS} SELECT page_id, pos, href, text FROM links")
def f1(spark, sf):
    return links(spark, sf).select("page_id", "pos", "href", "text")


_BODY = drop_elements_sql(no_comments_sql("html"), fixed.BOILERPLATE_TAGS)


def _content_sql(body: str, tags) -> str:
    parts = ", ".join(f"nullif({element_sql(body, t)}, '')" for t in tags)
    return f"coalesce({parts}, {body})"


@query(
    "f2_article_text",
    f"""WITH b AS (SELECT page_id, {_BODY} AS body FROM pages)
    SELECT page_id, {plain_sql(_content_sql('body', ['article', 'main', 'body']))} AS article FROM b""",
)
def f2(spark, sf):
    from newsmill.sources.pages import article_bodies

    return article_bodies(table(spark, sf, "pages"), "page_id", None)


# Blocks of one tag: split at start tags, cut at the end tag.
def blocks_sql(html: str, names: str) -> str:
    marked = f"regexp_replace({html}, '<({names})(?:\\s[^>]*)?>', chr(1) || '\\1' || chr(2), 'gi')"
    return f"string_split({marked}, chr(1))[2:]"


@query(
    "f3_paragraphs",
    f"""WITH b AS (SELECT page_id, {drop_elements_sql(no_comments_sql('html'), ['script', 'style', 'nav', 'header', 'footer', 'aside', 'iframe'])} AS body FROM pages),
    c AS (SELECT page_id, {_content_sql('body', ['article', 'main', 'body'])} AS content FROM b),
    p AS (SELECT page_id, list_transform({blocks_sql('content', 'p')}, lambda x: {plain_sql("regexp_replace(split_part(x, chr(2), -1), '</p\\s*>.*$', '', 'is')")}) AS ps FROM c)
    SELECT page_id, array_to_string(list_filter(ps, lambda t: length(t) > 50), chr(10) || chr(10)) AS content FROM p""",
)
def f3(spark, sf):
    return table(spark, sf, "pages").select("page_id", markup.paragraph_text("html").alias("content"))


_LINES = (
    "list_filter(list_transform(string_split("
    + unescape_sql(f"regexp_replace(regexp_replace({no_comments_sql('html')}, '<br\\s*/?>', chr(10), 'gi'), '<[^>]*>', chr(10), 'gs')")
    + f", chr(10)), lambda x: {squeeze_sql('x')}), lambda x: x <> '')"
)


@query(
    "f4_text_lines",
    f"SELECT page_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT page_id, {_LINES} AS l FROM pages) s",
)
def f4(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.posexplode(markup.text_lines("html")).alias("pos", "line"))


# The same pages with character references by name and number, and with their article told by a
# class, next to matter that a class marks as related.
CODED, DECODED = "Caf&eacute; &#8230; &#x2014; &euro;5 &amp;lt; ", "Café … — €5 &lt; "


@query(
    "f1_links_references",
    f"""WITH coded AS (SELECT page_id, url, replace(html, '<a href="/', '<a href="/caf&#233;&sol;x/') AS html FROM pages),
    {LINKS.replace("FROM pages", "FROM coded")} SELECT page_id, pos, replace(href, 'caf&#233;&sol;x', 'café/x') AS href, text FROM links""",
)
def f1_references(spark, sf):
    pages = table(spark, sf, "pages")
    coded = pages.withColumn("html", F.replace("html", F.lit('<a href="/'), F.lit('<a href="/caf&#233;&sol;x/')))
    return unnest(coded, markup.links("html"), "a", "pos", "page_id").select("page_id", "pos", "a.href", "a.text")


@query(
    "f4_text_lines_references",
    f"""SELECT page_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT page_id, {_LINES.replace("html", "plain")} AS l
    FROM (SELECT page_id, replace(html, '<p>', '<p>{DECODED.replace("&lt;", "@@")}') AS plain FROM pages)) s""",
)
def f4_references(spark, sf):
    lines = markup.text_lines(F.replace("html", F.lit("<p>"), F.lit(f"<p>{CODED}")))
    rows = table(spark, sf, "pages").select("page_id", F.posexplode(lines).alias("pos", "line"))
    return rows.withColumn("line", F.replace("line", F.lit("&lt;"), F.lit("@@")))


@query(
    "f2_article_marked",
    f"""WITH b AS (SELECT page_id, {_BODY} AS body FROM pages)
    SELECT page_id, {plain_sql(element_sql("body", "article"))} || ' ' || '{DECODED.strip()}' AS article FROM b""",
)
def f2_marked(spark, sf):
    from newsmill.sources.pages import article_bodies

    tail = f'<div class="box subscribe-box"><p>Join us <b>now</b></p></div><p>{CODED}</p><div id="related-2"><article>Other</article></div></div>'
    marked = F.replace(F.replace("html", F.lit("<article>"), F.lit('<div class="wide post-content">')), F.lit("</article>"), F.lit(tail))
    return article_bodies(table(spark, sf, "pages").withColumn("html", marked))


@query("f5_link_context", f"SELECT doc_id, {squeeze_sql('text')} AS context FROM documents")
def f5(spark, sf):
    return table(spark, sf, "documents").select("doc_id", markup.link_context("text").alias("context"))


_SEG = f"string_split(trim({path_sql('url')}, '/'), '/')[-1]"


@query(
    "f6_slug_title",
    f"""WITH {LINKS}, a AS (SELECT page_id, pos, regexp_extract(url, '^[^?#]*') || '/' || replace(text, ',', '-') || '_x-y' AS url FROM links)
    SELECT page_id, pos, {title_sql(sub(_SEG, '[-_]', ' '))} AS title FROM a""",
)
def f6(spark, sf):
    a = links(spark, sf).withColumn(
        "u", F.concat(F.regexp_extract("url", "^[^?#]*", 0), F.lit("/"), F.replace("text", F.lit(","), F.lit("-")), F.lit("_x-y"))
    )
    return a.select("page_id", "pos", urls.slug_title("u").alias("title"))


_TITLE = squeeze_sql(unescape_sql(sub("regexp_extract(html, '<title\\b[^>]*>(.*?)(?:</title\\s*>|$)', 1, 'is')", "<[^>]*>", "")))


@query(
    "f7_site_names",
    f"""WITH t AS (SELECT page_id, url, {_TITLE} AS title FROM pages)
    SELECT page_id, coalesce(nullif(trim(split_part(title, '|', 1)), ''), {title_sql("split_part(" + netloc_sql('url') + ", '.', 1)")}) AS site_name,
      coalesce(nullif(title, ''), {netloc_sql('url')}) AS page_name,
      {title_sql("split_part(replace(" + netloc_sql('url') + ", 'www.', ''), '.', 1)")} AS host_name FROM t""",
)
def f7(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", markup.site_name("html", "url").alias("site_name"),
        markup.page_name("html", "url").alias("page_name"), urls.host_label("url").alias("host_name"),
    )


def all_sql(text: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract_all({text}, {q(pattern)}, {group})"


STOP = sorted({w.lower() for w in fixed.KEYWORD_STOP_WORDS})
_ALIAS = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in fixed.NAME_ALIASES.items()) + "}"
_TICKER = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in fixed.TICKER_NAMES.items()) + "}"


def keyword_ctes(source: str, key: str, text: str) -> str:
    """kw(key, kws): keywords of a text column of a relation."""
    return f"""k1 AS (SELECT {key}, {text} AS t,
      list_filter({all_sql(text, fixed.PHRASE_PATTERN)}, lambda p: NOT list_contains({lst(fixed.KEYWORD_STOP_PHRASES)}, p)) AS phrases,
      list_filter({all_sql(text, fixed.MIXED_CASE_PATTERN)}, lambda w: length(w) >= 3 AND NOT list_contains({lst(STOP)}, lower(w))) AS mixed,
      list_transform({all_sql(text, fixed.MARKED_TICKER_PATTERN)}, lambda x: {_ALIAS}[lower(x)]) AS aliases,
      list_filter({all_sql(text, fixed.LEADING_WORD_PATTERN)}, lambda w: NOT list_contains({lst(STOP)}, lower(w))) AS leading_words,
      list_transform({all_sql(text, fixed.TICKER_PATTERN)}, lambda x: {_TICKER}[x]) AS tickers FROM {source}),
    k2 AS (SELECT {key}, t, phrases, list_filter(mixed || aliases || leading_words || tickers, lambda x: x IS NOT NULL AND x <> '') AS later FROM k1),
    k3 AS (SELECT {key}, t, phrases, later, list_transform(later, lambda x: lower(x)) AS low, list_transform(phrases, lambda x: lower(x)) AS taken FROM k2),
    kw AS (SELECT {key}, t, (phrases || list_filter(later, lambda x, i: list_position(low, lower(x)) = i AND NOT list_contains(taken, lower(x)))) AS kws FROM k3)"""


@query("f8_keywords", f"WITH {keyword_ctes('documents', 'doc_id', 'text')} SELECT doc_id, array_to_string(kws, '|') AS keywords FROM kw")
def f8(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.array_join(tx.keywords("text", ascii_boundary=True), "|").alias("keywords")
    )


def score_sql(n: str, k: str, t: str) -> str:
    """Score over lower-cased name, keyword and text."""
    suffix = "(" + " OR ".join(
        f"(contains({n}, {q(s)}) AND NOT contains({t}, {q(s)}))" for s in fixed.LEGAL_SUFFIXES
    ) + ")"
    extra = (
        f"len(list_filter(list_distinct({words_sql(n)}), lambda w: NOT list_contains({words_sql(k)}, w) "
        f"AND NOT list_contains({lst(fixed.NAME_FILLER_WORDS)}, w)))"
    )
    base = (
        f"CASE WHEN {n} = {k} THEN 1.0 WHEN starts_with({n}, {k} || ' ') OR starts_with({n}, {k} || '-') "
        f"THEN CASE WHEN {suffix} THEN 0.4 ELSE 0.75 END WHEN starts_with({n}, {k}) THEN CASE WHEN {suffix} THEN 0.3 ELSE 0.7 END "
        f"WHEN contains({n}, {k}) THEN CASE WHEN {extra} > 1 OR {suffix} THEN 0.3 ELSE 0.5 END "
        f"WHEN contains({k}, {n}) THEN 0.5 ELSE 0.0 END"
    )
    bonus = (
        f"CASE WHEN regexp_matches({t}, '\\b' || regexp_escape({n}) || '\\b') THEN 0.6 "
        f"WHEN contains({t}, {n}) THEN 0.3 ELSE 0.0 END"
    )
    penalty = f"CASE WHEN {suffix} AND {n} <> {k} THEN 0.3 ELSE 0.0 END"
    return f"greatest(0.0, least(2.0, round(CAST(({base}) + ({bonus}) - ({penalty}) AS DOUBLE), 6)))"


@query(
    "f9_match_score",
    f"""WITH p AS (SELECT p_partkey, lower(p_name) AS n, lower(string_split(p_name, ' ')[-1]) AS k, lower(p_type || ' ' || p_name || ' ' || p_brand) AS t FROM part
      UNION ALL SELECT p_partkey, lower(p_name || CASE WHEN p_size > 25 THEN ' Token' ELSE ' Club' END), lower(string_split(p_name, ' ')[1]), lower(p_type || ' of ' || p_name || 's token') FROM part
      UNION ALL SELECT p_partkey, lower(string_split(p_name, ' ')[1]), lower(p_name), lower(p_name) FROM part)
    SELECT p_partkey, {score_sql('n', 'k', 't')} AS score FROM p""",
)
def f9(spark, sf):
    p = table(spark, sf, "part")
    first, last = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    cat = lambda *c: F.concat(*c)
    a = p.select("p_partkey", F.col("p_name").alias("n"), last.alias("k"),
                 cat("p_type", F.lit(" "), "p_name", F.lit(" "), "p_brand").alias("t"))
    b = p.select(
        "p_partkey", cat("p_name", F.when(F.col("p_size") > 25, " Token").otherwise(" Club")).alias("n"), first.alias("k"),
        cat("p_type", F.lit(" of "), "p_name", F.lit("s token")).alias("t"),
    )
    c = p.select("p_partkey", first.alias("n"), F.col("p_name").alias("k"), F.col("p_name").alias("t"))
    return a.unionByName(b).unionByName(c).select(
        "p_partkey", tx.match_score("n", "k", "t", ascii_boundary=True).alias("score")
    )


def _subject_sql(text: str) -> str:
    parts = []
    for p in fixed.SUBJECT_PATTERNS:
        hit = f"regexp_extract({text}, {q('(?i)' + p)}, 1)"
        parts.append(
            f"CASE WHEN length({hit}) > 2 AND NOT list_contains({lst(fixed.SUBJECT_REJECTED)}, lower({hit})) THEN {hit} END"
        )
    return f"coalesce({', '.join(parts)})"


@query("f10_main_subject", f"SELECT doc_id, {_subject_sql('txt')} AS subject FROM (SELECT doc_id, regexp_replace(text, '\\b(?i:than)\\b', 'raises', 'g') AS txt FROM documents) s")
def f10(spark, sf):
    from newsmill.functions.patterns import bounded

    d = table(spark, sf, "documents").select(
        "doc_id", F.regexp_replace("text", bounded(r"\b(?i:than)\b", True), "raises").alias("txt")
    )
    return d.select("doc_id", tx.main_subject("txt", None, ascii_boundary=True).alias("subject"))


def _context_sql(text: str, terms) -> str:
    body = "|".join(terms)
    return f"list_transform(regexp_extract_all({text}, {q('(?is).{0,100}' + chr(92) + 'b(' + body + ')' + chr(92) + 'b.{0,100}')}, 0), lambda c: trim(c, ' '))"


_SUPPORT = "(?i)" + "|".join(fixed.SUPPORT_PATTERNS)


@query(
    "f11_support_check",
    f"""WITH c AS (SELECT doc_id, {_context_sql('text', ['than', 'that'])} AS ctx FROM documents),
    b AS (SELECT doc_id, ctx, list_filter(ctx, lambda x: regexp_matches(x, {q(_SUPPORT)})) AS backing FROM c)
    SELECT doc_id, CASE WHEN len(backing) > 0 THEN 'Than: "' || {squeeze_sql('backing[1]')} || '..."'
      WHEN len(ctx) > 0 THEN 'Than: mentioned (verify manually)' END AS note FROM b""",
)
def f11(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", tx.support_note("text", "Than", ["than", "that"], ascii_boundary=True).alias("note")
    )


@query(
    "f12_comments",
    """SELECT d.doc_id, coalesce(nullif(array_to_string(list_filter([CASE WHEN l.quality = 1 THEN 'Quality ' || d.lang END,
      CASE WHEN l.toxic = 1 THEN 'Toxic ' || d.source END, CASE WHEN d.n_chars > 5000 THEN 'Long' END], lambda x: x IS NOT NULL), ' | '), ''),
      'No relevant mentions') AS comments FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def f12(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.select(
        "doc_id",
        tx.join_comments(
            F.when(F.col("quality") == 1, F.concat(F.lit("Quality "), "lang")),
            F.when(F.col("toxic") == 1, F.concat(F.lit("Toxic "), "source")),
            F.when(F.col("n_chars") > 5000, "Long"),
        ).alias("comments"),
    )


@query(
    "f12_failure_comments",
    """SELECT page_id, CASE regexp_extract(url, '^https?://[^/]*/([a-z]*)', 1) WHEN 'en' THEN 'Timeout: ' || url[1:30] || '... took too long'
      WHEN 'de' THEN 'Connection error: Could not reach ' || url[1:30] || '...' WHEN 'fr' THEN 'Access denied: ' || url[1:30] || '... requires auth'
      ELSE 'Not found: ' || url[1:30] || '... may be deleted' END AS comment FROM pages""",
)
def f12b(spark, sf):
    lang = F.regexp_extract("url", "^https?://[^/]*/([a-z]*)", 1)
    kind = (
        F.when(lang == "en", "Read timeout").when(lang == "de", "connection refused").when(lang == "fr", "HTTP 403")
        .otherwise("HTTP 404")
    )
    return table(spark, sf, "pages").select("page_id", tx.fetch_failure_comment(kind, "url", "url").alias("comment"))


@query(
    "f13_date_parse",
    f"""WITH {DATE_TEXT} SELECT o_orderkey, {stamp_sql("coalesce(try_strptime(txt, '%Y-%m-%dT%H:%M:%SZ'), try_strptime(txt, '%Y-%m-%d'), try_strptime(txt, '%B %d, %Y'))")} AS archive_date,
      {stamp_sql("coalesce(try_strptime(txt, '%Y-%m-%dT%H:%M:%SZ'), try_strptime(txt, '%Y-%m-%d'), try_strptime(txt, '%B %d, %Y'))")} AS feed_date,
      {stamp_sql("coalesce(try_strptime(replace(txt, 'Z', ''), '%Y-%m-%dT%H:%M:%S'), try_strptime(txt, '%B %d, %Y'), try_strptime(txt, '%Y-%m-%d'), try_strptime(txt, '%m/%d/%Y'))")} AS newsletter_date,
      {stamp_sql('o_orderdate')} AS rss_date FROM date_text""",
)
def f13(spark, sf):
    rss = F.date_format("d", "EEE, dd MMM yyyy HH:mm:ss '+0000'")
    return date_text(spark, sf).select(
        "o_orderkey",
        stamp(dates.parse_archive_date("txt").cast("timestamp")).alias("archive_date"),
        stamp(dates.parse_feed_date("txt")).alias("feed_date"),
        stamp(dates.parse_newsletter_date("txt")).alias("newsletter_date"),
        stamp(dates.parse_feed_date(rss)).alias("rss_date"),
    )


_AGO = """ago AS (SELECT event_id, ts, CASE event_type WHEN 'click' THEN 'Streamed ' || user_id || ' hours ago' WHEN 'view' THEN user_id || ' days ago'
   WHEN 'purchase' THEN 'Premiered ' || user_id || ' weeks ago' WHEN 'signup' THEN user_id || ' months ago' ELSE 'just now' END AS age,
   CASE event_type WHEN 'click' THEN user_id WHEN 'view' THEN user_id * 24 WHEN 'purchase' THEN user_id * 168 WHEN 'signup' THEN user_id * 720 END AS hours FROM events)"""


@query("f14_relative_date", f"WITH {_AGO} SELECT event_id, {stamp_sql('ts - INTERVAL 1 HOUR * hours')} AS published FROM ago")
def f14(spark, sf):
    u = F.col("user_id").cast("string")
    kind = F.col("event_type")
    age = (
        F.when(kind == "click", F.concat(F.lit("Streamed "), u, F.lit(" hours ago")))
        .when(kind == "view", F.concat(u, F.lit(" days ago")))
        .when(kind == "purchase", F.concat(F.lit("Premiered "), u, F.lit(" weeks ago")))
        .when(kind == "signup", F.concat(u, F.lit(" months ago"))).otherwise("just now")
    )
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select("event_id", stamp(dates.relative_date(age, "ts")).alias("published"))


@query(
    "f15_age_text",
    """WITH s AS (SELECT event_id, CAST(epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(ts)) AS BIGINT) AS s FROM events)
    SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || ' minute' || CASE WHEN s // 60 <> 1 THEN 's' ELSE '' END || ' ago'
      WHEN s < 86400 THEN (s // 3600) || ' hour' || CASE WHEN s // 3600 <> 1 THEN 's' ELSE '' END || ' ago'
      ELSE (s // 86400) || ' day' || CASE WHEN s // 86400 <> 1 THEN 's' ELSE '' END || ' ago' END AS age FROM s""",
)
def f15(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select("event_id", dates.age_text("ts", F.to_timestamp(F.lit("2024-01-31 00:00:00"))).alias("age"))


# Pages that carry their day in a meta tag, a time element or the path of their URL.
DATED = """dated AS (SELECT p.page_id, strftime(o.o_orderdate, '%Y-%m-%d') AS day FROM pages p JOIN orders o ON o.o_orderkey = p.page_id)"""


def dated_pages(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("page_id"), "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")
    )
    p = table(spark, sf, "pages").join(o, "page_id")
    s = F.col("o_orderstatus")
    tag = (
        F.when(s == "F", F.concat(F.lit('<meta property="article:published_time" content="'), "day", F.lit('T08:00:00Z">')))
        .when(s == "O", F.concat(F.lit('<time datetime="'), "day", F.lit('">then</time>')))
        .otherwise("")
    )
    url = F.when(s == "P", F.concat(F.lit("https://n.example.com/p/"), "day", F.lit("-issue"))).otherwise(F.col("url"))
    return p.select(
        "page_id", url.alias("url"), F.regexp_replace("html", "<head>", F.concat(F.lit("<head>"), tag)).alias("html"), "day"
    )


@query("f16_page_date", f"WITH {DATED} SELECT page_id, day AS published FROM dated")
def f16(spark, sf):
    return dated_pages(spark, sf).select("page_id", markup.published_day("html", "url").alias("published"))


@query(
    "f17_week_label",
    """SELECT o_orderkey, 'Week_' || weekofyear(o_orderdate) || '_' || isoyear(o_orderdate) AS week,
     'Week_' || weekofyear(o_orderdate) || '_' || year(o_orderdate) AS calendar_week FROM orders""",
)
def f17(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", dates.week_label("o_orderdate").alias("week"),
        dates.week_label("o_orderdate", True).alias("calendar_week"),
    )


# Caption files made of the lines of documents: every line gets a cue, every second one a repeat.
def captions(text="text"):
    numbered = F.transform(
        F.split(F.col(text), "\n"),
        lambda x, i: F.concat(
            (i + 1).cast("string"), F.lit("\n00:01 --> 00:02\n<c>uh "), x, F.lit("</c>\n"), F.when(i % 2 == 0, F.concat(F.lit("<c>uh "), x, F.lit("</c>"))).otherwise("")
        ),
    )
    return F.concat(F.lit("WEBVTT\nKind: captions\nLanguage: en\n\n"), F.array_join(numbered, "\n"))


def strip_fillers_sql(t: str) -> str:
    for p in fixed.FILLER_PATTERNS:
        t = sub(t, p, "")
    return sub(sub(t, "  +", " "), " ([,.])", "\\1")


@query(
    "f18_transcript",
    f"""WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: trim('<c>uh ' || x || '</c>')) AS ls FROM documents),
    k AS (SELECT doc_id, list_filter(ls, lambda x, i: i = 1 OR x <> ls[i - 1]) AS ks FROM l)
    SELECT doc_id, {strip_fillers_sql("array_to_string(list_transform(ks, lambda x: regexp_replace(x, '<[^>]+>', '', 'g')), ' ')")} AS spoken FROM k""",
)
def f18(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", tx.clean_transcript(captions(), ascii_boundary=True).alias("spoken")
    )


@query("f19_spoken_headline", f"""WITH {LINES} SELECT doc_id, pos, {spoken_sql("line || ' (BBG) up 5 bps YoY (10Y note) ('")} AS spoken FROM lines""")
def f19(spark, sf):
    return doc_lines(spark, sf).select(
        "doc_id", "pos", tx.spoken_headline(F.concat("line", F.lit(" (BBG) up 5 bps YoY (10Y note) ("))).alias("spoken")
    )


def spoken_title_sql(t: str) -> str:
    for a, b in fixed.TITLE_REPLACEMENTS:
        t = f"replace({t}, {q(a)}, {q(b)})"
    return squeeze_sql(sub(t, f"[{fixed.TITLE_EMOJI}]", ""))


@query("f20_spoken_title", f"SELECT doc_id, {spoken_title_sql('text')} AS spoken FROM documents")
def f20(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.spoken_title("text").alias("spoken"))


def sentences_raw_sql(t: str) -> str:
    return f"string_split(regexp_replace({t}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"


def trim_ws_sql(t: str) -> str:
    return sub(t, "^\\s+|\\s+$", "")


def summary_sql(t: str) -> str:
    t = trim_ws_sql(t)
    for p in fixed.INTRO_PATTERNS:
        t = f"regexp_replace({t}, {q(p)}, '', 'gi')"
    return f"array_to_string(list_filter({sentences_raw_sql(t)}, lambda s: length(s) > 20), ' ')"


def cut_sql(j: str) -> str:
    last = f"(length({j}) - strpos(reverse({j}), '.') + 1)"
    return (
        f"CASE WHEN {j} <> '' AND NOT regexp_matches({j}, '[.!?]$') AND contains({j}, '.') "
        f"AND {last} - 1 > length({j}) // 2 THEN {j}[1:{last}] ELSE {j} END"
    )


@query(
    "f21_extractive_summary",
    f"""WITH s AS (SELECT doc_id, {summary_sql("CASE WHEN lang = 'en' THEN 'Hey everyone, ' ELSE '' END || text")} AS j FROM documents)
    SELECT doc_id, {cut_sql('j')} AS summary FROM s""",
)
def f21(spark, sf):
    t = F.concat(F.when(F.col("lang") == "en", "Hey everyone, ").otherwise(""), "text")
    return table(spark, sf, "documents").select("doc_id", tx.extractive_summary(t).alias("summary"))


@query(
    "f22_sentences",
    f"""SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS sentence FROM (SELECT doc_id,
      list_filter(list_transform({sentences_raw_sql('text')}, lambda x: trim(x)), lambda x: x <> '') AS s FROM documents) t""",
)
def f22(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(tx.sentences("text")).alias("pos", "sentence"))


@query("f22_after_marker", "SELECT conv_id, turn, CASE WHEN role = 'user' THEN text END AS body FROM conversations")
def f22b(spark, sf):
    prompt = F.when(F.col("role") == "user", F.concat(F.lit("Summarise.\nTranscript:\n"), "text")).otherwise(
        F.concat(F.lit("No marker: "), F.replace("text", F.lit(":"), F.lit(" ")))
    )
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.after_marker(prompt).alias("body"))


@query("f23_cost", f"WITH {PRICED} SELECT call_id, model, cost FROM priced")
def f23(spark, sf):
    return priced(spark, sf).select("call_id", "model", "cost")


@query(
    "f24_size_routing",
    f"""SELECT doc_id, length(text) // 4 AS tokens, CASE WHEN length(text) // 4 <= 10000 THEN 'remote,local' ELSE 'local,remote' END AS route,
     CASE WHEN len({words_sql('text')}) / 150.0 > 30 THEN 'long' ELSE 'short' END AS length_class FROM documents""",
)
def f24(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", tx.token_estimate("text").alias("tokens"), tx.route_by_size("text").alias("route"),
        tx.length_class("text").alias("length_class"),
    )


@query(
    "f26_next_run",
    f"""WITH {TASKS}, n AS (SELECT *, TIMESTAMP '{AS_OF}' AS now, TIMESTAMP '2024-05-15 00:00:00' AS midnight,
       CAST(split_part(run_at_time, ':', 1) AS INT) AS h, run_on_day - 2 AS ahead FROM tasks),
     m AS (SELECT *, ahead + CASE WHEN ahead < 0 OR (ahead = 0 AND 12 * 60 + 30 >= h * 60 + 30) THEN 7 ELSE 0 END AS days FROM n)
    SELECT task_id, {stamp_sql('''CASE interval WHEN 'hourly' THEN TIMESTAMP '2024-05-15 13:00:00' WHEN 'every_6_hours' THEN TIMESTAMP '2024-05-15 18:00:00'
       WHEN 'daily' THEN midnight + INTERVAL 1 HOUR * h + INTERVAL 30 MINUTE + CASE WHEN h <= 12 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END
       WHEN 'weekly' THEN midnight + INTERVAL 1 DAY * days + INTERVAL 1 HOUR * h + INTERVAL 30 MINUTE
       WHEN 'custom_hours' THEN now + INTERVAL 1 HOUR * custom_hours END''')} AS next_run FROM m""",
)
def f26(spark, sf):
    run = dates.next_run("interval", "run_at_time", "run_on_day", "custom_hours", F.to_timestamp(F.lit(AS_OF)))
    return tasks(spark, sf).select("task_id", stamp(run).alias("next_run"))


_SECTIONS = "CASE " + " ".join(
    f"WHEN contains(h, {q(k)}) THEN {q(v)}" for k, v in fixed.SECTION_KEYWORDS.items()
) + " ELSE 'General' END"
_TRAINING = "CASE " + " ".join(
    f"WHEN contains(lower(h), {q(s.lower())}) THEN {q(s)}" for s in fixed.TRAINING_SECTIONS
) + " ELSE 'Unknown' END"


@query(
    "f28_sections",
    f"""WITH s AS (SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'Deal Flow' WHEN 'STANDARD' THEN 'The Markets today' WHEN 'PROMO' THEN 'New IPO list'
       WHEN 'SMALL' THEN 'debt' ELSE p_type END || ' ' || p_name AS h FROM part) SELECT p_partkey, {_SECTIONS} AS section, {_TRAINING} AS training_section FROM s""",
)
def f28(spark, sf):
    t = F.col("p_type")
    h = F.concat(
        F.when(t == "ECONOMY", "Deal Flow").when(t == "STANDARD", "The Markets today").when(t == "PROMO", "New IPO list")
        .when(t == "SMALL", "debt").otherwise(t),
        F.lit(" "), "p_name",
    )
    return table(spark, sf, "part").select(
        "p_partkey", markup.keyword_section(h).alias("section"), markup.training_section(h).alias("training_section")
    )


@query(
    "f29_linked_headline",
    f"""WITH {NEWS}, h AS (SELECT item_id, source_name AS a, title || ' (' || 'Bloomberg' || ')' AS p FROM news)
     SELECT item_id, CASE WHEN length(a) < 20 AND length(p) > length(a) + 5 THEN trim(regexp_replace(trim(title || ' ()'), '\\s*\\(\\s*\\)\\s*$', '')) ELSE a END AS headline FROM
      (SELECT h.*, n.title FROM h JOIN news n USING (item_id)) t""",
)
def f29(spark, sf):
    n = news(spark, sf)
    return n.select(
        "item_id",
        tx.linked_headline("source_name", F.concat("title", F.lit(" (Bloomberg)"))).alias("headline"),
    )
