import random
import re
import time
from datetime import datetime
from urllib.parse import parse_qs, urlencode, urlparse, urlunparse

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from newsmill import fixed
from newsmill.functions import dates, markup, text as tx, urls
from newsmill.functions.arrays import trimmed
from newsmill.functions.patterns import any_word
from newsmill.operators.dedup import drop_contained


def values(spark, texts, *cols):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [tuple(r)[1:] if len(cols) > 1 else r[1] for r in df.select("i", *cols).orderBy("i").collect()]


def reencoded(url):
    p = urlparse(url)
    q = {k: v for k, v in parse_qs(p.query, keep_blank_values=True).items() if k.lower() not in fixed.TRACKING_NAMES}
    return urlunparse((p.scheme, p.netloc, p.path, p.params, urlencode(q, doseq=True) if q else "", "")).rstrip("?")


def test_clean_url(spark):
    cases = {
        "https://a.com/x?utm_source=1&b=2#f": "https://a.com/x?b=2",
        "https://a.com/x?UTM_Source=1": "https://a.com/x",
        "HTTPS://a.com/x?": "https://a.com/x",
        "https://a.com/?flag&b=&s=1": "https://a.com/?flag&b=",
        "https://a.com/x?refx=1&ref=2": "https://a.com/x?refx=1",
    }
    assert values(spark, list(cases), urls.clean_url("t")) == list(cases.values())
    assert values(spark, ["https://a.com/x?refx=1&smid=2&k=v"], urls.clean_url_prefixes("t")) == ["https://a.com/x?k=v"]


QUERY = st.lists(
    st.tuples(st.sampled_from(["a", "b", "utm_term", "REF", "x y"]), st.text("ab %+~*é&=", max_size=4)), max_size=5
)


@settings(max_examples=5, deadline=None)
@given(st.lists(QUERY, min_size=10, max_size=30))
def test_clean_url_parity_and_idempotence(spark, queries):
    texts = ["https://h.com/p?" + urlencode(q) for q in queries]
    got = values(spark, texts, urls.clean_url("t", reencode=True), urls.clean_url(urls.clean_url("t")), urls.clean_url("t"))
    assert [g[0] for g in got] == [reencoded(t) for t in texts]
    assert all(g[1] == g[2] for g in got)


def test_link_forms(spark):
    assert values(spark, ["https://l.com/?x=1&dest=https%3A%2F%2Fa.com%2F1", "https://l.com/?url=b", "https://l.com/?q=http%3A%2F%2Fc", "https://l.com/?q=1"], urls.redirect_target("t")) == ["https://a.com/1", "b", "http://c", None]
    assert values(spark, ["https://t.me/chan", "https://t.me/s/chan", "https://x.me/chan"], urls.channel_preview_url("t")) == ["https://t.me/s/chan", "https://t.me/s/chan", "https://x.me/chan"]
    safe = ["https://a.com", "http://127.0.0.1/x", "http://192.168.1.4", "http://[::1]/", "ftp://a.com", "http://8.8.8.8/", "http://localhost:80/"]
    assert values(spark, safe, urls.is_safe("t")) == [True, False, False, False, False, True, False]
    assert values(spark, ["https://youtube.com/watch?v=abc&t=1", "https://youtube.com/shorts/q1?x", "https://youtube.com/live/l2", "https://youtu.be/z9?t=2", "nope"], urls.video_id("t")) == ["abc", "q1", "l2", "z9", None]
    page = '<link rel="canonical" href="https://www.youtube.com/channel/UC1234567890123456789012">'
    assert values(spark, ["https://youtube.com/@handle"], urls.channel_id("t", F.lit(page))) == ["UC1234567890123456789012"]
    got = values(spark, ["app://run?task=a%20b&x=1&task=z"], urls.app_link("t"))[0]
    assert got["action"] == "run" and got["params"] == {"task": "a b", "x": "1"}


def test_dates(spark):
    texts = ["2024-01-05T10:00:00+02:00", "2024-01-05", "05/02/2024", "12/25/2024", "January 5, 2024", "soon"]
    got = values(spark, texts, dates.parse_item_date("t"))
    assert got == [datetime(2024, 1, 5, 10), datetime(2024, 1, 5), datetime(2024, 2, 5), datetime(2024, 12, 25), datetime(2024, 1, 5), None]
    feed = ["Mon, 01 Jan 2024 10:00:00 +0000", "Mon, 01 Jan 2024 10:00:00 GMT", "5 Jan 2024", "2024-01-05T01:02:03Z"]
    assert values(spark, feed, dates.parse_feed_date("t")) == [datetime(2024, 1, 1, 10), datetime(2024, 1, 1, 10), datetime(2024, 1, 5), datetime(2024, 1, 5, 1, 2, 3)]
    now = F.to_timestamp(F.lit("2024-03-10 12:00:00"))
    assert values(spark, ["Streamed 3 hours ago", "2 months ago", "later"], dates.relative_date("t", now)) == [datetime(2024, 3, 10, 9), datetime(2024, 1, 10, 12), None]
    keep = dates.in_date_range(dates.parse_item_date("t"), "2024-01-05", "2024-01-05")
    assert values(spark, ["2024-01-05T23:59:59", "2024-01-06", "", "junk"], keep) == [True, False, True, True]


def test_published_day_from_each_carrier(spark):
    pages = [
        '<meta property="article:published_time" content="2024-01-01T01:00:00Z">',
        '<meta property="og:published_time" content="2024-01-02T01:00:00Z">',
        '<time datetime="2024-01-03T01:00">x</time>',
        "<time>on 2024/1/4 at</time>",
        '<script type="application/ld+json">{"datePublished": "2024-01-06T00:00"}</script>',
        '<span class="post-date">January 7, 2024</span>',
        "<p>none</p>",
    ]
    got = values(spark, pages, markup.published_day("t", F.lit("https://a.com/x")))
    assert got == ["2024-01-01", "2024-01-02", "2024-01-03", "2024-1-4", "2024-01-06", "2024-01-07", None]
    assert values(spark, ["<p>x</p>"], markup.published_day("t", F.lit("https://a.com/p/2024-01-05-s"))) == ["2024-01-05"]


def test_contexts_like_a_regular_expression(spark):
    texts = ["a " * 80 + "sol here " + "b " * 30 + "sol and solana on " + "c" * 150 + " sol", "no term", "sol sol sol " * 40, "x" * 250 + " sol " + "y" * 20 + " solana"]
    want = [[m.group(0) for m in re.finditer(r"(?is).{0,100}\b(solana|sol)\b.{0,100}", t)] for t in texts]
    assert values(spark, texts, tx.contexts("t", any_word(["solana", "sol"]))) == want


def test_keywords_and_score(spark):
    text = "Goldman Sachs backs dYdX as $BTC rallies in New York, says Daily Kraken (ETH) report"
    got = values(spark, [text], tx.keywords("t"))[0]
    assert got[:3] == ["Goldman Sachs", "Daily Kraken", "dYdX"] and "bitcoin" in got
    assert values(spark, [text], tx.keywords("t", 2))[0] == got[:2]
    rows = spark.createDataFrame(
        [("Bitcoin", "Bitcoin", "Bitcoin rises"), ("Bitcoinforme S.L.", "Bitcoin", "Bitcoin rises"), ("BitMEX Exchange", "BitMEX", "BitMEX is up"), ("The Block", "x The Block y", "none"), ("", "a", "a")],
        "n string, k string, t string",
    )
    assert [r[0] for r in rows.select(tx.match_score("n", "k", "t")).collect()] == [1.6, 0.0, 0.75, 0.5, 0.0]


def test_transcript(spark):
    vtt = "WEBVTT\nKind: captions\nLanguage: en\n\n1\n00:01 --> 00:02\n<c>uh hello</c>\n<c>uh hello</c>\n\nworld , um yes\r\nérr error"
    assert values(spark, [vtt], tx.clean_transcript("t")) == [" hello world, yes érr error"]


def test_predicates(spark):
    nav = ["Login", "short", "Sponsored by X and more", "Deal Flow today and tomorrow", "A real headline about the markets"]
    assert values(spark, nav, tx.is_navigation("t")) == [True, True, True, True, False]
    assert values(spark, ["Chart and technical analysis", "RSI bullish divergence", "Breakfast news"], tx.is_chart_topic("t")) == [True, True, False]
    assert values(spark, ["SUI is up"], tx.is_suppressed_topic("t", F.lit("Real Vision"))) == [True]
    assert values(spark, ["SKIP_TA x", "Skipped: technical analysis", "Skipped"], tx.is_model_skip("t")) == [True, True, False]
    assert values(spark, ["(BBG)"], tx.linked_headline("t", F.lit("Japan will slow the pace of QT (BBG)"))) == ["Japan will slow the pace of QT"]


def test_contained_headlines_are_greedy(spark):
    heads = ["Stocks rise", "stocks  RISE today", "Bonds fall", "rise", "Bonds fell", "Bonds fall"]
    kept = []
    for h in heads:
        f = " ".join(h.lower().split())
        if not any(f in k or k in f for k in (" ".join(x.lower().split()) for x in kept)):
            kept.append(h)
    df = spark.createDataFrame([(heads,)], "h array<string>")
    assert df.select(drop_contained(F.col("h"))).first()[0] == kept


def test_contained_headlines_against_loops(spark):
    rng = random.Random(8)
    pages = [[rng.choice(["", "a", "ab", "A  b", "b", "ba b", None, "aba", "bb", "abab a"]) for _ in range(rng.randrange(0, 12))] for _ in range(300)]
    pages = [[h for i, h in enumerate(p) if h != "" or rng.random() < 0.2] for p in pages]

    def kept(heads):
        out, flat = [], []
        for h in heads:
            f = None if h is None else " ".join(h.lower().split())
            if f is None or not any(f in k or k in f for k in flat):
                out.append(h)
                flat += [f] if f is not None else []
        return out

    df = spark.createDataFrame([(i, p) for i, p in enumerate([*pages, None])], "i int, h array<string>")
    got = {r.i: r.k for r in df.select("i", drop_contained(F.col("h")).alias("k")).collect()}
    assert got == {i: kept(p) for i, p in enumerate(pages)} | {len(pages): None}


def test_ten_thousand_headlines_on_a_page(spark):
    heads = [f"Headline number {i} of a long page {i * 7919 % 10_007}" for i in range(10_000)] + ["number 77 of"]
    start = time.time()
    assert len(spark.createDataFrame([(heads,)], "h array<string>").select(drop_contained(F.col("h"))).first()[0]) == 10_000
    assert time.time() - start < 20


def test_character_references(spark):
    import html

    texts = [
        "caf&eacute; &#8230; &#x2014; &euro;5", "&amp;lt; &amp;eacute; &amp&lt", "&copy 2020 &notit &nosuch; & &; &#; &#x; &",
        "&#128; &#x97; &#0; &#xD800; &#1114112; &#99999999999999999999; &#x1F600;&#128512;", "&NotEqualTilde; &fjlig; &amp;amp;", "none", "",
    ]
    got = values(spark, texts, markup.unescape("t"))
    assert got == [html.unescape(t) for t in texts]
    assert values(spark, ["&nbsp;a", None], markup.unescape("t")) == ["\xa0a", None]


def test_article_text_of_any_mark_up(spark):
    inner = "<h1>One</h1><p>Two<br>three &amp; four<p>five"
    same = [
        f"<body><nav>x</nav><article>{inner}</article><p>out</body>",
        f"<body><div class='Main-Content'>no</div><article class=a>{inner}<aside>x</aside></article>",
        f"<div id=top><DIV CLASS='wide post-content'>{inner}<div class='x related-box'>no<p>no</div></div>out</div>",
        f"<main>{inner}<form>no</form><script>var t = '</main>';</script></main><article class=newsletter>no</article>",
        f"<body>{inner}<!-- no --></body>out",
        f"<i>{inner}</i><footer>no</footer>",
        f"<article><section></b>{inner}</section><div class=widget><article>no</article></div></article>out</article>",
    ]
    assert values(spark, same, markup.article_text("t")) == ["One Two three & four five"] * len(same)
    assert values(spark, ["", None, "<p", "a < b"], markup.article_text("t")) == ["", None, "", "a < b"]
    long = "<article>" + "<p>word</p>" * 40_000 + "</article>"
    assert values(spark, [long], markup.article_text("t")) == [" ".join(["word"] * 40_000)]


def test_trimmed_takes_blanks_not_places(spark):
    lines = ["048 a ", " 1x1", " 22 b2 "]
    text = "\n".join(lines)
    assert values(spark, [text], trimmed(F.split("t", "\n"))) == [["048 a", "1x1", "22 b2"]]
    assert values(spark, ["0 One two. 148.9 is it!  22 of 2"], tx.sentences("t")) == [["0 One two.", "148.9 is it!", "22 of 2"]]


def test_references_in_sql(spark):
    """The SQL next to the queries reads character references as the expression does."""
    import duckdb

    from newsmill.suite.base import q, unescape_sql

    texts = [
        "a&ampb &amp;lt; &amp &a &am &notit; &notx &quot", "&#233;&#x2014 &#150; &#0; &#xD800; &#x0000000041;",
        "&#xFFFFFFFFFFFFFFFFFFFF; &#99999999999999999999; &#; &#x;", "&NewLine;|&Tab;|&nbsp;|&nbsp| & &&;", "", "no\nreference",
    ]
    sql = duckdb.connect().sql(" UNION ALL ".join(f"SELECT {unescape_sql(q(t))}" for t in texts)).fetchall()
    assert values(spark, texts, markup.unescape("t")) == [r[0] for r in sql]
    assert sql[0][0] == 'a&b &lt; & &a &am &notit; ¬x "'
