
import pytest
from pyspark.sql import functions as F

from newsmill.operators import admission
from newsmill.plans import harvest, maintain, market
from newsmill.session import scratch
from newsmill.sources import pages as pg, registry, state
from newsmill.streaming import jobs
from tests_support import write_text

def as_of():
    return F.to_timestamp(F.lit("2024-03-01 00:00:00"))


# --- state (S18, T2) --------------------------------------------------------

@pytest.mark.parametrize(
    "text,ids",
    [
        ('{"version": 1, "videos": {"a": {"processed_date": "2024-02-20", "title": "t"}}}', ["a"]),
        ("{not json", []),
        ("", []),
        ('["wrong"]', []),
        ('{"version": 1}', []),
    ],
)
def test_state_documents(spark, text, ids):
    path = write_text(spark, "state", text)
    assert [r.id for r in state.load_document(spark, path).collect()] == ids


def test_state_missing_inputs(spark):
    assert state.load_document(spark, None).count() == 0
    assert state.load_document(spark, "/tmp/none-there.json").count() == 0
    assert state.load_state(spark, None).count() == 0
    assert state.load_state(spark, scratch(spark, "none")).count() == 0
    state.save_state(None, None, as_of())


def test_state_round_trip_and_time_to_live(spark):
    base = scratch(spark, "state")
    rows = spark.createDataFrame([("new", "2024-02-20", "t"), ("old", "2024-01-01", "t"), ("edge", "2024-01-31", None)], "id string, processed_date string, title string")
    state.save_state(rows, base, as_of())
    assert {r.id for r in state.load_state(spark, base).collect()} == {"new", "edge"}
    more = state.mark_processed(state.load_state(spark, base), spark.createDataFrame([("x",), ("new",)], "id string"), as_of())
    state.save_state(more, base, as_of())
    got = {r.id: r.processed_date for r in state.load_state(spark, base).collect()}
    assert got == {"new": "2024-03-01", "edge": "2024-01-31", "x": "2024-03-01"}


# --- registries -------------------------------------------------------------

def test_registry_and_fallback(spark):
    path = write_text(spark, "reg", '{"sources": ["https://youtu.be/x", {"url": "https://a.com/feed", "name": "A"}, {"url": "https://b.com", "enabled": false}]}')
    got = [(r.url, r.type, r.name) for r in registry.read_sources(spark, path).collect()]
    assert got == [("https://youtu.be/x", "youtube", None), ("https://a.com/feed", "rss", "A")]
    text = write_text(spark, "txt", "# comment\n\nhttps://youtube.com/@c\n")
    empty = write_text(spark, "reg", '{"sources": []}')
    assert [(r.url, r.type) for r in registry.read_sources(spark, empty, text).collect()] == [("https://youtube.com/@c", "youtube")]


def test_rule_files(spark):
    folder = scratch(spark, "rules")
    for name, body in (("b_set", '{"name": "B", "csv_columns": ["url"]}'), ("_template", '{"name": "T"}'), ("a_set", "{}")):
        write_text(spark, "", body, f"{folder}/{name}.json")
    got = [(r.name, r.display_name) for r in registry.read_rules(spark, folder).orderBy("rule_order").collect()]
    assert got == [("a_set", "a_set"), ("b_set", "B")]


# --- pages ------------------------------------------------------------------

def page(spark, html, url="https://n.beehiiv.com/p/2024-02-03-issue"):
    return spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")


NEWSLETTER = """<html><head><meta property="og:site_name" content="Sum"></head><body><div class="post-content">
<h2>Launches</h2><p>Acme <a href="https://links.beehiiv.com/v?dest=https%3A%2F%2Facme.com%2Fa%3Futm_source%3Dx">raises</a> money</p>
<ul><li><a href="https://b.com/long-story?ref=1"></a></li></ul><p><a href="#top">x</a><a href="mailto:a@b">m</a><a href="/subscribe">s</a></p>
<h3>Sponsors</h3><p>Buy <a href="https://ads.com/x">this</a> and <a href="https://acme.com/a">again</a></p></div></body></html>"""


def test_harvest_links(spark):
    rows = harvest.harvest_links(page(spark, NEWSLETTER)).orderBy("block", "pos").collect()
    assert [(r.title, r.url, r.category) for r in rows] == [
        ("raises", "https://acme.com/a", "Launches"), ("Long Story", "https://b.com/long-story", "Launches"), ("this", "https://ads.com/x", "Sponsors"),
    ]
    assert rows[0].source_name == "Sum" and rows[0].date_published == "2024-02-03" and rows[0].description == "Acme raises money"
    kept = harvest.harvest_links(page(spark, NEWSLETTER), overrides={"exclude_categories": ["sponsor"]})
    assert kept.count() == 2


def test_article_bodies_drop_marked_elements(spark):
    html = '<body><nav>n</nav><div class="sidebar-left"><div>deep <b>side</b></div></div><div class="x article-body"><p>Real <i>text</i></p><div id="related-posts">rel</div> end &amp; more</div><p>after</p></body>'
    assert pg.article_bodies(page(spark, html)).first().article == "Real text end & more"
    plain = "<body><header>h</header><article><p>One</p><p>Two"
    assert pg.article_bodies(page(spark, plain)).first().article == "One Two"


ARCHIVE = """<div class="card"><a href="/p/one"><img></a><a href="/p/one?x=1">One</a><time datetime="2024-02-10T01:02:03Z">d</time></div>
<div><a href="https://n.com/p/two">Two</a><time>February 5, 2024</time></div><div><a href="/p/three">Three</a><time>Jan 1, 2024</time></div><a href="/p/four">Four</a>"""


def test_archive_posts(spark):
    pages = spark.createDataFrame([("a", 0, "https://n.com/archive", ARCHIVE), ("a", 1, "https://n.com/archive?page=1", ARCHIVE)], "archive string, page_no int, url string, html string")
    got = [(r.url, r.date) for r in pg.archive_posts(pages).collect()]
    assert got[-1] == ("https://n.com/p/one", "2024-02-10") and got[-2] == ("https://n.com/p/two", "2024-02-05") and len(got) == 4
    since = [r.url for r in pg.archive_posts(pages, "2024-02-01").collect()]
    assert since == ["https://n.com/p/two", "https://n.com/p/one"]


def test_archive_links(spark):
    html = '<article class="post"><a href="/x/1"><h2>Heading one</h2></a><time datetime="2024-01-02">t</time></article><div class="entry"><a href="/x/2">5 min read | A longer link text</a></div>'
    got = [(r.url, r.title) for r in pg.archive_links(page(spark, html, "https://s.com/a")).orderBy("pos").collect()]
    assert got == [("https://s.com/x/1", "Heading one"), ("https://s.com/x/2", "A longer link text")]
    bare = '<a href="/about">About</a><a href="/p/some-slug.html">x</a><a href="https://s.com/2024/05/piece_two">Short</a>'
    assert [r.title for r in pg.archive_links(page(spark, bare, "https://s.com/a")).orderBy("pos").collect()] == ["Some Slug", "Piece Two"]


MARKET = """<body><p><time datetime="2024-02-02T00:00:00">x</time></p><h2>Markets</h2><ul><li>Stocks rally as the dollar drops 2%</li><li>Stocks rally as the dollar drops 2%</li><li>Click to join our markets club today</li></ul>
<h2>Headline Roundup</h2><p>Norway plans to widen its harbour tolls (BBG)</p><p>Too short</p><p>Firms are quietly driving</p><h2>Deal Flow</h2><p>Acme agreed to buy Widget Corp for cash (<a href="https://www.reuters.com/deal?utm_source=1">RT</a>)</p></body>"""


def test_market_digest(spark):
    got = [(r.title, r.section, r.source) for r in market.market_digest(page(spark, MARKET), {}).collect()]
    assert got[:2] == [("Stocks rally as the dollar drops 2%", "Markets", "ExecSum"), ("Norway plans to widen its harbour tolls", "Headline Roundup", "ExecSum")]
    assert got[2] == ("Acme agreed to buy Widget Corp for cash (RT)".replace(" (RT)", ""), "Deal Flow", "Reuters") or got[2][1:] == ("Deal Flow", "Reuters")
    train = market.training_links(page(spark, MARKET), {"blocked_domains": ["reuters.com"]}).first()
    assert train.is_blocked and train.section == "Deal Flow" and train.source == "RT"


def test_headlines(spark):
    html = '<article><h2>News</h2><p><a href="https://bloomberg.com/1">Central bank holds rates steady again</a></p><p>Central bank holds rates steady again today</p><p>An item without a trusted link in it at all</p><h2>Ads</h2><p><a href="https://bloomberg.com/2">Something long enough to be a headline</a></p><p><strong>Markets</strong></p><ul><li>Oil climbed past eighty dollars a barrel</li></ul></article>'
    rule = {"name": "N", "exclude_sections": ["ads"], "allowed_source_domains": ["bloomberg.com"]}
    got = [(r.title, r.metadata["section"]) for r in harvest.harvest_headlines(page(spark, html), rule, as_of()).orderBy("pos").collect()]
    assert got == [("Central bank holds rates steady again", "News"), ("Oil climbed past eighty dollars a barrel", "Markets")]


# --- streams ----------------------------------------------------------------

def test_append_stream_in_two_steps(spark):
    source, target, check = (scratch(spark, n) for n in ("in", "target", "check"))
    schema = "url string, pos int"
    for part in ([("a", 1), ("b", 2), ("a", 3)], [("b", 4), ("c", 5)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.read_stream(spark, source, spark.read.parquet(source).schema)
        jobs.run_available(jobs.append_stream(stream, target, check))
    assert sorted(r.url for r in spark.read.option("basePath", target).parquet(target).collect()) == ["a", "b", "c"]


def test_admission_stream_equals_batch(spark):
    from test_operators import admission_rows

    rows = admission_rows()
    schema = "call_id int, ts timestamp, model string, task_id string, cost double"
    source, out, state_dir, check = (scratch(spark, n) for n in ("in", "out", "state", "check"))
    for a in range(0, 1500, 500):
        spark.createDataFrame(rows[a:a + 500], schema).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.read_stream(spark, source, spark.read.parquet(source).schema)
        jobs.run_available(jobs.admission_stream(stream, out, state_dir, check, {"monthly_budget_usd": 0.8}))
    batch = admission.admit(spark.createDataFrame(rows, schema), {"monthly_budget_usd": 0.8})
    assert {r.call_id: r.decision for r in spark.read.option("basePath", out).parquet(out).collect()} == {r.call_id: r.decision for r in batch.collect()}


def test_backfill(spark):
    target = spark.createDataFrame([(1, "https://acme.com/a", "t", "2024-02-10")], "row_no int, url string, title string, date_published string")
    pages = spark.createDataFrame([("a", 0, "https://n.com/archive", ARCHIVE)], "archive string, page_no int, url string, html string")
    posts = maintain.backfill_posts(pages, target)
    assert "https://n.com/p/one" not in {r.url for r in posts.collect()}
    landed = spark.createDataFrame([(1, "https://n.com/p/two", NEWSLETTER), (2, "https://n.com/p/three", None)], "page_id long, url string, html string")
    extract = lambda p: harvest.harvest_links(p).withColumn("row_no", (100 + F.col("block")).cast("int"))
    result, totals = maintain.backfill(posts, landed, target, extract)
    assert totals.first().asDict() == {"posts": 2, "items": 3, "new_rows": 2, "errors": 1}
    assert {r.url for r in result.collect()} == {"https://acme.com/a", "https://b.com/long-story", "https://ads.com/x"}


def test_monthly_counters_roll_over_and_batches_repeat(spark):
    """Three files, one a batch; a month begins in the middle of one and ends in the next."""

    folder, out, checkpoint = (scratch(spark, n) for n in ("calls", "totals", "checkpoint"))
    files = [
        [("2024-01-30 10:00:00", 0.1), ("2024-01-31 23:59:59", 0.2)],
        [("2024-01-31 23:59:58", 0.3), ("2024-02-01 00:00:00", 0.4)],
        [("2024-02-29 12:00:00", 0.5), ("2024-03-01 00:00:00", 0.6)],
    ]
    schema = "ts timestamp, cost double"
    for rows in files:
        df = spark.createDataFrame(rows, "t string, cost double").select(F.to_timestamp("t").alias("ts"), "cost")
        df.coalesce(1).write.mode("append").parquet(folder)
        jobs.run_available(jobs.monthly_counters(jobs.read_stream(spark, folder, schema, 1), out, checkpoint))
    got = {r.month: (r.calls, float(r.cost)) for r in jobs.latest_totals(spark, out).collect()}
    assert got == {"2024-01": (3, 0.6), "2024-02": (2, 0.9), "2024-03": (1, 0.6)}


def test_video_lines_are_trimmed_and_spoken_once(spark, tmp_path):
    """C14: digits at the ends of a line stay, and of equal neighbours one is spoken, in the SQL too."""
    from newsmill.suite import ORACLES, QUERIES
    from newsmill.suite.check import compare

    text = "0 A title of sixteen words, more or less.\n19.7 is spoken here, but only once.\n 19.7 is spoken here, but only once. \n7\nLast of all stands 33 and 3"
    spark.createDataFrame([(1, text, "en", "a", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for name, schema in (("orders", "o_orderkey long, o_orderstatus string, o_orderdate timestamp"), ("labels", "doc_id long, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    chars = QUERIES["c14_video_items"](spark, str(tmp_path)).first().chars
    spoken = "0 A title of sixteen words, more or less. 19.7 is spoken here, but only once. Last of all stands 33 and 3"
    assert chars == spoken.rindex(".") + 1
    con = duck_of(tmp_path, "documents", "orders", "labels")
    assert compare(spark, con, "c14_video_items", QUERIES["c14_video_items"], ORACLES["c14_video_items"], str(tmp_path))[0]


def duck_of(folder, *tables):
    import duckdb

    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return con


def test_totals_of_days_and_windows_leave_no_call_out(spark, sf):
    """Every call is in a day and in six windows, those of the last day and minute too."""
    from newsmill.suite import QUERIES

    n, last = spark.read.parquet(f"{sf}/events.parquet").agg(F.count("*"), F.date_format(F.max("ts"), "yyyy-MM-dd 00:00:00")).first()
    days = {r.day: r.calls for r in QUERIES["t3_daily_counters"](spark, sf).collect()}
    assert sum(days.values()) == n and last in days
    assert QUERIES["t4_sliding_minute"](spark, sf).agg(F.sum("calls")).first()[0] == 6 * n


def test_article_match_in_rounds(spark, sf):
    """Articles that stop at their first good probe get what all probes at once give them."""
    from newsmill.plans import enrich
    from newsmill.suite.base import news
    from newsmill.suite.dedup_joins import catalogue

    n = news(spark, sf)
    articles = n.select("item_id", F.when(n.item_id % 7 != 0, n.content).alias("article"))
    args = articles, catalogue(spark, sf), ["item_id"], ["than", "that"], True
    rounds, at_once = enrich.article_match(*args), enrich.article_match(*args, at_first=100_000)
    want = sorted(map(tuple, at_once.collect()), key=str)
    assert want and sorted(map(tuple, rounds.collect()), key=str) == want
    assert len({r.probe for r in rounds.collect()}) > 0
