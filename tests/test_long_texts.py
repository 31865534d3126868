"""Texts whose length or make-up once ended an executor or grew the work beyond the input."""

import pytest
from pyspark.sql import functions as F

from newsmill import fixed
from newsmill.functions import markup, patterns, text as tx
from newsmill.operators import entities as en
from newsmill.plans import enrich, market


@pytest.mark.parametrize("ascii_boundary", [True, False])
def test_patterns_without_loops_match_the_same(spark, ascii_boundary):  # F1, F8
    word = patterns.ASCII_WORD if ascii_boundary else patterns.UNICODE_WORD
    texts = ["New York Times", "New York3", "New  York\nCity Hall9 of", "Foo BarBaz Qux", "Foo Barß Baz Qux", "ÉNew York", "A New York",
             "New York_", "New York City_x New Jersey", "OpenAi raises", "AbCDe, a startup", "AbCDEfG9 x", "company FooBARb", "NEW York Times", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for p in [fixed.PHRASE_PATTERN, *fixed.ENTITY_PATTERNS, *fixed.SUBJECT_PATTERNS]:
        for flags in ("", "(?iu)"):
            # Every boundary as a test of both sides.
            plain = flags + p.replace(r"\b", patterns._boundary(word))
            both = df.select(*[F.regexp_extract_all("t", F.lit(x), F.lit(1)) for x in (flags + patterns.bounded(p, ascii_boundary), plain)])
            assert all(r[0] == r[1] for r in both.collect()), (p, flags)


def test_long_runs_of_names(spark):  # F1, F8
    df = spark.createDataFrame([("Alpha " * 50000 + "end",), ("Ab" + "C" * 100000,)], "t string")
    sizes = df.select(F.length(tx.keywords("t", ascii_boundary=True)[0]), F.size(tx.mentioned_entities("t")), F.length(tx.main_subject("t"))).collect()
    assert sizes[0][0] == 50000 * 6 - 1


def test_probes_that_cannot_match_are_left_out(spark, monkeypatch):  # F1
    names = ["New Harbor", "Harbor", "Delta Labs Inc", "Delta Inc", "acme", "Quiet Stone Bridge", "Bitcoin", "Omega Protocol", "Un"]
    catalogue = spark.createDataFrame(
        [(f"e{i}", "entity", n, f"About {n} of Lower Gate Omega", n[:3].upper()) for i, n in enumerate(names)], ", ".join(f"{c} string" for c in en.CATALOGUE)
    )
    filler = " some words that name nothing at all. Vague Terms here. Gate of it. " * 8
    openings = ["harbor lights and New ones", "inc. makes Delta and Labs", "Stone Bridge is Quiet", "Omega, says Lower Gate of Omega", "acme", "A $BTC one",
                "protocol for Omega", "Delta Inc. it is", "unseen Un", "Gate Omega by Lower", "", "labs Delta inc than Omega", "Harbor"]
    articles = spark.createDataFrame([(i, o + filler) for i, o in enumerate(openings)] + [(99, None)], "k int, article string")
    terms = ["than", "omega", "delta"]
    listed = articles.select(
        "k", "article", F.array_distinct(tx.term_hits("article", terms, True)).alias("h"), tx.keywords("article", ascii_boundary=True).alias("o")
    ).collect()
    probes = [(r.k, i, w, 0.7 if i < len(r.h) else 0.8, r.article) for r in listed if r.article for i, w in enumerate(r.h + r.o)]
    probe_table = spark.createDataFrame(probes, "k int, probe int, title string, least double, description string")
    every = en.match_entities(probe_table, catalogue, ["k", "probe"], ascii_boundary=True).collect()
    want = set()
    for k in range(len(openings)):
        for _, i, _, least, _ in (p for p in probes if p[0] == k):
            rows = [r for r in every if (r.k, r.probe) == (k, i)]
            if max((r.score for r in rows), default=0) >= least:
                want |= {(k, i, r.name, r.score, r.keyword) for r in rows}
                break
    sizes = []
    whole = en.match_entities
    monkeypatch.setattr(enrich.en, "match_entities", lambda items, *a, **k: sizes.append(items.count()) or whole(items, *a, **k))
    got = enrich.article_match(articles, catalogue, ["k"], terms, True)
    assert {(r.k, r.probe, r.name, r.score, r.keyword) for r in got.collect()} == want
    assert len({k for k, *_ in want}) > 3 and any(i > 0 for _, i, *_ in want)
    # Articles are read next to few of their probes.
    assert sum(sizes) <= 3 * len(openings) < len(probes)


def test_issue_dates_by_carrier(spark):  # F7
    pages = [
        ("<p>May 1, 2024</p><TIME datetime='2024-01-02'>x</TIME>", "2024-01-02"), ("<time>Jan 3, 2024</time>", "Jan 3, 2024"),
        ("<META name='date' content='2024-01-04'><time></time>", "2024-01-04"), ("<b CLASS='entry-date'>2024-01-05</b>", "2024-01-05"),
        ("<script>2020-01-01</script>on 1/6/2024 or 2024-01-07", "1/6/2024"), ("on 2024-01-07", "2024-01-07"), ("none", None), (None, None),
    ]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(pages)], "i int, h string")
    dated = df.select("i", markup.newsletter_date_text("h").alias("d"))
    assert [r.d for r in dated.orderBy("i").collect()] == [d for _, d in pages]
    # The visible text is read once.
    assert dated._jdf.queryExecution().optimizedPlan().toString().count("script|style") == 1


def test_pages_without_links_have_no_blocks_read(spark):  # F7
    pages = spark.createDataFrame(
        [(1, "u", "<p>no link at all</p>"), (2, "u", '<P><A href="https://a.example.com/x">A headline of some more words</A></P>'),
         (3, "u", '<p><\x01a href="https://a.example.com/y">Another headline of some more words</a></p>'), (4, "u", None)], "page_id int, url string, html string"
    )
    assert pages.where(markup.may_link("html")).count() == 2
    assert {r.page_id for r in market.linked_headlines(pages, {}).collect()} <= {2, 3}
