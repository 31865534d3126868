"""Round 3: steps that went over the same text or rows several times give the same results in one pass."""

import re

import pytest
from pyspark.sql import Row, functions as F

from newsmill import fixed
from newsmill.functions import text as tx
from newsmill.functions.arrays import squeeze
from newsmill.functions.patterns import any_word, bounded
from newsmill.operators import admission, automata
from newsmill.plans import market


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


PAGE = "<html><p>Markets</p><p>Dow up 3% on strong jobs data</p><p>Headline Roundup</p><p>Five quiet words stand together today</p><p>Deal Flow</p></html>"


def test_market_lines_read_a_page_once(spark):  # F19
    pages = spark.createDataFrame([(1, "u", PAGE)], "page_id int, url string, html string")
    lines = market.market_lines(pages, {})
    assert plan_of(lines).count("Generate posexplode") == 1
    got = {(r.section, r.pos, r.title) for r in lines.collect()}
    assert got == {("Markets", 0, "Dow up 3% on strong jobs data"), ("Headline Roundup", 0, "Five quiet words stand together today")}


def test_digest_reads_a_date_once(spark):  # F20
    pages = spark.createDataFrame([(1, "u", PAGE)], "page_id int, url string, html string")
    digest = market.market_digest(pages, {})
    assert plan_of(digest).count("entry-date") == 1
    assert digest.count() == 2


def test_words_and_blanks(spark):  # F19
    texts = ["", "a", " a b c\td  e ", "a b c d", "　a \n b  c d e f", "x  y", "p\x1cq"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", squeeze("t").alias("s"), tx.has_words("t", 5).alias("five"), F.size(tx.words("t")).alias("n")).collect():
        assert r.s == " ".join(r.t.split())
        assert r.five == (r.n >= 5)


def test_patterns_with_a_look_ahead(spark):  # F21, F24
    text = "aBc Abcd xAbc New York Abc-Def (ABC) iPhone éAbc ABcD Thé ſun SUN"
    df = spark.createDataFrame([(text,)], "t string")
    word = r"(?<![A-Za-z0-9_])"
    for p in (fixed.PHRASE_PATTERN, fixed.LEADING_WORD_PATTERN, fixed.TICKER_PATTERN):
        assert bounded(p, True).startswith("(?=[A-Z])")
        got = df.select(F.regexp_extract_all("t", F.lit(bounded(p, True)), F.lit(1))).first()[0]
        assert got == re.findall(p, text, re.ASCII)
    mixed = df.select(F.regexp_extract_all("t", F.lit(tx._MIXED_AHEAD + bounded(fixed.MIXED_CASE_PATTERN, True)), F.lit(1))).first()[0]
    assert mixed == re.findall(fixed.MIXED_CASE_PATTERN, text, re.ASCII)
    assert any_word(["sun", "abc"], True).startswith("(?iu)(?=[as])" + word)
    hits = df.select(F.regexp_extract_all("t", F.lit(any_word(["sun", "abc"], True)), F.lit(1))).first()[0]
    assert hits == ["aBc", "Abc", "ABC", "Abc", "ſun", "SUN"]


def test_chart_topics_behind_their_letters(spark):  # F25
    assert tx._literals(r"\bbull(ish)? flag\b") == [" flag", "bull"]
    texts = ["a Chart of\nanalysis", "chart and analysis", "bullish flag", "bull flags", "rſi x divergence", "FİBONACCı",
             "university divergence", "risK to reward", "RISK-TO-REWARD", "", "buy now", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    pattern = "(?iu)" + "|".join(bounded(p, True) for p in fixed.CHART_TOPIC_PATTERNS)
    keyword = F.exists(F.array(*map(F.lit, fixed.CHART_TOPIC_KEYWORDS)), lambda k: F.contains(F.lower("t"), k))
    rows = df.select(tx.is_chart_topic("t", True).alias("got"), (F.col("t").rlike(pattern) | keyword).alias("want")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


@pytest.mark.parametrize("ascii_boundary", [True, False])
def test_counts_stop_at_whole_words_only(ascii_boundary):  # F26
    strings = ["a", "an", "a b a", "$x", "x$", "é", "b", "\x00a", "a\x00", "new york new"]
    texts = ["banana a an", "a b a b a", "a$x$a", "éa é a", "\x00a b", "a\x00b a", "", "new york new york new"]
    rows = [Row(_string=s) for s in strings]
    scan = automata._counts(rows, ascii_boundary)()
    for t in texts:
        want = {}
        for s in strings:
            at = 0
            while (at := t.find(s, at)) >= 0:
                if automata._bounded(t, at, at + len(s), ascii_boundary):
                    want[s] = want.get(s, 0) + 1
                    at += len(s)
                else:
                    at += 1
        assert {h["string"]: h["n"] for h in scan(t)} == want, t
    assert automata._edged("banana a", re.compile(r"\b")) == "\x00banana\x00 \x00a\x00"


def test_the_last_round_of_a_piece_counts(spark):  # F22, F27
    first = spark.createDataFrame([(1, "t", "d1", "x"), (2, "t", "d2", "x")], "call_id int, tenant string, day string, decision string")
    again = spark.createDataFrame([(2, "t", "d2", "y")], first.schema)
    outcomes = spark.createDataFrame([("t", "d1", 0), ("t", "d2", 1)], "tenant string, day string, _round int")
    got = admission._last_round([first, again], outcomes).collect()
    assert sorted((r.call_id, r.decision) for r in got) == [(1, "x"), (2, "y")]
