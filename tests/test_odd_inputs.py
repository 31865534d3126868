"""Queries next to their SQL over tables with odd rows."""

import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

from newsmill.functions import dates
from newsmill.functions.arrays import squeeze, squeeze_ascii
from newsmill.operators import load
from newsmill.session import scratch
from newsmill.suite import ORACLES, QUERIES
from newsmill.suite.check import TABLES, compare, duck

TEXTS = [
    None, "", "  ", "\n", "\nsecond line", " \n x", "a b", "a b", " ab ", "ab", "\x0bab\x0b", "\x1cab\x1c", "a\x85b",
    "　ab 　", "İstanbul", "istanbul", "i̇stanbul", "ΑΣ", "ας", "ασ", "back\\slash, end\\", "back\\", "\\",
    '\\"quoted\\"', '" quoted "', '""', '"', "#hash, start", "a,b", "cr\rhere", "x\r\ny", "nul\x00here", "null", "...", "abcdefghijkl...", "\x01ctrl\x02",
]


@pytest.fixture(scope="module")
def odd(sf, tmp_path_factory):
    """The smallest tables, with odd texts, repeated and missing URLs, and ages of thousands of years."""
    path = tmp_path_factory.mktemp("odd")
    con = duckdb.connect()
    for t in TABLES:
        shutil.copyfile(f"{sf}/{t}.parquet", path / f"{t}.parquet")
    con.execute("CREATE TABLE o (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    kinds = [(t, lang) for t in TEXTS for lang in ("en", "de", None, "")]
    con.executemany("INSERT INTO o VALUES (?, ?, ?, ?)", [(100000 + i, t, lang, "web" if i % 7 else None if i % 2 else "") for i, (t, lang) in enumerate(kinds)])
    odd_rows = {
        "documents": f"SELECT doc_id, text, lang, source, n_chars FROM '{sf}/documents.parquet' UNION ALL SELECT *, length(text) FROM o",
        "pages": f"SELECT * FROM '{sf}/pages.parquet' UNION ALL SELECT page_id + 100000, url, html FROM '{sf}/pages.parquet' UNION ALL SELECT 200000, NULL, 'x'",
        "events": f"SELECT * FROM '{sf}/events.parquet' UNION ALL SELECT * REPLACE (event_id + 1000000 AS event_id, user_id + 1000 * (event_id % 90) AS user_id) FROM '{sf}/events.parquet'",
    }
    for t, sql in odd_rows.items():
        con.execute(f"COPY ({sql}) TO '{path / t}.parquet' (FORMAT parquet)")
    return str(path)


def check(spark, odd, name):
    ok, text = compare(spark, duck(odd), name, QUERIES[name], ORACLES[name], odd)
    assert ok, text


# F3
def test_first_texts(spark, odd):
    check(spark, odd, "w1_keep_first_text")


def test_ascii_blanks(spark):
    df = spark.createDataFrame([("a  b",), ("  a \t\r\n b ",), ("a\x0b b",)], "t string")
    assert [r[0] for r in df.select(squeeze_ascii("t")).collect()] == ["a  b", "a b", "a\x0b b"]
    assert [r[0] for r in df.select(squeeze("t")).collect()] == ["a b"] * 3


# F2
def test_untitled_posts(spark, odd):
    check(spark, odd, "c13_retitle")


# F5
def test_cells_come_back(spark, odd):
    check(spark, odd, "s10_csv_sink")


def test_empty_and_missing_cells(spark):
    path = scratch(spark, "csv")
    titles = ["", None, ' "a" ', "b\\", "c\\, d"]
    load.write_csv(spark.createDataFrame([(t, str(i)) for i, t in enumerate(titles)], "title string, url string"), path)
    back = {r.url: r for r in load.read_csv(spark, path).collect()}
    assert [back[str(i)].title for i in range(len(titles))] == titles
    assert back["0"].category is None


# F4
def test_shared_urls(spark, odd):
    check(spark, odd, "s1_source_registry")


# F6
def test_ages_of_thousands_of_years(spark, odd):
    check(spark, odd, "f14_relative_date")


def test_long_ages(spark):
    ages = ["2000000 hours ago", "3000000 months ago", "99999999999999999999 days ago", "3 hours ago"]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(ages)], "i int, t string").withColumn(
        "p", dates.relative_date("t", F.to_timestamp(F.lit("2024-03-10 12:00:00")))
    )
    rows = df.orderBy("i").select(F.date_format("p", "yyyy-MM-dd HH"), F.col("p").isNull()).collect()
    assert [rows[0][0], rows[3][0]] == ["1796-01-12 04", "2024-03-10 09"]
    assert [r[1] for r in rows] == [False, False, True, False]
