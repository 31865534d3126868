"""Strings in texts over several shards, against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from newsmill.functions import text as tx
from newsmill.operators import automata, joins


@pytest.fixture
def small_shards(monkeypatch):
    monkeypatch.setattr(automata, "SHARD_CHARS", 60)


def sample(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé_ -") for _ in range(rng.randint(1, 4)))
    strings = sorted({word() for _ in range(120)} - {""})
    texts = ["".join(rng.choice("abé_ -Ab") for _ in range(rng.randint(0, 60))) for _ in range(80)] + ["", None]
    return strings, texts


@pytest.mark.parametrize("ascii_boundary", [False, True])
def test_strings_and_counts(spark, small_shards, ascii_boundary):
    strings, texts = sample()
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(3)
    table = spark.createDataFrame([(s,) for s in strings] + [("",), (None,)], "s string")
    edge = r"(?:(?<=W)(?!W)|(?<!W)(?=W))".replace("W", "[A-Za-z0-9_]" if ascii_boundary else r"\w")
    for r in automata.strings_in(df, F.col("t"), table, "s", "found", ascii_boundary).collect():
        want = {(s, bool(re.search(edge + re.escape(s) + edge, r.t))) for s in strings if s in r.t} if r.t is not None else set()
        assert {(x.string, x.word) for x in r.found or []} == want
    for r in automata.string_counts(df, F.col("t"), table, "s", "found", ascii_boundary).collect():
        counts = {s: len(re.findall(edge + re.escape(s) + edge, r.t)) for s in strings} if r.t is not None else {}
        assert {x.string: x.n for x in r.found or []} == {s: n for s, n in counts.items() if n}


def test_first_string_over_shards(spark, small_shards):
    strings, texts = sample(2)
    rng = random.Random(3)
    rows = [(s, rng.choice([None, 1, 2, 3]), f"v{i}") for i, s in enumerate(strings)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    pats = spark.createDataFrame(rows, "pattern string, priority int, name string")
    for r in joins.first_pattern(df, "t", pats, values=["name"]).collect():
        inside = [(p is None, p or 0, s, v) for s, p, v in rows if r.t is not None and s in r.t.lower()]
        assert r.name == (min(inside)[3] if inside else None)


@pytest.mark.parametrize("n", [10, 100_000])
def test_pattern_tables_of_any_size(spark, n):
    pats = spark.range(n).select(
        F.concat(F.lit("Host-"), F.col("id").cast("string"), F.lit(".example/")).alias("pattern"),
        F.col("id").cast("int").alias("priority"), F.col("id").alias("rule"),
    )
    urls = spark.range(2 * n).select("id", F.concat(F.lit("https://host-"), F.col("id").cast("string"), F.lit(".example/a/b")).alias("url"))
    out = joins.first_pattern(urls, "url", pats, values=["rule"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    wrong = out.where("NOT (rule <=> CASE WHEN id < %d THEN id END)" % n)
    assert wrong.count() == 0 and out.count() == 2 * n


def test_terms_of_one_to_twenty_words(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(12)]
    docs = [(d, " ".join(rng.choice(words) for _ in range(300))) for d in range(20)]
    terms = [" ".join(docs[d][1].split()[s : s + k]).upper() for k in range(1, 21) for d, s in [(k % 20, 3 * k)]]
    terms += ["W1 W1", "w1"]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    got = {(r.doc_id, r.term): r.n for r in joins.term_counts(df, spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    want = {(d, t): len(re.findall(rf"\b{t}\b", text, re.I)) for d, text in docs for t in terms}
    assert got == {k: n for k, n in want.items() if n}


def test_keywords_are_linear_and_keep_their_order(spark):
    coded = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(8000)]
    text = ". ".join(f"Defi{c}Swap" for c in coded)
    df = spark.createDataFrame([(text,), ("",), (None,)], "t string")
    rows = df.select(tx.keywords("t").alias("k")).collect()
    low = [w.lower() for w in rows[0].k]
    assert len(low) > 6000 and not rows[1].k
    first = spark.createDataFrame([("Solana solana SOLANA Bonk bonk",)], "t string").select(tx.keywords("t").alias("k")).first().k
    assert len({w.lower() for w in first}) == len(first)
