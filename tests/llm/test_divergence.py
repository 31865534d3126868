"""op13 against plain integer arithmetic."""

import re
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from newsmill.llm import divergence
from newsmill.session import durable

SCHEMA = "doc_id long, text string, lang string, source string, term string, p int, rank int"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least=10, top=10):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        groups.add((lang, source))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = [s for l, s in groups if l == lang]

        def shares(c):
            n = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // n for t in kept}

        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])
        q, p = shares(whole), {s: shares(counts[lang, s]) for s in sources}

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s in sources:
            pair = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            term = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out |= {(lang, s, part, i, -v, k) for k, (v, _, i) in enumerate(items, 1)}
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(13)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["été", "\U0001f600", "￮", "Naïve", "A", "a"]
    out = []
    for k in range(400):
        own = words[(k % 7) * 5 : (k % 7) * 5 + 30] + words[-6:]
        text = "".join(rng.choice(own) + rng.choice([" ", "-", "3", "\n", "_"]) for _ in range(rng.randrange(0, 40)))
        out.append((text, rng.choice(["en", "de", None]), f"s{k % 7}" if k % 3 else "hot"))
    out += [(None, "en", "none"), ("", "xx", None), ("!", "xx", "b"), ("word", None, None), (None, None, None)]
    out += [("same words here", "en", "copies")] * 30
    out.append(("long " * 200_000 + "words", "de", "s1"))
    return out


@pytest.mark.parametrize("tile,bucket", [(128, 4096), (2, 3)])
def test_against_plain(spark, rows, tile, bucket):
    df = spark.createDataFrame([(None, *r, "x", 1, 2) for r in rows], SCHEMA)
    if tile == 128:
        got = divergence.source_audit(df)
    else:
        docs = df.select("text", "lang", "source").na.fill("")
        counts = durable(divergence.term_counts(docs), "terms")
        totals = divergence.group_totals(docs, counts)
        columns = ["lang", "source", "part", "item", "value", "rank"]
        got = divergence.source_distances(counts, totals, tile, bucket).withColumn("part", F.lit("pair")).select(*columns).unionByName(
            divergence.telling_terms(counts, totals).withColumn("part", F.lit("term")).select(*columns)
        )
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found))
    assert set(found) == plain(rows)


def test_empty(spark):
    assert divergence.source_audit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_counts_beyond_64_bits(spark):
    """10^9 times a count leaves 64 bits at ten thousand million."""
    counts = spark.createDataFrame(
        [("en", "a", "x", 10**13, 10**13 + 7), ("en", "b", "x", 7, 10**13 + 7), ("en", "b", "y", 3, 3)],
        "lang string, source string, term string, count long, lang_count long",
    )
    docs = spark.createDataFrame([("", "en", "a"), ("", "en", "b")], "text string, lang string, source string")
    totals = divergence.group_totals(docs, counts)
    n = [10**13, 10]
    p = [{t: 1 + 10**9 * (c + 2) // (n[k] + 4) for t, c in cs.items()} for k, cs in enumerate([{"x": 10**13, "y": 0}, {"x": 7, "y": 3}])]
    want = sum((p[0][t] - p[1][t]) ** 2 // (p[0][t] + p[1][t]) for t in "xy")
    assert {r.value for r in divergence.source_distances(counts, totals).collect()} == {want}
