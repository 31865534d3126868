"""op1 against the edit distance of every item to every text, and its hard inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsmill.llm import decontaminate
from newsmill.llm.decontaminate import Benchmark, Walks, edit_distance_within, normalised, tables_for
from newsmill.llm.common import table

SMALL = "/root/testdata/sf0.001"


def fold(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return normalised(data, np.array([0, len(data)]))[0].tobytes()


def benchmark(texts, share=0.1):
    return Benchmark(list(enumerate(texts)), share, Walks(tables_for(0.99, 0.35, 3), 3, 4, 42))


def found(bench, texts):
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    return {(r, i): e for r, i, _, _, e in bench.search(np.frombuffer(b"".join(texts), np.uint8), offsets)}


def damaged(item, share, kind, rng):
    """``item`` with share of its length in edits: evenly spaced or anywhere."""
    edits, out = int(len(item) * share), bytearray(item)
    places = [int((i + 0.5) * len(item) / edits) for i in range(edits)]
    if kind == "random":
        places = sorted(rng.sample(range(len(item)), edits))
    for p in reversed(places):
        how = 0 if kind == "replaced" else rng.randrange(3)
        if how == 0:
            out[p] = 35
        elif how == 1:
            del out[p]
        else:
            out.insert(p, 35)
    return bytes(out)


def prose(rng, size):
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    out = ""
    while len(out) < size:
        out += rng.choice(vocabulary) + " "
    return out[:size].strip().encode()


@pytest.mark.parametrize("kind", ["replaced", "even", "random"])
def test_recall_at_ten_percent(kind):
    rng = random.Random(kind)
    items = [prose(rng, n) for n in range(10, 401, 2)]
    bench = benchmark(items)
    for share in (0.05, 0.08, 0.1):
        texts = [prose(rng, 70) + b" " + damaged(t, share, kind, rng) + b" " + prose(rng, 70) for t in items]
        got = found(bench, texts)
        assert sum((i, i) in got for i in range(len(items))) >= 0.98 * len(items)
        assert all(e == edit_distance_within(items[i], texts[r])[0] for (r, i), e in got.items())


def test_places_miss_nothing():
    """Wherever the plain distance is within the room, a candidate stands at the passage."""
    rng = random.Random(3)
    items = [bytes(rng.choice(b"abc") for _ in range(n)) for n in (1, 2, 3, 5, 9, 10, 11, 19, 20, 21, 33, 60) for _ in (1, 2)]
    texts = [b""] + [bytes(rng.choice(b"abc") for _ in range(40)) + damaged(t, 0.1, "random", rng) for t in items for _ in range(5)]
    bench = benchmark(items)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    data = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
    places = {(int(r), int(i)) for batch in bench.candidates(data, offsets) for r, i in zip(batch[0], batch[1])}
    for r, text in enumerate(texts):
        for i, item in enumerate(items):
            if edit_distance_within(item, text)[0] <= int(len(item) * 0.1):
                assert (r, i) in places, (item, text)


def test_short_items():
    bench = benchmark([b"short item x", b"abcdefghijklmnopqrs", b"#"])
    got = found(bench, [b"a short itam x", b"zz abcdefghijKlmnopqrs", b"no", b"", b"#"])
    assert got == {(0, 0): 1, (1, 1): 1, (4, 2): 0}


def test_shared_run_in_many_items(monkeypatch):
    """Items that all hold one run, and a text full of it: bounded batches, same result."""
    rng = random.Random(4)
    run = b"the same twenty letters all over "
    items = [prose(rng, 60) + b" " + run + prose(rng, 60) for _ in range(200)]
    bench = benchmark(items)
    texts = [run * 300, run * 20 + items[7] + run * 20]
    whole = found(bench, texts)
    assert set(whole) == {(1, 7)}
    monkeypatch.setattr(decontaminate, "PAIRS", 100)
    monkeypatch.setattr(decontaminate, "CELLS", 1000)
    assert found(bench, texts) == whole


def test_given_documents(spark):
    """All pairs of the smallest tables by plain edit distance."""
    docs, items = table(spark, SMALL, "documents"), table(spark, SMALL, "benchmark")
    texts = [(r.doc_id, fold(r.text or "")) for r in docs.collect()]
    want = set()
    for item, text in [(r.item_id, fold(r.text).strip()) for r in items.collect()]:
        want |= {(d, item) for d, t in texts if edit_distance_within(text, t)[0] <= int(len(text) * 0.1)}
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    assert got <= want and len(got) >= 0.99 * len(want) > 0


def test_hard_rows(spark):
    """Repeated rows and items, nulls, a very long text, columns of the result's names, many blocks."""
    rng = random.Random(6)
    item = prose(rng, 150).decode()
    filler = prose(rng, 300_000).decode()
    docs = [(1, f"x {item} y", 0)] * 3 + [(2, f"{filler} {item.upper()} {filler}", 0), (3, None, 0), (4, "", 0), (None, item, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id int").withColumn("edits", F.lit("e"))
    bench = spark.createDataFrame(
        [(5, item), (5, item), (6, None), (None, item), (7, "")], "item_id long, text string"
    ).withColumn("doc_id", F.lit(0))
    for block in (4 << 20, 100):
        out = decontaminate.contaminated(df, bench, block_bytes=block).collect()
        assert sorted((r.doc_id or 0, r.item_id, r.edits) for r in out) == [(0, 5, 0)] * 2 + [(1, 5, 0)] * 6 + [(2, 5, 0)] * 2
        kept = decontaminate.clean_documents(df, bench, block_bytes=block)
        assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4]
    with pytest.raises(ValueError):
        decontaminate.contaminated(df, bench, share=0.5)
