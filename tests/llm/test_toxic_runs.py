"""Toxic terms anywhere in unbroken text."""

import random

import pytest

from newsmill.llm import toxicity


@pytest.mark.parametrize("letters, term", [("abcdefghijklmnopqrstuvwxyz", "grumblo"), ([chr(0x4E00 + i) for i in range(500)], "毒舌鬼")])
def test_term_late_in_a_long_run(spark, letters, term):
    rng = random.Random(4)
    docs = []
    for i in range(1200):
        run = "".join(rng.choice(letters) for _ in range(60))
        docs.append((i, run[:40] + term + run[40:] if i % 6 == 0 else run))
    labels = [(i, int(i % 6 == 0)) for i in range(0, 1200, 2)] + [(i, 0) for i in range(1, 1200, 4)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.train(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = [r for r in toxicity.score_documents(df, model).collect() if r.held_out]
    assert sum(r.predicted == int(r.doc_id % 6 == 0) for r in out) / len(out) > 0.95
