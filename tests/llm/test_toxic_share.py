"""A table with three times the toxic share of its labels."""

from newsmill.llm import toxicity

from .test_operators import words

import random


def test_more_toxic_texts_than_the_labels_say(spark):
    rng = random.Random(12)
    docs, labels = [], []
    for i in range(2400):
        bad = i % 8 in (0, 3, 6)
        w = words(rng, rng.randrange(20, 200)).split()
        for _ in range(4 if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["grumblo", "snarkity", "vexoid"]))
        docs.append((i, " ".join(w)))
        if i % 8 in (2, 4) or bad and i % 11 == 0:
            labels.append((i, int(bad)))
    assert sum(y for _, y in labels) / len(labels) < 0.13  # of the documents: 0.375
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.train(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = [r for r in toxicity.score_documents(df, model).collect() if r.held_out]
    bad = [r.predicted for r in out if r.doc_id % 8 in (0, 3, 6)]
    good = [r.predicted for r in out if r.doc_id % 8 not in (0, 3, 6)]
    assert sum(bad) >= 0.95 * len(bad) and sum(good) <= 0.02 * len(good)
