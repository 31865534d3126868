"""The near-copy stage against brute-force Jaccard similarity of five-word shingles."""

import random

import corpus_pipeline as pipeline

from .test_operators import SCHEMA, WORD, lowered, words


def shingles(text, n=5):
    w = WORD.findall(lowered(text))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def similar(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def kept(rows):
    """The ids that are least in their component of similar pairs, and rows without an id."""
    sets = [shingles(t) for _, t in rows]
    groups = list(range(len(rows)))

    def find(x):
        while groups[x] != x:
            x = groups[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and similar(sets[i], sets[j]):
                a, b = find(i), find(j)
                groups[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(d for i, (d, _) in enumerate(rows) if d is not None and least[find(i)] == d)


def test_near_copies_by_brute_force(spark):
    rng = random.Random(3)
    rows = [(1000, ""), (1001, None), (1002, " \n"), (1003, "One two"), (1004, "one  two"), (None, "one two")]
    for g in range(40):  # similarity 0.6 to 0.95
        base = words(rng, 200, 5000).split()
        rows.append((g * 10, " ".join(base)))
        for c in range(1, 4):
            copy = list(base)
            for at in rng.sample(range(len(copy)), rng.randint(1, 7)):
                copy[at] = f"x{rng.random()}"
            rows.append((g * 10 + c, " ".join(copy)))
    chain = words(rng, 300, 5000).split()  # neighbours are similar, far ones are not
    for c in range(30):
        chain[c * 10] = f"y{c}"
        rows.append((2000 + c, " ".join(chain)))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(d, t, "en", "s", "x", 1) for d, t in rows], SCHEMA)
    out = [r.doc_id for r in pipeline.drop_near_copies(spark, docs, "").collect()]
    assert out.count(None) == 1
    assert sorted(d for d in out if d is not None) == kept(rows)


def test_prints_link_before_buckets(spark):
    """Texts whose SimHashes lie within four bits are linked through the BK-trees, one pair of them
    beside those with equal prints, and only where they are similar enough."""
    from newsmill.llm.near_copies import _print_pairs, near_copies
    from newsmill.llm.simhash import fingerprint

    words = [f"w{i}" for i in range(400)]
    texts = {i: " ".join(words[:i] + ["x"] + words[i + 1 :]) for i in (5, 200, 390)} | {1: "other text of few words here", 2: " ".join(reversed(words))}
    prints = {i: fingerprint(t, 5, 42) for i, t in texts.items()}
    heads = spark.createDataFrame([(i, 9, p) for i, p in prints.items()], "key long, size long, fp long")
    near = {(a, b) for a in texts for b in texts if a < b and bin((prints[a] ^ prints[b]) & (2**64 - 1)).count("1") <= 4}
    got = {tuple(sorted(r)) for r in _print_pairs(heads).collect()}
    assert near and got <= near and {x for p in got for x in p} == {x for p in near for x in p}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_copies(df).collect()} == {5: 5, 200: 5, 390: 5}
