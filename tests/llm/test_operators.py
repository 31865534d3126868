"""The llm operators against plain loops, and the corner cases that their docstrings state."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from newsmill.llm import (
    block_names, decontaminate, mixing, quote_links, simhash, site_spread, suffix_repeats,
    token_counts, toxicity, window_repeats,
)
from newsmill.llm.common import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, _id string, name int"


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls, empty and long texts, repeated rows, shared passages; columns with the names that
    operators use inside."""
    rng = random.Random(7)
    passage = words(rng, 60)
    long = words(rng, 9000)
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "One"), (4, "One"), (None, "one"), (None, None),
        (5, long), (6, long + " tail"), (7, long.upper()), (8, passage), (9, words(rng, 50) + " " + passage),
        (10, passage + "\n" + passage), (11, "é" * 500), (12, "ÉÉ é " * 120), (13, "a" * 700), (14, "ab" * 300),
        (15, words(rng, 80) + "\n" + passage + " " + words(rng, 30)),
    ]
    rows += [(20 + i, words(rng, 120)) for i in range(10)]
    rows += [(40 + i, "same text in many rows " * 12) for i in range(30)]
    return spark.createDataFrame(
        [(d, t, "en" if (d or 0) % 2 else None, f"s{(d or 0) % 3}", "x", 1) for d, t in rows], SCHEMA
    )


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


# --- exact duplicates ------------------------------------------------------------------------

@pytest.mark.parametrize("block", [7, 4096])
@pytest.mark.parametrize("weak", [False, True])
def test_block_names(hard, block, weak):
    """A digest with many collisions must not change the result."""
    digest = (lambda b: F.octet_length(b).cast("long")) if weak else F.xxhash64
    out = block_names.exact_duplicates(hard, block_bytes=block, digest=digest).collect()
    groups = {}
    for d, t in pairs(hard):
        groups.setdefault(lowered(t), []).append(d)
    want = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        kept_left = 1
        for d in ids:
            kept = d == keep and kept_left == 1
            kept_left -= kept
            want[d, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in out) == want
    names = {}
    for r in out:
        names.setdefault((r.level, r.name), set()).add(r.text_sha256)
    assert all(len(v) == 1 for v in names.values()) and len(names) == len(groups)


# --- SimHash ---------------------------------------------------------------------------------

def plain_fingerprint(text, n=4):
    import xxhash

    w = WORD.findall(lowered(text))
    shingles = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_groups(prints, radius=4):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_simhash(hard):
    rows = pairs(hard)
    prints = [plain_fingerprint(t) for _, t in rows]
    roots = plain_groups(prints)
    least = {}
    for (d, _), r in zip(rows, roots):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    want = Counter((d, f"{p:016x}", least.get(r)) for (d, _), p, r in zip(rows, prints, roots))
    got = simhash.near_duplicates(hard).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


@pytest.mark.parametrize("size", [3, 2048])
def test_bk_trees_of_large_and_split_shards(spark, size):
    """Clusters a few bits wide, chains included, in trees of any size."""
    rng = random.Random(3)
    values = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(25):
            values.add(x)
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                x ^= 1 << b
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long"), tree_size=size)
    known = {r.node: r.root for r in components(links).collect()}
    roots = plain_groups(values)
    mine = [known.get(s, s) for s in signed]
    assert len(set(zip(roots, mine))) == len(set(roots)) == len(set(mine))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 150), (150, 300)]
    out = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(out[i] == 0 for i in range(41))
    assert (out[100], out[101], out[300], out[200]) == (100, 100, 150, 150)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_groups_over_seeds(hard):
    out = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(hard).collect()}
    assert out[6] == out[7] == out[5] == 5 and not out.keys() & {None, *range(20, 30)}
    assert {out[40 + i] for i in range(30)} == {40}


# --- repeats ---------------------------------------------------------------------------------

def plain_cut(units, window):
    count = Counter(tuple(u[i : i + window]) for u in units for i in range(len(u) - window + 1))
    for u in units:
        gone = [False] * len(u)
        for i in range(len(u) - window + 1):
            if count[tuple(u[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        yield gone


@pytest.mark.parametrize("size", [2, 4096])
def test_suffix_repeats(hard, size):
    rows = pairs(hard)
    data = [(t or "").encode() for _, t in rows]
    want = Counter()
    for (d, _), b, gone in zip(rows, data, plain_cut(data, 200)):
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        want[d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept] += 1
    got = suffix_repeats.remove_repeats(hard, class_size=size).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got) == want


@pytest.mark.parametrize("first", [9, 15])
def test_window_doubling(hard, first):
    rows = pairs(hard)
    tokens = [WORD.findall(t or "") for _, t in rows]
    want = Counter()
    for (d, _), w, gone in zip(rows, tokens, plain_cut(tokens, 35)):
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want[d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept] += 1
    got = window_repeats.remove_windows(hard, first=first).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in got) == want


def test_long_text_in_stretches(monkeypatch):
    import numpy as np
    from newsmill.llm import winnow

    rng = np.random.default_rng(1)
    codes = rng.integers(0, 50, 30_000).astype(np.uint64)
    whole = next(winnow.find_anchors(codes, np.array([0, len(codes)]), 40, 10)).pos
    monkeypatch.setattr(winnow, "STRETCH", 1000)
    parts = np.concatenate([a.pos for a in winnow.find_anchors(codes, np.array([0, len(codes)]), 40, 10)])
    assert (parts == whole).all()


# --- token counts ----------------------------------------------------------------------------

def test_token_counts(hard):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    more = [
        (100, "it's  we'll'\n\n <|endoftext|> x<|endof"), (101, "1234 ... ½ 中文 ​\x1c\x85  ab \t"),
        (102, "''s 'S 're"), (103, "word " * 300),
    ]
    df = hard.sparkSession.createDataFrame(pairs(hard) + more, "doc_id long, text string")
    out = token_counts.token_counts(df, path("byte_bpe_50k.json"), prefixes=True).collect()
    encode = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    want = Counter((d, len((t or "").encode()), encode(t or "")) for d, t in pairs(df))
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in out) == want
    assert all(r.over_limit == (r.n_tokens > 512) and r.prefix_tokens[-1] == r.n_tokens for r in out)
    for d, t in more:
        row = next(r for r in out if r.doc_id == d)
        assert row.prefix_tokens == [encode(t[:i]) for i in range(len(t) + 1)]


def test_prefix_questions(spark):
    from public_tokenizers import path

    df = spark.createDataFrame([(1, "some plain words"), (2, "")], "doc_id long, text string")
    counts = token_counts.token_counts(df, path("byte_bpe_50k.json"), prefixes=True)
    out = {r.doc_id: r for r in token_counts.fits(token_counts.tokens_up_to(counts, 4), 2).collect()}
    assert out[1].tokens == 1 and out[1].chars == len("some plain")
    assert out[2].tokens == 0 and out[2].chars == 0


# --- lines -----------------------------------------------------------------------------------

def test_site_spread(spark):
    line, rare = "Subscribe to our letter", "Told once"
    rows = [(i, f"own {i}\n {line.upper() if i % 2 else line}\t\n{rare if i < 3 else ''}", f"site{i}") for i in range(12)]
    rows += [(50, f"{line}\n{line}", None), (51, None, "site1"), (52, "", "site2"), (None, line, "site3")]
    rows += [(60, "a\nb", "site1")] * 20  # often, but on one site
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for sites in (5, 12, 13):
        out = Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in site_spread.remove_boilerplate(df, min_sites=sites).collect())
        want = Counter()
        for d, t, _ in rows:
            lines = [] if t is None else t.split("\n")
            kept = [x for x in lines if not (sites <= 12 and x.strip(" \t").lower() == line.lower())]
            want[d, None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
        assert out == want, sites


def test_site_spread_keeps_columns(hard):
    out = site_spread.remove_boilerplate(hard, min_sites=3)
    assert out.columns == [*hard.columns, "n_lines", "n_removed"]
    assert out.count() == hard.count() and {r._id for r in out.collect()} == {"x"}


def test_spread_is_exact_near_the_threshold(spark):
    """Lines on 190 to 210 of many sites: the sketch alone would err."""
    rows = [(n, 0, f"s{i}") for n in range(190, 211) for i in range(n)]
    lines = spark.createDataFrame(rows, "h1 long, h2 long, site string")
    out = site_spread.spread_of_lines(lines, 200).collect()
    assert {r.h1 for r in out} == set(range(200, 211))
    assert all(r.exact and r.sites == r.h1 for r in out if r.h1 < 205)


# --- toxicity --------------------------------------------------------------------------------

def toxic_table(spark, n=1500):
    rng = random.Random(11)
    docs, labels = [], []
    for i in range(n):
        bad = i % 8 == 0
        w = words(rng, rng.randrange(5, 200)).split()
        for _ in range(4 if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["grumblo", "Snarkity", "vexoid"]))
        docs.append((i, " ".join(w)))
        if i % 2 == 0:
            labels.append((i, int(bad)))
    docs += [(n, None), (n + 1, ""), (n + 2, "..."), (None, "vexoid vexoid")]
    return (
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int"),
    )


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_table(spark)
    out = toxicity.score_documents(docs, toxicity.train(docs, labels)).collect()
    judged = [(r.predicted, int(r.doc_id % 8 == 0)) for r in out if r.held_out and r.doc_id is not None and r.doc_id < 1500]
    assert len(judged) > 200 and sum(p == t for p, t in judged) / len(judged) > 0.97
    rest = {r.doc_id: r for r in out if r.doc_id is None or r.doc_id >= 1500}
    assert rest[1500].score == rest[1501].score == rest[1502].score < 0.5 and rest[None].predicted == 1
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)


def test_toxicity_without_confirmed_texts(spark, empty):
    docs, labels = toxic_table(spark, 40)
    model = toxicity.train(docs, labels.where("toxic = 0"))
    assert {r.predicted for r in toxicity.score_documents(docs, model).collect()} == {0}
    model = toxicity.train(empty, empty.select("doc_id", F.lit(1).alias("toxic")))
    assert toxicity.score_documents(empty, model).count() == 0


def test_risk_does_not_turn_negative():
    import numpy as np

    rng = np.random.default_rng(2)
    positive = np.arange(400) < 100
    rows = np.repeat(np.arange(400), 5)
    places = rng.integers(0, 2000, 2000)  # every row can be told by heart
    w, b = toxicity.fit_nnpu(rows, places, positive, 2000, 0.2)
    g = b + np.bincount(rows, w[places], minlength=400)
    assert (g[~positive] >= 0).mean() <= 0.2 * toxicity.SLACK + 0.01


# --- decontamination -------------------------------------------------------------------------

def edited(text, share, rng):
    b = list(text)
    for _ in range(int(len(b) * share)):
        at, how = rng.randrange(len(b)), rng.randrange(3)
        if how == 0:
            b[at] = rng.choice("qxz")
        elif how == 1:
            del b[at]
        else:
            b.insert(at, rng.choice("qxz"))
    return "".join(b)


def plain_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p):
        new = [i + 1]
        for j, b in enumerate(t):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_edit_distance():
    rng = random.Random(5)
    for _ in range(200):
        p = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 80)))
        t = bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 120)))
        assert decontaminate.edit_distance_within(p, t)[0] == plain_distance(p, t)


def test_decontamination(spark):
    rng = random.Random(9)
    items = [(i, words(rng, 40, 5000)) for i in range(30)] + [(98, "tiny"), (99, None), (None, "x"), (97, "")]
    docs, truth = [], set()
    for i, t in items[:30]:
        for k, share in enumerate((0, 0.03, 0.06)):
            docs.append((i * 10 + k, f"{words(rng, 50, 5000)} {edited(t.upper(), share, rng)}\n {words(rng, 20, 5000)}"))
            truth.add((i * 10 + k, i))
    docs += [(1000 + i, words(rng, 120, 5000)) for i in range(50)] + [(2000, None), (2001, ""), (2002, "a tiny one")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (4 << 20, 2000):  # the benchmark in one block and in many
        out = decontaminate.contaminated(df, bench, block_bytes=block).collect()
        got = {(r.doc_id, r.item_id) for r in out}
        assert got - truth == {(2002, 98)} and len(truth & got) >= 0.95 * len(truth)
        assert all(r.edits <= 0.1 * 400 and r.end > r.start for r in out)
    clean = {r.doc_id for r in decontaminate.clean_documents(df, bench).collect()}
    assert {1000 + i for i in range(50)} | {2000, 2001} <= clean and not clean & {d for d, _ in got}
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0


# --- mixing ----------------------------------------------------------------------------------

def test_fill_gives_shortages_to_siblings(spark):
    rows = [("a", 10, 1.0, 100), ("b", 1000, 1.0, 100), ("c", 1000, 2.0, 100), ("d", 50, 0.0, 100)]
    nodes = spark.createDataFrame([("r", *r) for r in rows], "p string, name string, capacity long, weight double, budget long")
    assert {r.name: r.grant for r in mixing.fill(nodes, ["p"], "name").collect()} == {"a": 10, "b": 30, "c": 60, "d": 0}


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, rng.randrange(1, 60)), rng.choice(["en", "de", None]), f"s{0 if rng.random() < .4 else rng.randrange(6)}") for i in range(600)]
    rows += [(700, None, "en", "s0"), (701, " ", "en", "s0"), (None, "three more words", "en", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    out = mixing.mix(df, levels, {"lang": {"en": 3, "de": 1}}, budget=12_000, epochs=2).collect()
    sizes = {d: len(WORD.findall(t or "")) for d, t, *_ in rows}
    assert 12_000 - 40 <= sum(r.taken for r in out) <= 12_000
    assert all(0 < r.taken <= r.n_tokens == sizes[r.doc_id] and r.epoch in (0, 1) for r in out)
    assert len({(r.doc_id, r.epoch) for r in out}) == len(out)
    cut = Counter((r.lang, r.source, r.epoch) for r in out if r.taken < r.n_tokens)
    assert all(n == 1 for n in cut.values())  # one document at the end of a leaf's prefix
    assert mixing.mix(df, levels, {}, budget=0).count() == 0
    assert mixing.mix(df.limit(0), levels, {}).count() == 0


# --- quotes ----------------------------------------------------------------------------------

def test_quote_links(spark):
    rows = [
        (1, 0, "user", "How does it work?\n\nTell me."),
        (1, 1, "bot", "> how  does it WORK?\nLike this."),
        (1, 2, "user", ">> How does it work?\n> Like this.\n\nThanks."),
        (1, 3, "bot", "> Never said\nOdd."),
        (1, 4, "user", "> Thanks.\n> \n> Tell me.\nNo own?"),
        (2, 0, "user", "> How does it work?\nOther conversation."),
        (2, 1, "bot", None), (None, 0, "user", "> Odd.\nLost"), (3, None, "bot", "No turn"), (4, 1, "user", "x"), (4, 1, "user", "x"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = quote_links.reply_order(df).collect()
    got = {(r.conv_id, r.turn): (r.text, r.n_quotes, r.deepest, r.parent_turn, r.root_turn, r.depth) for r in out}
    assert len(out) == len(rows)
    assert got[1, 0] == ("How does it work?\n\nTell me.", 0, 0, None, 0, 0)
    assert got[1, 1] == ("Like this.", 1, 1, 0, 0, 1)
    assert got[1, 2] == ("Thanks.", 2, 2, 1, 0, 2)
    assert got[1, 3] == ("Odd.", 1, 1, None, 3, 0)
    assert got[1, 4] == ("No own?", 2, 1, 2, 0, 3)
    assert got[2, 0] == ("Other conversation.", 1, 1, None, 0, 0)
    assert got[2, 1] == ("", 0, 0, None, 1, 0)
    assert got[None, 0][0] == "Lost" and got[3, None][3:] == (None, None, 0)


def test_long_chain(spark):
    rows = [(1, i, "u", f"message {i}") for i in range(70)]
    mail = quote_links.with_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = {r.turn: r for r in quote_links.reply_order(mail).collect()}
    assert all(out[i].depth == i and out[i].root_turn == 0 and out[i].text == f"message {i}" for i in range(70))


# --- all -------------------------------------------------------------------------------------

def test_empty_tables(empty):
    from public_tokenizers import path

    assert block_names.exact_duplicates(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.near_duplicate_groups(empty).count() == 0
    assert suffix_repeats.remove_repeats(empty).count() == 0
    assert window_repeats.remove_windows(empty).count() == 0
    assert token_counts.token_counts(empty, path("byte_bpe_50k.json")).count() == 0
    assert site_spread.remove_boilerplate(empty).count() == 0
    assert decontaminate.contaminated(empty, empty.select(F.col("doc_id").alias("item_id"), "text")).count() == 0
    mail = empty.select(F.col("doc_id").alias("conv_id"), F.col("doc_id").alias("turn"), F.col("lang").alias("role"), "text")
    assert quote_links.reply_order(mail).count() == 0
