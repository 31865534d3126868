"""Each stage of the pipeline against a plain version of it, on its own input."""

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as pipeline
from newsmill.llm import decontaminate, toxicity
from newsmill.llm.common import table
from newsmill.llm.queries import mixture
from newsmill.session import durable

from .test_near_copies import kept
from .test_operators import WORD, lowered


@pytest.fixture(scope="module")
def tables(spark):
    """What goes into each stage, and what comes out of the last."""
    sf = "/root/testdata/sf0.001"
    out = [table(spark, sf, "documents")]
    for name, stage in pipeline.STAGES:
        out.append(durable(stage(spark, out[-1], sf), name))
    return sf, out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(tables):
    _, steps = tables
    assert all(s.columns == steps[0].columns for s in steps[:-1])
    assert {"doc_id", "text", "epoch", "taken"} <= set(steps[-1].columns)


def test_toxicity(spark, tables):
    sf, steps = tables
    model = toxicity.train(steps[0], table(spark, sf, "labels"))
    low = {r.doc_id for r in toxicity.score_documents(steps[0], model).collect() if r.score < 0.5}
    assert set(texts(steps[1])) == low


def test_lines(tables):
    _, steps = tables
    sites = defaultdict(set)
    for r in steps[1].collect():
        for line in r.text.split("\n"):
            sites[lowered(line).strip()].add(r.source)
    want = {
        r.doc_id: "\n".join(x for x in r.text.split("\n") if not x.strip() or len(sites[lowered(x).strip()]) < 10)
        for r in steps[1].collect()
    }
    assert texts(steps[2]) == want
    assert all(r.n_chars == len(r.text) for r in steps[2].collect() if r.text != texts(steps[1])[r.doc_id])


def test_near_copies(tables):
    """Against brute-force similarity of the stage's own input."""
    _, steps = tables
    assert sorted(texts(steps[3])) == kept([(r.doc_id, r.text) for r in steps[2].collect()])


def test_contamination(spark, tables):
    sf, steps = tables
    before, after = texts(steps[3]), texts(steps[4])
    fold = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", lowered(t)).strip().encode()
    items = [fold(r.text) for r in table(spark, sf, "benchmark").collect()]
    share = {}
    for d, t in before.items():
        share[d] = min(decontaminate.edit_distance_within(i, fold(t))[0] / len(i) for i in items)
    gone = set(before) - set(after)
    assert {d for d, s in share.items() if s <= 0.05} <= gone <= {d for d, s in share.items() if s <= 0.1}


def test_mixture(tables):
    _, steps = tables
    sizes = {d: len(WORD.findall(t)) for d, t in texts(steps[4]).items()}
    out = steps[5].collect()
    total = sum(r.taken for r in out)
    assert 0.5 * sum(sizes.values()) - 200 <= total <= 0.5 * sum(sizes.values())
    assert all(r.n_tokens == sizes[r.doc_id] and 0 < r.taken <= r.n_tokens for r in out)
    assert len({(r.doc_id, r.epoch) for r in out}) == len(out)


def test_stages_on_empty_tables(spark, tables):
    sf, steps = tables
    none = steps[0].limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0


EXTRA = "doc_id long, text string, lang string, source string, domain string, epoch string, n_tokens string, taken string"


def repeated_rows(spark):
    """A third of the table is one row; columns have the names that the mixture adds."""
    rows = [(i, f"word{i} " * 10, "en", f"s{i % 3}", "a", "b", "c", "d") for i in range(20)]
    rows += [(7, "word7 " * 10, "en", "s1", "a", "b", "c", "d")] * 9
    rows += [(7, "other words of seven", "en", "s1", "a", "b", "c", "d"), (None, "no id", None, None, None, None, None, None)]
    return spark.createDataFrame([*rows, rows[-1]], EXTRA)


def test_repeated_rows_in_near_dedup(spark):
    out = pipeline.drop_near_copies(spark, repeated_rows(spark), "").collect()
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in out if r.doc_id is not None) == sorted(
        [(False, i, f"word{i} " * 10) for i in range(20)] + [(False, 7, "other words of seven")]
    )
    assert [r.text for r in out if r.doc_id is None] == ["no id"]


def test_repeated_rows_in_mixing(spark):
    docs = repeated_rows(spark)
    plain = docs.drop("domain", "epoch", "n_tokens", "taken")
    want = Counter((r.doc_id, r.epoch, r.n_tokens, r.taken) for r in mixture(plain).collect())
    out = pipeline.weigh(spark, docs, "")
    assert Counter((r.doc_id, r.epoch, r.n_tokens, r.taken) for r in out.collect()) == want
    assert len(set(out.columns)) == len(out.columns)
    three = spark.createDataFrame([(1, "ten words " * 5, "en", "s1")] * 3, "doc_id long, text string, lang string, source string")
    rows = pipeline.weigh(spark, three, "").collect()
    assert sum(r.taken for r in rows) == 15 and len(rows) == 2


def test_sample_is_bounded_by_ids(spark, monkeypatch):
    """An id on 400 of 438 rows gives one row of the sample."""
    sizes = []
    durable = toxicity.durable

    def counted(df, name="stage"):
        out = durable(df, name)
        if name == "sample":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(toxicity, "durable", counted)
    rows = [(3, "same words here")] * 400 + [(i, f"text number {i} bad" if i % 2 else f"text number {i} good") for i in range(100, 138)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100, 138)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert sizes and sizes[0] <= 39 + 19
    assert toxicity.score_documents(docs, model).count() == 438
