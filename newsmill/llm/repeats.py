"""What the two finders of repeated stretches share: anchors and how far they repeat.

Counting grams at the anchors finds the places where a repeated window can be; all other
text is settled there and then.  Anchors whose whole surroundings occur twice are settled
too: everything around them repeats.  Only anchors at the borders of repeats are left, and
only they need a closer look.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newsmill.llm.common import pick, text_key
from newsmill.llm.toxicity import text_buffers
from newsmill.llm.winnow import Anchors, find_anchors
from newsmill.session import durable

KEY = ["_id", "_hash"]


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    texts = pick(df, doc_id=id_col, text=text_col)
    return texts.select("doc_id", *text_key(F.col("doc_id"), F.col("text")), F.coalesce("text", F.lit("")).alias("text"))


def grams_at_anchors(texts: DataFrame, units: Callable, window: int, gram: int) -> DataFrame:
    """(gram): the hash of the gram at each anchor of column ``text``."""

    def each(batches: Iterator) -> Iterator:
        for batch in batches:
            for _, data, offsets in text_buffers(batch.column(0)):
                for a in find_anchors(*units(data, offsets), window, gram):
                    yield pa.record_batch([pa.array(a.hashes.of(a.at, a.at + gram).view(np.int64))], ["gram"])

    return texts.select("text").mapInArrow(each, "gram long")


def anchors_with(
    texts: DataFrame,
    units: Callable,
    window: int,
    gram: int,
    stretches: dict[str, Callable[[Anchors], tuple]],
) -> DataFrame:
    """(_id, _hash, pos, gram, whole, before, after, ...) of each anchor.

    before and after are the units around it that a window with it can reach, whole the hash
    of all of these with their numbers, and ``stretches`` names more hashes, of 32 bits and so
    only fit to rule out: functions of the anchors that give first and last + 1 unit.
    """
    names = [*KEY, "pos", "gram", "whole", "before", "after", *stretches]

    def each(batches: Iterator) -> Iterator:
        for batch in batches:
            for first, data, offsets in text_buffers(batch.column(2)):
                for a in find_anchors(*units(data, offsets), window, gram):
                    before = np.minimum(a.before, window - gram)
                    after = np.minimum(a.after, window)
                    whole = a.hashes.of(a.at - before, a.at + after) ^ (
                        before.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
                    )
                    of = [(a.hashes.of(*f(a)) >> np.uint64(32)).astype(np.int64) for f in stretches.values()]
                    row = pa.array(a.row + first)
                    yield pa.record_batch(
                        [
                            batch.column(0).take(row),
                            batch.column(1).take(row),
                            pa.array(a.pos, pa.int32()),
                            pa.array(a.hashes.of(a.at, a.at + gram).view(np.int64)),
                            pa.array(whole.view(np.int64)),
                            pa.array(before, pa.int32()),
                            pa.array(after, pa.int32()),
                            *map(pa.array, of),
                        ],
                        names,
                    )

    more = "".join(f", {c} long" for c in stretches)
    return texts.select(*KEY, "text").mapInArrow(
        each, "_id long, _hash long, pos int, gram long, whole long, before int, after int" + more
    )


def repeated_anchors(
    texts: DataFrame, units: Callable, window: int, gram: int, stretches: dict[str, Callable] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(settled, open) anchors, both with the columns of ``anchors_with``.

    settled: anchors whose whole surroundings occur twice.  open: one row per distinct
    surroundings of the grams that occur in several, with copies, the number of anchors that
    have them; where copies is 1 the row is that anchor.
    """
    counted = grams_at_anchors(texts, units, window, gram).groupBy("gram").count()
    grams = durable(counted.where("count > 1").select("gram"), "grams")
    shared = durable(anchors_with(texts, units, window, gram, stretches or {}).join(grams, "gram"), "shared")
    others = [c for c in shared.columns if c not in ("gram", "whole")]
    kinds = durable(
        shared.groupBy("gram", "whole").agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in others]),
        "kinds",
    )
    twice = kinds.where("copies > 1").select("gram", "whole")
    several = durable(kinds.groupBy("gram").count().where("count > 1").select("gram", F.col("count").alias("kinds")), "several")
    return shared.join(twice, ["gram", "whole"]), kinds.join(several, "gram")


def merged_runs(found: pa.ListArray) -> list[list[tuple[int, int]]]:
    """Per row of lists of (start, n): touching and overlapping stretches as one (start, end),
    in order."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(found))]
    sizes = np.nan_to_num(found.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = found.flatten()
    if not len(flat):
        return out
    row = np.repeat(np.arange(len(found), dtype=np.int64) << 40, sizes)
    start = flat.field("start").to_numpy().astype(np.int64) + row
    end = start + flat.field("n").to_numpy()
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.concatenate((at[1:], [len(start)])) - 1
    low = (1 << 40) - 1
    for s, e in zip(start[at].tolist(), reach[last].tolist()):
        out[s >> 40].append((s & low, e & low))
    return out
