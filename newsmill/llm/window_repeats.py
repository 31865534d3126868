"""Repeated word windows by level-wise doubling."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newsmill.llm.common import partitions
from newsmill.llm.repeats import KEY, keyed, merged_runs, repeated_anchors
from newsmill.llm.winnow import Hashes, owners, word_units


def repeat_windows(texts: DataFrame, words: int = 35, first: int = 9) -> DataFrame:
    """(_id, _hash, start, n): stretches of words; of each text of ``keyed``, the words in some
    stretch are exactly those covered by a window of ``words`` words that also starts elsewhere.

    Levels double from ``first`` words, and only what occurs twice at one length is looked at
    at twice that length, the last step cut to ``words``: grams of ``first`` words at anchors,
    which every window has; of those that repeat, the stretches of 2 * first words to either
    side of which a window must have one; of those that repeat, the windows themselves.  What
    repeats over twice the window, on both sides of its anchor, is settled at once, so windows
    are only counted at the borders of repeats.  All counts aggregate before the shuffle.
    """
    double = 2 * first
    if not double <= words <= 4 * first:
        raise ValueError("first must be words / 4 to words / 2")
    on_right = {"right": lambda a: (a.at, a.at + np.minimum(a.after, double))}
    on_left = {"left": lambda a: (a.at - np.minimum(a.before, first), a.at + first)}
    settled, open_ = repeated_anchors(texts, word_units, words, first, on_right | on_left)
    whole = settled.select(
        *KEY, (F.col("pos") - F.col("before")).alias("start"), (F.col("before") + F.col("after")).alias("n")
    )

    def twice(side: str) -> DataFrame:
        return (
            open_.groupBy("gram", side)
            .agg(F.sum("copies").alias("n"))
            .where("n > 1")
            .select("gram", side, F.lit(True).alias(f"{side}_repeats"))
        )

    survive = (
        open_.join(twice("right"), ["gram", "right"], "left")
        .join(twice("left"), ["gram", "left"], "left")
        .where("right_repeats or left_repeats")
        .select(
            *KEY, "pos", "gram", "copies", "before", "after",
            F.coalesce("left_repeats", F.lit(False)).alias("left_repeats"),
            F.coalesce("right_repeats", F.lit(False)).alias("right_repeats"),
        )
    )
    asked = survive.groupBy(*KEY).agg(
        F.collect_list(
            F.struct("pos", "gram", "copies", "before", "after", "left_repeats", "right_repeats")
        ).alias("asked")
    )
    names = ["gram", "h", "at", "copies", *KEY, "start"]

    def windows(batches: Iterator) -> Iterator:
        for batch in batches:
            ids, keys, texts_, lists = (batch.column(c) for c in (*KEY, "text", "asked"))
            for i, found in enumerate(lists):
                data = np.frombuffer(texts_[i].as_buffer(), np.uint8)
                codes, _ = word_units(data, np.array([0, len(data)]))
                hashes = Hashes(codes)
                a = pa.Table.from_batches([pa.RecordBatch.from_struct_array(found.values)])
                pos, before, after, left, right = (
                    a.column(c).to_numpy() for c in ("pos", "before", "after", "left_repeats", "right_repeats")
                )
                # the window that starts k words before the anchor
                k = np.arange(words - first + 1)
                ok = (k <= before[:, None]) & (words - k <= after[:, None])
                ok &= left[:, None] | (k < first)
                ok &= right[:, None] | (words - k < double)
                at, k = np.nonzero(ok)
                start = pos[at] - k
                # a window comes from its own anchor only; without owners, from each it holds
                owner = owners(hashes, len(codes), words, first)
                if owner is not None:
                    own = owner[start] == pos[at]
                    at, k, start = at[own], k[own], start[own]
                n = len(at)
                if n:
                    yield pa.record_batch(
                        [
                            a.column("gram").combine_chunks().take(pa.array(at)),
                            pa.array(hashes.of(start, start + words).view(np.int64)),
                            pa.array(k, pa.int32()),
                            a.column("copies").combine_chunks().take(pa.array(at)),
                            pa.array(np.full(n, ids[i].as_py())), pa.array(np.full(n, keys[i].as_py())),
                            pa.array(start, pa.int32()),
                        ],
                        names,
                    )

    # doc_id comes along so that this exchange of the texts is the one of remove_windows
    candidates = (
        texts.repartition(partitions(texts), *KEY)
        .join(asked, KEY)
        .select("doc_id", *KEY, "text", "asked")
        .mapInArrow(windows, "gram long, h long, at int, copies long, _id long, _hash long, start int")
    )
    same = ["gram", "h", "at"]
    often = candidates.groupBy(*same).agg(F.sum("copies").alias("n")).where("n > 1").select(*same)
    counted = (
        candidates.where("copies = 1").join(often, same).select(*KEY, "start", F.lit(words).alias("n"))
    )
    return whole.unionByName(counted)


def remove_windows(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 35,
    first: int = 9,
    with_kept: bool = True,
) -> DataFrame:
    """A row per document: doc_id, n_words, n_removed, kept_sha256, spans and, with
    ``with_kept``, kept.

    Words are runs of other than space, tab and line ends.  Each word covered by a window of
    ``words`` words whose sequence also starts anywhere else, in another text or the same, is
    removed; spans are the maximal removed runs of words (start, end) and kept the others, joined by one
    space.  Windows are judged on the input.  Null and blank texts have no words; texts shorter
    than a window stay whole.  Repeated rows are copies of each other and are removed.
    """
    texts = keyed(df, id_col, text_col)
    found = repeat_windows(texts, words, first)
    spans = found.groupBy(*KEY).agg(F.collect_set(F.struct("start", "n")).alias("found"))

    def cut(batches: Iterator) -> Iterator:
        for batch in batches:
            ids, texts_, found_ = batch.columns
            out = []
            for text, runs in zip(texts_, merged_runs(found_)):
                tokens = text.as_buffer().to_pybytes().split()
                kept, at = [], 0
                for s, e in runs:
                    kept += tokens[at:s]
                    at = e
                kept += tokens[at:]
                joined = b" ".join(kept)
                out.append(
                    (
                        len(tokens), len(tokens) - len(kept), hashlib.sha256(joined).hexdigest(),
                        [{"start": s, "end": e} for s, e in runs], joined.decode() if with_kept else None,
                    )
                )
            columns = list(zip(*out)) or [()] * 5
            yield pa.record_batch(
                [
                    ids, *[pa.array(c, pa.int64()) for c in columns[:2]], pa.array(columns[2], pa.string()),
                    pa.array(columns[3], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    *([pa.array(columns[4], pa.string())] if with_kept else []),
                ],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept"][: 5 + with_kept],
            )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return (
        texts.repartition(partitions(texts), *KEY)
        .join(spans, KEY, "left")
        .select("doc_id", "text", "found")
        .mapInArrow(
            cut,
            f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, "
            "spans array<struct<start: long, end: long>>" + ", kept string" * with_kept,
        )
    )
