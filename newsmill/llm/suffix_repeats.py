"""Repeated byte strings by the common-prefix interval tree of an enhanced suffix array."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newsmill.llm.common import partitions
from newsmill.llm.repeats import KEY, keyed, merged_runs, repeated_anchors
from newsmill.llm.winnow import BYTE_CODES, Hashes, byte_units


def _matrix(strings: pa.Array, width: int, backwards: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The strings of an Arrow binary array as rows padded with 0, and their sizes."""
    strings = strings.cast(pa.large_binary())
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)
    sizes = np.diff(offsets)
    step = np.arange(width)
    at = offsets[1:, None] - 1 - step if backwards else offsets[:-1, None] + step
    inside = step < sizes[:, None]
    if not len(data):
        return np.zeros(inside.shape, np.uint8), sizes
    return np.where(inside, data[np.clip(at, 0, len(data) - 1)], 0).astype(np.uint8), sizes


def _common(m: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows a and b."""
    differ = m[a] != m[b]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), m.shape[1])
    return np.minimum(first, np.minimum(sizes[a], sizes[b]))


def prefix_intervals(lcp: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of the intervals of a sorted list in which all strings share
    ``length`` and not all share more; lcp[i] is what i and i + 1 share.  A stack scan."""
    stack = [(0, 0)] if len(lcp) else []
    for i, value in enumerate([*lcp.tolist(), -1]):
        first = i
        while stack and stack[-1][0] > value:
            length, first = stack.pop()
            yield length, first, i
        if value >= 0 and (not stack or stack[-1][0] < value):
            stack.append((value, first))


def class_groups(
    left: np.ndarray, left_n: np.ndarray, right: np.ndarray, right_n: np.ndarray, need: int
) -> Iterator[tuple[int, int, np.ndarray]]:
    """Maximal repeat groups (left, right, members) of suffixes that start with one gram.

    Rows of ``left`` are what stands before each gram, last byte first, rows of ``right`` what
    stands after; ``left_n`` and ``right_n`` their sizes.  The members share ``left`` bytes
    before and ``right`` after, at least ``need`` together; not all share another byte on either
    side, and no other suffix shares these.
    """
    rights = [m.tobytes()[:n] for m, n in zip(right, right_n)]
    lefts = [m.tobytes()[:n] for m, n in zip(left, left_n)]
    order = np.array(sorted(range(len(rights)), key=rights.__getitem__))
    place = np.empty(len(order), np.int64)
    place[sorted(range(len(lefts)), key=lefts.__getitem__)] = np.arange(len(order))
    where = np.empty(len(order), np.int64)
    where[order] = np.arange(len(order))
    lcp = _common(right, right_n, order[:-1], order[1:])
    for r, first, last in prefix_intervals(lcp):
        inside = order[first : last + 1]
        inside = inside[np.argsort(place[inside])]
        shared = _common(left, left_n, inside[:-1], inside[1:])
        if shared.max() < need - r:
            continue
        rank = where[inside]
        for l, a, b in prefix_intervals(shared):
            if l + r < need:
                continue
            lo, hi = rank[a : b + 1].min(), rank[a : b + 1].max()
            if lcp[lo:hi].min() == r:  # else all share more to the right: a group of its own
                yield int(l), int(r), inside[a : b + 1]


def repeat_occurrences(
    texts: DataFrame, length: int = 200, gram: int = 80, class_size: int = 4096
) -> DataFrame:
    """(group, _id, _hash, start, n): occurrences of repeated strings of ``length`` bytes or more.

    Of each text of ``keyed``, the bytes in some occurrence are exactly those covered by a
    string of ``length`` bytes that also starts elsewhere.

    The suffixes that start at anchors, of grams that occur twice, are sorted class by class: a
    class is the stretch of the suffix array that starts with one gram.  Its longest common
    prefixes are stack-scanned, and its intervals tested for diversity of what stands before,
    which gives the maximal repeat groups with all occurrences, as far as a window around
    the anchor reaches (longer repeats are chains of groups).  Anchors with equal surroundings
    are one suffix of the class.  A class of more than ``class_size`` suffixes is not brought
    together: its windows are counted by hash instead, in rows that aggregate before the shuffle.
    """
    need = length - gram
    settled, open_ = repeated_anchors(texts, byte_units, length, gram)
    whole = settled.select(
        F.xxhash64("gram", "whole").alias("group"),
        *KEY,
        (F.col("pos") - F.col("before")).alias("start"),
        (F.col("before") + F.col("after")).alias("n"),
    )
    data = F.col("text").cast("binary")
    # doc_id comes along so that this exchange of the texts is the one of remove_repeats
    around = texts.repartition(partitions(texts), *KEY).join(
        open_.select(*KEY, "pos", "gram", "copies", "kinds", "before", "after"), KEY
    ).select(
        "doc_id", *KEY, "pos", "gram", "copies", "kinds",
        F.substring(data, F.col("pos") - F.col("before") + 1, F.col("before")).alias("left"),
        F.substring(data, F.col("pos") + gram + 1, F.col("after") - gram).alias("right"),
        F.when(F.col("kinds") > class_size, F.substring(data, F.col("pos") + 1, F.lit(gram))).alias("middle"),
    )

    def groups(t: pa.Table) -> pa.RecordBatch:
        gram_of, copies = t.column("gram").to_numpy(), t.column("copies").to_numpy()
        new = np.ones(len(gram_of), bool)
        new[1:] = gram_of[1:] != gram_of[:-1]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.concatenate((starts, [len(gram_of)])))
        width = max(1, need)
        left, left_n = _matrix(t.column("left").combine_chunks(), width, backwards=True)
        right, right_n = _matrix(t.column("right").combine_chunks(), width)
        # classes of two: one group at most
        a = starts[sizes == 2]
        l, r = _common(left, left_n, a, a + 1), _common(right, right_n, a, a + 1)
        ok = l + r >= need
        a, l, r = a[ok], l[ok], r[ok]
        member = [np.concatenate((a, a + 1))]
        found = [np.tile(l, 2)], [np.tile(r, 2)], [np.zeros(2 * len(a), np.int64)]
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
            part = slice(s, s + n)
            for k, (l, r, inside) in enumerate(
                class_groups(left[part], left_n[part], right[part], right_n[part], need)
            ):
                member.append(inside + s)
                for out, value in zip(found, (l, r, k)):
                    out.append(np.full(len(inside), value))
        at = np.concatenate(member)
        l, r, k = (np.concatenate(x) for x in found)
        own = copies[at] == 1  # of several copies each is settled already
        at, l, r, k = at[own], l[own], r[own], k[own]
        row = pa.array(at)
        return pa.record_batch(
            [
                pa.array(gram_of[at] ^ k),
                *[t.column(c).combine_chunks().take(row) for c in KEY],
                pa.array(t.column("pos").to_numpy()[at] - l, pa.int32()),
                pa.array(l + gram + r, pa.int32()),
            ],
            ["group", *KEY, "start", "n"],
        )

    def scan(batches: Iterator) -> Iterator:
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
            if not t.num_rows:
                continue
            gram_of = t.column("gram").to_numpy()
            last = int(np.flatnonzero(gram_of != gram_of[-1])[-1]) + 1 if gram_of[0] != gram_of[-1] else 0
            if last:
                yield groups(t.slice(0, last))
            held = t.slice(last)
        if held is not None:
            yield groups(held)

    small = (
        around.where(F.col("kinds") <= class_size)
        .select("doc_id", "gram", *KEY, "pos", "copies", "left", "right")
        .repartition(partitions(texts), "gram")
        .sortWithinPartitions("gram")
        .mapInArrow(scan, "group long, _id long, _hash long, start int, n int")
    )

    def windows(batches: Iterator) -> Iterator:
        for batch in batches:
            for row in batch.to_pylist():
                text = row["left"] + row["middle"] + row["right"]
                starts = np.arange(len(text) - length + 1)
                h = Hashes(BYTE_CODES[np.frombuffer(text, np.uint8)]).of(starts, starts + length)
                n = len(starts)
                yield pa.record_batch(
                    [
                        pa.array([row["gram"]] * n, pa.int64()), pa.array(h.view(np.int64)),
                        pa.array(len(row["left"]) - starts, pa.int32()),
                        pa.array([row["copies"]] * n, pa.int64()),
                        pa.array([row["_id"]] * n, pa.int64()), pa.array([row["_hash"]] * n, pa.int64()),
                        pa.array(starts + row["pos"] - len(row["left"]), pa.int32()),
                    ],
                    ["gram", "h", "at", "copies", *KEY, "start"],
                )

    if open_.where(F.col("kinds") > class_size).isEmpty():
        return whole.unionByName(small)
    large = around.where(F.col("kinds") > class_size).mapInArrow(
        windows, "gram long, h long, at int, copies long, _id long, _hash long, start int"
    )
    # a window that holds the gram twice comes once for each place of it in the window
    same = ["gram", "h", "at"]
    often = large.groupBy(*same).agg(F.sum("copies").alias("n")).where("n > 1").select(*same)
    counted = large.where("copies = 1").join(often, same).select(
        F.xxhash64("gram", "h").alias("group"), *KEY, "start", F.lit(length).alias("n")
    )
    return whole.unionByName(small).unionByName(counted)


def remove_repeats(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 200,
    gram: int = 80,
    class_size: int = 4096,
    with_kept: bool = True,
) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans and, with
    ``with_kept``, kept.

    Each UTF-8 byte covered by a string of ``length`` bytes that also starts anywhere else, in
    another text or the same, is removed; spans are the maximal removed runs (start, end) and
    kept the bytes that stay, joined.  Strings are judged on the input.  Null texts count as empty; texts shorter
    than ``length`` stay whole.  Repeated rows are copies of each other and are removed.
    """
    texts = keyed(df, id_col, text_col)
    found = repeat_occurrences(texts, length, gram, class_size)
    spans = found.groupBy(*KEY).agg(F.collect_set(F.struct("start", "n")).alias("found"))

    def cut(batches: Iterator) -> Iterator:
        for batch in batches:
            ids, texts_, found_ = batch.columns
            out = []
            for text, runs in zip(texts_, merged_runs(found_)):
                data = text.as_buffer().to_pybytes()
                kept, at = [], 0
                for s, e in runs:
                    kept.append(data[at:s])
                    at = e
                kept = b"".join([*kept, data[at:]])
                out.append((len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), runs, kept if with_kept else None))
            columns = list(zip(*out)) or [()] * 6
            yield pa.record_batch(
                [
                    ids, *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string()),
                    pa.array(
                        [[{"start": s, "end": e} for s, e in r] for r in columns[4]],
                        pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
                    ),
                    *([pa.array(columns[5], pa.binary())] if with_kept else []),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"][: 6 + with_kept],
            )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return (
        texts.repartition(partitions(texts), *KEY)
        .join(spans, KEY, "left")
        .select("doc_id", "text", "found")
        .mapInArrow(
            cut,
            f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
            "spans array<struct<start: long, end: long>>" + ", kept binary" * with_kept,
        )
    )
