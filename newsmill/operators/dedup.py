"""Keep-first deduplication and its report: W1, A8, J14, P25."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from newsmill.functions.arrays import let, lower_letters, squeeze, squeeze_ascii
from newsmill.functions.text import is_blank_row


def keep_first(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    keep_null_keys: bool = False,
) -> DataFrame:
    """The first row per key.

    The ``row_number = 1`` filter becomes a group limit before the shuffle: a
    task sends one row per key however many copies it holds.  Rows with a
    missing key are dropped, or all kept: each is then a group of its own.
    """
    types = dict(df.dtypes)
    missing = F.lit(False)
    for k in keys:
        empty = F.col(k).isNull()
        missing = missing | ((empty | (F.col(k) == "")) if types[k] == "string" else empty)
    if keep_null_keys:
        alone = F.when(missing, F.monotonically_increasing_id())
        rows, groups = df.withColumn("_alone", alone), [*keys, "_alone"]
    else:
        rows, groups = df.where(~missing), list(keys)
    w = Window.partitionBy(*groups).orderBy(*order)
    return (
        rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r", "_alone")
    )


def keep_first_prefix(
    df: DataFrame, text: str, order: Sequence[str | Column], chars: int | None = None,
    within: Sequence[str] = (), every_text: bool = False,
) -> DataFrame:
    """W1 on a text, case and blanks ignored, or on its first ``chars`` characters.

    The key is the text's digest, so what is sorted and grouped is short however long the texts
    are.  Blank texts are dropped.  With ``every_text`` they are not, the first blank text and the
    first missing one stay, and case and blanks are those of SQL.
    """
    cut = F.col(text) if chars is None else F.left(F.col(text), F.lit(chars))
    if every_text:
        whole = lower_letters(squeeze_ascii(cut) if chars is None else cut)
        key = F.coalesce(F.sha2(whole, 256), F.lit("missing"))
    else:
        key = F.sha2(F.nullif(F.lower(squeeze(cut) if chars is None else cut), F.lit("")), 256)
    return keep_first(df.withColumn("_key", key), [*within, "_key"], order).drop("_key")


def drop_blank_rows(df: DataFrame) -> DataFrame:
    """P25 over all columns."""
    return df.where(~is_blank_row(*[F.col(c).cast("string") for c in df.columns]))


def clean_table(df: DataFrame, key: str, order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Drop blank rows, then keep the first row per key; rows without a key stay."""
    filled = df.where(~is_blank_row(*[F.col(c).cast("string") for c in payload]))
    trimmed = filled.withColumn("_key", F.trim(F.col(key)))
    return keep_first(trimmed, ["_key"], order, keep_null_keys=True).drop("_key")


def dedup_report(df: DataFrame, key: str, payload: Sequence[str]) -> DataFrame:
    """Rows before and after :func:`clean_table` without building the result."""
    k = F.nullif(F.trim(F.col(key)), F.lit(""))
    blank = is_blank_row(*[F.col(c).cast("string") for c in payload])
    return (
        df.select(k.alias("k"), blank.alias("blank"))
        .agg(
            F.count(F.lit(1)).alias("before_count"),
            (
                F.count_distinct(F.when(~F.col("blank"), F.col("k")))
                + F.count_if(~F.col("blank") & F.col("k").isNull())
            ).alias("after_count"),
        )
        .withColumn("removed_count", F.col("before_count") - F.col("after_count"))
    )


def _uncontained(texts: list[str | None]) -> list[int]:
    """Places of the texts that neither contain nor are contained in one kept before.

    An automaton of the page's texts tells which of them a text contains.  A kept text marks
    those; so each text is read at most once, whatever is kept."""
    import ahocorasick

    places: dict[str, int] = {}
    for i, t in enumerate(texts):
        if t is not None:
            places.setdefault(t, i)
    automaton = ahocorasick.Automaton()
    for t, i in places.items():
        if t:
            automaton.add_word(t, i)
    automaton.make_automaton()
    kept, marked, out, full = set(), set(), [], False
    for i, t in enumerate(texts):
        if t is None:
            out.append(i)
            continue
        if full or places[t] != i or i in marked or (t == "" and kept):
            continue
        inside = {j for _, j in automaton.iter(t)} if t else set()
        if kept.isdisjoint(inside):
            kept.add(i)
            marked |= inside
            out.append(i)
            full = t == ""  # every text contains the empty one
    return out


def _kept_places(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else _uncontained(t) for t in texts.to_pylist()], pa.list_(pa.int32()))


def drop_contained(texts: Column) -> Column:
    """Drop a text that contains, or is contained in, one kept before it, case and blanks
    ignored; nulls stay.

    Greedy in array order, so it works on the headlines of one post, which are
    one bounded array value; the work is linear in their characters and in the texts found
    within others.
    """
    flat = F.transform(texts, lambda t: F.lower(F.array_join(F.split(F.trim(t), r"\s+"), " ")))
    places = F.arrow_udf(_kept_places, "array<int>")
    both = F.struct(texts.alias("t"), places(flat).alias("at"))
    return let(both, lambda b: F.transform(b["at"], lambda i: F.get(b["t"], i)))
