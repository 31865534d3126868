"""Literal strings found in texts: Aho-Corasick automata over shards of the strings.

A table of strings is dealt by hash into shards of about ``SHARD_CHARS`` characters.  Each shard
is an automaton that runs over Arrow batches where the texts lie: a text is read once a shard,
never shuffled, and never repeated per candidate.  The driver and a task hold at most
``SHARDS_AT_ONCE`` shards; between these groups the rows are written.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from newsmill.session import durable

SHARD_CHARS = 500_000
SHARDS_AT_ONCE = 4

Scan = Callable[[str], object]


def _is_word(char: str, ascii_boundary: bool) -> bool:
    if ascii_boundary:
        return char == "_" or (char.isascii() and char.isalnum())
    return char == "_" or unicodedata.category(char)[0] in "LN"


def _bounded(text: str, start: int, stop: int, ascii_boundary: bool) -> bool:
    """Whether both ends of text[start:stop] are word boundaries."""
    before = start > 0 and _is_word(text[start - 1], ascii_boundary)
    after = stop < len(text) and _is_word(text[stop], ascii_boundary)
    return (
        before != _is_word(text[start], ascii_boundary) and after != _is_word(text[stop - 1], ascii_boundary)
    )


def _automaton(strings: Iterable[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, s in enumerate(strings):
        found.add_word(s, i)
    found.make_automaton()
    return found


def _scanner(build: Callable[[], Scan], result: str):
    """A UDF over a text column; the automaton is built once a task, on its first batch."""
    scan: list[Scan] = []
    kind = to_arrow_type(DataType.fromDDL(result))

    @F.arrow_udf(result)
    def run(texts: pa.Array) -> pa.Array:
        if not scan:
            scan.append(build())
        return pa.array([None if t is None else scan[0](t) for t in texts.to_pylist()], kind)

    return run


def _first(rows: list[Row]) -> Callable[[], Scan]:
    """The row with the least place whose string a text contains."""
    rows = sorted(rows, key=lambda r: (r["_last"], r["_order"] if not r["_last"] else 0, r["_own"]))

    def build() -> Scan:
        automaton = _automaton(r["_string"] for r in rows)

        def scan(text: str):
            best = min((i for _, i in automaton.iter(text)), default=None)
            return None if best is None else rows[best].asDict()

        return scan

    return build


def _all_in(rows: list[Row], ascii_boundary: bool) -> Callable[[], Scan]:
    """Every string contained, and whether it stands as a word somewhere."""
    strings = [r["_string"] for r in rows]

    def build() -> Scan:
        automaton = _automaton(strings)

        def scan(text: str):
            found: dict[int, bool] = {}
            for last, i in automaton.iter(text):
                if not found.get(i):
                    found[i] = _bounded(text, last + 1 - len(strings[i]), last + 1, ascii_boundary)
            return [{"string": strings[i], "word": word} for i, word in found.items()]

        return scan

    return build


_EDGE = "\x00"


def _edged(text: str, boundary: re.Pattern) -> str:
    """The text with a mark at every word boundary."""
    return _EDGE.join(boundary.split(text))


def _counts(rows: list[Row], ascii_boundary: bool) -> Callable[[], Scan]:
    """How often each string stands as a word; a string does not overlap itself.

    Texts and strings get a mark at every word boundary, and strings one at both ends, so the
    automaton stops at whole words only, not at every place where their letters stand."""
    strings = [r["_string"] for r in rows]

    def build() -> Scan:
        boundary = re.compile(r"\b", re.ASCII if ascii_boundary else 0)
        edged = [_EDGE + _edged(s, boundary).removeprefix(_EDGE).removesuffix(_EDGE) + _EDGE for s in strings]
        whole = _automaton(edged)
        sizes = [len(e) for e in edged]
        plain: list = []  # for texts that hold the mark itself; built when there is one

        def scan_plain(text: str):
            if not plain:
                plain.append(_automaton(strings))
            for last, i in plain[0].iter(text):
                start = last + 1 - len(strings[i])
                if _bounded(text, start, last + 1, ascii_boundary):
                    yield start, last + 1, i

        def scan_edged(text: str):
            for last, i in whole.iter(_edged(text, boundary)):
                yield last + 1 - sizes[i], last, i  # the mark at the end may begin the next

        def scan(text: str):
            free: dict[int, int] = {}
            counts: dict[int, int] = {}
            for start, stop, i in (scan_plain if _EDGE in text else scan_edged)(text):
                if start >= free.get(i, 0):
                    free[i] = stop
                    counts[i] = counts.get(i, 0) + 1
            return [{"string": strings[i], "n": n} for i, n in counts.items()]

        return scan

    return build


def _over_shards(
    df: DataFrame, text: Column, table: DataFrame, scanner: Callable[[list[Row]], Callable[[], Scan]],
    result: str, merge: Callable[..., Column], out: str,
) -> DataFrame:
    """``df`` with the merged results of all shards of ``table`` (_string, ...)."""
    table = durable(table, "strings")
    chars = table.agg(F.sum(F.length("_string"))).first()[0] or 0
    shards = max(1, math.ceil(chars / SHARD_CHARS))
    shard = F.pmod(F.xxhash64("_string"), F.lit(shards))
    for first in range(0, shards, SHARDS_AT_ONCE):
        columns = []
        for i in range(first, min(first + SHARDS_AT_ONCE, shards)):
            rows = table.where(shard == i).collect()  # about SHARD_CHARS characters
            if rows:
                columns.append(_scanner(scanner(rows), result)(text))
        if first:
            df = durable(df, "scanned")
            columns.append(F.col(out))
        if not columns:
            columns = [F.lit(None).cast(result)]
        df = df.withColumn(out, columns[0] if len(columns) == 1 else merge(*columns))
    return df


def _kind(df: DataFrame, column: str) -> str:
    return dict(df.select(F.col(column)).dtypes)[column]


def first_string(df: DataFrame, text: Column, strings: DataFrame, out: str) -> DataFrame:
    """``df`` with the struct of the first of ``strings`` (_string, _last, _order, _own) that a text
    contains, by (_last, _order, _own); null where there is none."""
    result = f"struct<_last: boolean, _order: {_kind(strings, '_order')}, _own: string, _string: string>"
    table = strings.select("_last", "_order", "_own", "_string")
    return _over_shards(df, text, table, _first, result, F.least, out)


def _concat(*arrays: Column) -> Column:
    return F.concat(*[F.coalesce(a, F.array()) for a in arrays])


def strings_in(df: DataFrame, text: Column, strings: DataFrame, column: str, out: str, ascii_boundary: bool = False) -> DataFrame:
    """``df`` with the array of the distinct strings that a text contains, as (string, word): word
    tells whether it stands there between word boundaries."""
    table = strings.select(F.col(column).alias("_string")).where("_string <> ''").distinct()
    result = "array<struct<string: string, word: boolean>>"
    return _over_shards(df, text, table, lambda rows: _all_in(rows, ascii_boundary), result, _concat, out)


def string_counts(df: DataFrame, text: Column, strings: DataFrame, column: str, out: str, ascii_boundary: bool = False) -> DataFrame:
    """``df`` with the array of (string, n): how often a string stands in a text between word
    boundaries, without overlaps."""
    table = strings.select(F.col(column).alias("_string")).where("_string <> ''").distinct()
    result = "array<struct<string: string, n: bigint>>"
    return _over_shards(df, text, table, lambda rows: _counts(rows, ascii_boundary), result, _concat, out)
