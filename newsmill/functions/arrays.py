"""Small helpers over literals and arrays."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strings(values: Iterable[str]) -> Column:
    """A literal ``array<string>``; typed even when it is empty."""
    return F.expr(f"cast(array({', '.join(_quoted(v) for v in values)}) as array<string>)")


def lookup(mapping: Mapping[str, str]) -> Column:
    return F.expr(f"map({', '.join(_quoted(x) for kv in mapping.items() for x in kv)})")


def first_chars(text: Column | str, most: int | None) -> Column:
    """The first ``most`` characters, or all where there is no limit."""
    return col(text) if most is None else F.left(col(text), F.lit(most))


def first_items(values: Column, most: int | None) -> Column:
    return values if most is None else F.slice(values, 1, most)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A lambda evaluates the expressions it refers to anew for every element; bound
    through this, they are looked up instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def any_of(conditions: Iterable[Column]) -> Column:
    conditions = list(conditions)
    if not conditions:
        return F.lit(False)
    return reduce(lambda a, b: a | b, conditions)


def contains_any(text: Column | str, values: Iterable[str]) -> Column:
    """True when ``text`` holds one of the literal substrings."""
    values, t = list(values), col(text)
    if len(values) <= 4:
        return any_of(F.contains(t, F.lit(v)) for v in values)
    return let(t, lambda x: F.exists(strings(values), lambda v: F.contains(x, v)))


def contains_any_of(text: Column, patterns: Column) -> Column:
    """True when ``text`` holds one of the substrings in an array column (case ignored)."""
    return let(text, lambda t: F.exists(patterns, lambda p: F.contains(t, F.lower(p))))


def ends_with_any(text: Column | str, values: Iterable[str]) -> Column:
    return let(col(text), lambda x: F.exists(strings(values), lambda v: F.endswith(x, v)))


def starts_with_any(text: Column | str, values: Iterable[str]) -> Column:
    return let(col(text), lambda x: F.exists(strings(values), lambda v: F.startswith(x, v)))


def first_present(*columns: Column) -> Column:
    """``coalesce`` that treats the empty string as missing."""
    return F.coalesce(*[let(c, lambda v: F.when(v != "", v)) for c in columns])


def present(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull() & (v != ""))


def trimmed(values: Column) -> Column:
    """The elements trimmed; ``F.trim`` itself as the function of a transform would take the place
    of an element for the characters to cut off."""
    return F.transform(values, lambda v: F.trim(v))


# Unicode white space; what a shorthand class of the regular expressions leaves out.
BLANK = "[\\s\\x1c-\\x1f\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
# Runs of it that are not one space already; what prints as ASCII is passed over by one test.
BLANKS = f"(?:[[^ -~]&&{BLANK}]| (?=[[^!-~]&&{BLANK}]))[[^!-~]&&{BLANK}]*"


# The same with the five blanks of ASCII-only expressions.
ASCII_BLANKS = "[\t\n\f\r][\t\n\f\r ]*| [\t\n\f\r ]+"
# Space separators, which a trim in SQL takes for spaces.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def squeeze(text: Column | str) -> Column:
    """Collapse white space, non-breaking and other Unicode blanks included, to single
    spaces and trim."""
    return F.trim(F.regexp_replace(col(text), BLANKS, " "))


def squeeze_ascii(text: Column | str) -> Column:
    """The same as SQL does it: runs of ASCII blanks are collapsed, space separators of any kind
    are trimmed."""
    at_an_end = lambda t: F.substring(t, 1, 1).isin(*SPACES) | F.substring(t, -1, 1).isin(*SPACES)
    single = F.regexp_replace(col(text), ASCII_BLANKS, " ")
    return let(single, lambda t: F.when(at_an_end(t), F.trim(t, F.lit(SPACES))).otherwise(t))


def lower_letters(text: Column) -> Column:
    """Lower case letter by letter, as SQL does it: none becomes two, none depends on its place."""
    return F.lower(F.replace(F.replace(text, F.lit("\u0130"), F.lit("i")), F.lit("\u03a3"), F.lit("\u03c3")))
