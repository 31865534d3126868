"""Word boundaries that mean the same thing on every JVM.

Java changed the default meaning of ``\\b`` between releases.  Patterns in
:mod:`newsmill.fixed` are written with ``\\b``; :func:`bounded` rewrites it to an
explicit test.  By default a word character is any Unicode letter, digit or
underscore; ``ascii_boundary`` restricts it to ASCII.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

UNICODE_WORD = r"[\p{L}\p{N}_]"
ASCII_WORD = r"[A-Za-z0-9_]"


def _boundary(word: str) -> str:
    return f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"


def bounded(pattern: str, ascii_boundary: bool = False) -> str:
    """Rewrite every ``\\b`` of a pattern.

    The patterns here only use ``\\b`` next to a word character.  It stands before
    one when a letter, group or class follows in the pattern, else behind one, so a
    single look at the other side is enough.
    """
    word = ASCII_WORD if ascii_boundary else UNICODE_WORD
    opened = re.sub(r"\\b(?=[A-Za-z(\[])", lambda m: f"(?<!{word})", _flat(pattern))
    return _ahead(pattern) + opened.replace(r"\b", f"(?!{word})")


def _flat(pattern: str) -> str:
    """The pattern with the same matches, without loops over groups that can be left by the way
    they came: these take stack for every turn, so a long run of names would end the executor.

    Of a run of capitalised words only the last can miss its boundary, so each is tested when it
    is read; humps of a mixed-case word are letters of either case."""
    return pattern.replace(r"(?:\s+[A-Z][a-z]+)+)\b", r"(?:\s++[A-Z][a-z]++\b)++)").replace("[a-z]+(?:[A-Z][a-z]*)*", "[a-z][A-Za-z]*")


def _ahead(pattern: str) -> str:
    """A look at the first character of a match, cheaper than the look back at the boundary."""
    first = re.match(r"\\b\(?(\[[A-Za-z-]+\])(?![*?]|\\{0)", pattern)
    alone = first and not re.search(r"\|", re.sub(r"\(\?:[^()]*\)", "", pattern))
    return f"(?={first[1]})" if alone else ""


def any_word(terms: Iterable[str], ascii_boundary: bool = False) -> str:
    """Alternation of literal terms as whole words, case ignored, in their order."""
    word = ASCII_WORD if ascii_boundary else UNICODE_WORD
    both = _boundary(word)
    terms = list(terms)
    plain = all(t[:1].isalnum() for t in terms)
    out = []
    for t in terms:
        left = "" if plain else f"(?<!{word})" if t[:1].isalnum() else both
        right = f"(?!{word})" if t[-1:].isalnum() else both
        out.append(left + r"\Q" + t + r"\E" + right)
    # Where all terms begin with a word character, that is looked at once, before the boundary.
    ahead = f"(?=[{''.join(sorted({t[0] for t in terms}))}])(?<!{word})" if plain and terms else ""
    return f"(?iu){ahead}(" + "|".join(out) + ")"


def quoted(text: Column) -> Column:
    """Regular expression that matches ``text`` itself."""
    return F.concat(F.lit("\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def word_pattern(word: Column, ascii_boundary: bool = False) -> Column:
    """Pattern of a literal whole word given by a column, case ignored."""
    edge = _boundary(ASCII_WORD if ascii_boundary else UNICODE_WORD)
    return F.concat(F.lit("(?iu)" + edge), quoted(word), F.lit(edge))


def has_word(text: Column, word: Column, ascii_boundary: bool = False) -> Column:
    """True when ``word`` stands in ``text`` between word boundaries.

    The substring test comes first, so the expression with a per-row pattern
    only runs on rows that can match.
    """
    edge = _boundary(ASCII_WORD if ascii_boundary else UNICODE_WORD)
    pattern = F.concat(F.lit(edge), quoted(word), F.lit(edge))
    return F.when(F.contains(text, word), F.regexp_like(text, pattern)).otherwise(F.lit(False))
