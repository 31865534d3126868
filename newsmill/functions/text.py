"""Text expressions: F8-F12, F18-F24, F27, F29, P16-P24, P27, P28, A3, A18, J13."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, functions as F

from newsmill import fixed
from newsmill.functions.arrays import (
    BLANK, any_of, col, contains_any, ends_with_any, first_chars, first_items,
    first_present, let,
    lookup, present, squeeze, starts_with_any, strings, trimmed,
)
from newsmill.functions.patterns import any_word, bounded, has_word


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def words(text: Column | str) -> Column:
    return present(F.split(squeeze(text), " "))


def has_words(text: Column | str, least: int) -> Column:
    """Whether there are at least so many words; a text is read up to the last of these."""
    space, word = BLANK, f"[^{BLANK[1:]}"
    return col(text).rlike(f"^{space}*+(?:{word}++{space}++){{{least - 1}}}{word}")


# --- F8: keywords -----------------------------------------------------------

# The first small letters of a mixed-case word stand before a capital; other words fail here at once.
_MIXED_AHEAD = "(?=[A-Z]*+[a-z]++[A-Z])"

def keywords(
    text: Column | str,
    limit: int | None = None,
    ascii_boundary: bool = False,
    word_chars: int | None = None,
    ticker_chars: int | None = None,
) -> Column:
    """F8: likely entity names, in order of priority.

    ``word_chars`` and ``ticker_chars`` can confine mixed-case and leading words, and bare
    tickers, to the opening of the text, ``limit`` the number of names.
    """
    t = col(text)
    head, opening = first_chars(t, word_chars), first_chars(t, ticker_chars)
    stop = strings(w.lower() for w in fixed.KEYWORD_STOP_WORDS)
    phrases = F.filter(
        _all(t, bounded(fixed.PHRASE_PATTERN, ascii_boundary)),
        lambda p: ~F.array_contains(strings(fixed.KEYWORD_STOP_PHRASES), p),
    )
    not_stop = lambda w: ~F.array_contains(stop, F.lower(w))
    mixed = F.filter(
        _all(head, _MIXED_AHEAD + bounded(fixed.MIXED_CASE_PATTERN, ascii_boundary)),
        lambda w: (F.length(w) >= 3) & not_stop(w),
    )
    aliases = F.transform(
        _all(t, fixed.MARKED_TICKER_PATTERN),
        lambda x: F.try_element_at(lookup(fixed.NAME_ALIASES), F.lower(x)),
    )
    leading = F.filter(_all(head, bounded(fixed.LEADING_WORD_PATTERN, ascii_boundary)), not_stop)
    tickers = F.transform(
        _all(opening, bounded(fixed.TICKER_PATTERN, ascii_boundary)),
        lambda x: F.try_element_at(lookup(fixed.TICKER_NAMES), x),
    )
    rest = present(F.concat(mixed, aliases, leading, tickers))
    return first_items(_phrases_then_new(phrases, rest), limit)


def _phrases_then_new(phrases: Column, rest: Column) -> Column:
    """All phrases, then the first of each other name, case ignored, that is no phrase.

    Entries are sorted by (name, phrase or not, place), so an entry is new where its name differs
    from the one before it; then they go back to their places."""

    def entries(names: Column, later: int) -> Column:
        return F.transform(names, lambda w, i: F.struct(F.lower(w).alias("low"), F.lit(later).alias("later"), i.alias("at"), w.alias("w")))

    def unseen(s: Column) -> Column:
        kept = F.filter(s, lambda e, i: (e["later"] == 0) | (i == 0) | (F.get(s, i - 1)["low"] != e["low"]))
        return F.array_sort(F.transform(kept, lambda e: F.struct(e["later"], e["at"], e["w"])))

    both = F.array_sort(F.concat(entries(phrases, 0), entries(rest, 1)))
    return F.transform(let(both, unseen), lambda e: e["w"])


# --- F9: match score --------------------------------------------------------

def match_score(
    name: Column | str, keyword: Column | str, text: Column | str, ascii_boundary: bool = False
) -> Column:
    """how well an entity name fits a keyword and the text it came from, 0 to 2."""
    low = F.struct(
        F.lower(col(name)).alias("n"), F.lower(col(keyword)).alias("k"), F.lower(col(text)).alias("t")
    )
    return let(low, lambda x: _lower_score(x["n"], x["k"], x["t"], ascii_boundary))


def _lower_score(n: Column, k: Column, t: Column, ascii_boundary: bool) -> Column:
    within = F.when(has_word(t, n, ascii_boundary), True).when(F.contains(t, n), False)
    suffix = F.exists(
        strings(fixed.LEGAL_SUFFIXES), lambda s: F.contains(n, s) & ~F.contains(t, s)
    )
    parts = score_parts(n, k)
    return _total(F.when(suffix, parts["cut"]).otherwise(parts["plain"]), within)


def suffixes_in(low: Column | str) -> Column:
    """Which legal suffixes a lower-cased text holds."""
    return F.filter(strings(fixed.LEGAL_SUFFIXES), lambda s: F.contains(col(low), s))


def score_parts(name: Column | str, keyword: Column | str) -> Column:
    """What a lower-cased name and keyword alone give F9: the score where the text holds all legal
    suffixes of the name (plain) or lacks one (cut), and these suffixes."""
    n, k = col(name), col(keyword)
    extra = F.array_except(
        F.array_except(words(n), words(k)), strings(fixed.NAME_FILLER_WORDS)
    )

    def base(cut: bool) -> Column:
        inside = F.lit(0.3) if cut else F.when(F.size(extra) > 1, 0.3).otherwise(0.5)
        return (
            F.when(n == k, 1.0)
            .when(
                F.startswith(n, F.concat(k, F.lit(" "))) | F.startswith(n, F.concat(k, F.lit("-"))),
                0.4 if cut else 0.75,
            )
            .when(F.startswith(n, k), 0.3 if cut else 0.7)
            .when(F.contains(n, k), inside)
            .when(F.contains(k, n), 0.5)
            .otherwise(0.0)
        )

    return F.when(n.isNotNull() & (n != ""), F.struct(
        base(False).alias("plain"),
        (base(True) - F.when(n != k, 0.3).otherwise(0.0)).alias("cut"),
        suffixes_in(n).alias("suffixes"),
    ))


def score_of_facts(parts: Column | str, word: Column | str, suffixes: Column | str) -> Column:
    """F9 without the text: ``word`` tells whether the text holds the name as a word (null: not at
    all), ``suffixes`` which legal suffixes it holds."""
    p = col(parts)
    whole = F.size(F.array_except(p["suffixes"], col(suffixes))) == 0
    return _total(F.when(whole, p["plain"]).otherwise(p["cut"]), col(word))


def _total(base: Column, within: Column) -> Column:
    """``within``: the text holds the name, as a word or only as a part of one; null if it does not."""
    score = F.round(base + F.when(within, 0.6).when(~within, 0.3).otherwise(0.0), 6)
    return F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(score, F.lit(2.0)))).otherwise(0.0)


# --- F10, A18: subjects and entities ----------------------------------------

def main_subject(
    text: Column | str, scan_chars: int | None = None, ascii_boundary: bool = False
) -> Column:
    """first acceptable hit of the subject patterns."""
    t = first_chars(text, scan_chars)
    candidates = []
    for p in fixed.SUBJECT_PATTERNS:
        hit = F.regexp_extract(t, "(?iu)" + bounded(p, ascii_boundary), 1)
        fits = lambda h: F.when((F.length(h) > 2) & ~F.lower(h).isin(fixed.SUBJECT_REJECTED), h)
        candidates.append(let(hit, fits))
    return F.coalesce(*candidates)


def mentioned_entities(
    text: Column | str,
    limit: int | None = None,
    scan_chars: int | None = None,
    ascii_boundary: bool = False,
) -> Column:
    """Distinct capitalised names minus common words, in order of the patterns."""
    t = first_chars(text, scan_chars)
    found = F.concat(*[_all(t, bounded(p, ascii_boundary)) for p in fixed.ENTITY_PATTERNS])
    kept = F.array_except(
        F.array_distinct(F.filter(found, lambda x: F.length(x) > 3)), strings(fixed.COMMON_WORDS)
    )
    return first_items(kept, limit)


def subject_first(entities: Column, subject: Column, limit: int | None = None) -> Column:
    """Put the main subject at the front of the entity list."""
    def place(s: Column) -> Column:
        rest = F.filter(entities, lambda e: s.isNull() | (e != s))
        front = F.when(s.isNull(), strings([])).otherwise(F.array(s))
        return first_items(F.concat(front, rest), limit)

    return let(subject, place)


# --- J13, A3: terms ---------------------------------------------------------

def term_hits(text: Column | str, terms: Iterable[str], ascii_boundary: bool = False) -> Column:
    """Every whole-word hit of the terms, capitalised, in text order."""
    return F.transform(_all(col(text), any_word(terms, ascii_boundary)), F.initcap)


def count_label(hits: Column) -> Column:
    """A3: ``Name (3x), Other (1x)`` by falling count, then first appearance."""
    counted = let(
        hits,
        lambda every: F.transform(
            F.array_distinct(every),
            lambda h, i: F.struct(
                F.negate(F.size(F.filter(every, lambda x: x == h))).alias("n"),
                i.alias("i"),
                h.alias("h"),
            ),
        ),
    )
    return F.array_join(
        F.transform(
            F.array_sort(counted),
            lambda c: F.concat(c["h"], F.lit(" ("), F.negate(c["n"]).cast("string"), F.lit("x)")),
        ),
        ", ",
    )


# --- F11, F12: comments -----------------------------------------------------

def contexts(text: Column | str, term_regex: str, around: int = 100) -> Column:
    """Stretches of text with up to ``around`` characters on both sides of a hit.

    Stretches do not overlap and are taken from the left; a hit that starts within
    ``around`` characters of the start of a stretch moves its end.  The text is split
    at the hits once, so the cost grows with its length, not with ``around``.
    """
    t = col(text)
    parts = F.arrays_zip(
        F.split(t, term_regex, -1).alias("before"), _all(t, term_regex, 0).alias("hit")
    )
    none = F.filter(F.array(F.struct(F.lit(0).alias("s"), F.lit(0).alias("e"))), lambda x: F.lit(False))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("s"), F.lit(-1).alias("e"), none.alias("out"))

    def step(acc: Column, part: Column) -> Column:
        p = acc["at"] + F.length(part["before"])
        e = p + F.length(part["hit"])
        opened = acc["e"] >= 0
        end = F.when(opened, acc["e"] + around).otherwise(0)
        moved = opened & (p <= acc["s"] + around)
        inside = opened & ~moved & (p < end)
        closed = F.when(
            opened & ~moved & ~inside,
            F.concat(acc["out"], F.array(F.struct(acc["s"].alias("s"), acc["e"].alias("e")))),
        ).otherwise(acc["out"])
        return F.struct(
            e.alias("at"),
            F.when(moved | inside, acc["s"]).otherwise(F.greatest(end, p - around)).alias("s"),
            F.when(inside, acc["e"]).otherwise(e).alias("e"),
            closed.alias("out"),
        )

    spans = F.reduce(
        F.filter(parts, lambda x: x["hit"].isNotNull()),
        start,
        step,
        lambda acc: F.when(
            acc["e"] >= 0,
            F.concat(acc["out"], F.array(F.struct(acc["s"].alias("s"), acc["e"].alias("e")))),
        ).otherwise(acc["out"]),
    )
    return F.transform(spans, lambda x: F.substr(t, x["s"] + 1, x["e"] + around - x["s"]))


def support_note(
    text: Column | str, label: str, terms: Iterable[str], ascii_boundary: bool = False,
    quote_chars: int | None = None,
) -> Column:
    """quote the first context that suggests support, else say it is mentioned."""
    pattern = any_word(terms, ascii_boundary)
    backs = "(?iu)" + "|".join(fixed.SUPPORT_PATTERNS)

    def note(found: Column) -> Column:
        first = F.get(F.filter(found, lambda c: c.rlike(backs)), F.lit(0))
        quote = F.concat(F.lit(f'{label}: "'), first_chars(squeeze(first), quote_chars), F.lit('..."'))
        return F.coalesce(quote, F.lit(f"{label}: mentioned (verify manually)"))

    return F.when(
        col(text).rlike(pattern), let(trimmed(contexts(text, pattern)), note)
    )


def support_summary(text: Column | str, ascii_boundary: bool = False, limit: int | None = None) -> Column:
    notes = [
        support_note(text, label, terms, ascii_boundary)
        for label, terms in fixed.SUPPORT_TERMS.items()
    ]
    return F.array_join(first_items(present(F.array(*notes)), limit), "; ")


def join_comments(*parts: Column) -> Column:
    """the non-empty parts joined by `` | ``, or the default text."""
    joined = F.array_join(present(F.array(*parts)), " | ")
    return first_present(joined, F.lit(fixed.EMPTY_RESEARCH_COMMENT))


def fetch_failure_comment(kind: Column | str, url: Column | str, detail: Column | str) -> Column:
    """comment for a page that could not be read."""
    k, u, d = F.lower(col(kind)), col(url), col(detail)
    cut = lambda n: F.concat(F.left(u, F.lit(n)), F.lit("..."))
    return (
        F.when(F.contains(k, F.lit("timeout")), F.concat(F.lit("Timeout: "), cut(30), F.lit(" took too long")))
        .when(contains_any(k, ["connection", "refused"]),
              F.concat(F.lit("Connection error: Could not reach "), cut(30)))
        .when(contains_any(k, ["403", "401"]), F.concat(F.lit("Access denied: "), cut(30), F.lit(" requires auth")))
        .when(F.contains(k, F.lit("404")), F.concat(F.lit("Not found: "), cut(30), F.lit(" may be deleted")))
        .otherwise(F.concat(F.lit("Research error: "), F.left(d, F.lit(80))))
    )


# --- F18: transcripts -------------------------------------------------------

def clean_transcript(text: Column | str, joiner: str = " ", ascii_boundary: bool = False) -> Column:
    """spoken text of a caption file.

    The repeated-line rule (W9) compares neighbours in the array of kept lines,
    so no window and no shuffle is needed.  A line is compared before its tags
    are removed.
    """
    lines = F.transform(
        F.split(F.regexp_replace(col(text), r"\r\n?", "\n"), "\n"),
        lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""),
    )
    spoken = F.filter(
        lines,
        lambda x: (x != "")
        & ~F.contains(x, F.lit("-->"))
        & ~x.rlike(r"^\d+$")
        & ~starts_with_any(x, fixed.TRANSCRIPT_HEADERS),
    )
    untagged = F.transform(
        drop_repeats(spoken), lambda x: F.regexp_replace(x, r"<[^>]+>", "")
    )
    return strip_fillers(F.array_join(untagged, joiner), ascii_boundary)


def drop_repeats(lines: Column) -> Column:
    """Drop elements equal to the one before."""
    return let(
        lines, lambda every: F.filter(every, lambda x, i: (i == 0) | (x != F.get(every, i - 1)))
    )


def strip_fillers(text: Column | str, ascii_boundary: bool = False) -> Column:
    out = col(text)
    for p in fixed.FILLER_PATTERNS:
        out = F.regexp_replace(out, bounded(p, ascii_boundary), "")
    out = F.regexp_replace(out, "  +", " ")
    return F.regexp_replace(out, r" ([,.])", "$1")


# --- F19-F22: spoken forms and summaries ------------------------------------

def spoken_headline(text: Column | str) -> Column:
    """headline with source marks removed and abbreviations written out."""
    out = col(text)
    for s in fixed.SPOKEN_SUFFIXES:
        out = F.trim(F.replace(out, F.lit(s), F.lit("")))
    out = F.regexp_replace(out, r"\s*\(\s*$", "")
    for old, new in fixed.SPOKEN_REPLACEMENTS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(out, "  +", " "))


def spoken_title(text: Column | str) -> Column:
    """title without symbols that read badly."""
    out = col(text)
    for old, new in fixed.TITLE_REPLACEMENTS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return squeeze(F.regexp_replace(out, f"[{fixed.TITLE_EMOJI}]", ""))


def sentences(text: Column | str) -> Column:
    """split after ``.``, ``!`` or ``?`` followed by white space."""
    return F.filter(trimmed(F.split(col(text), r"(?<=[.!?])\s+")), lambda s: s != "")


def after_marker(text: Column | str) -> Column:
    """what follows the first prompt marker that occurs, else null."""
    t = col(text)
    hits = [
        F.when(
            F.contains(t, F.lit(m)),
            F.substr(t, F.locate(m, t) + len(m)),
        )
        for m in fixed.PROMPT_MARKERS
    ]
    return F.coalesce(*hits)


def extractive_summary(text: Column | str, limit: int | None = None) -> Column:
    """the sentences, or the first of them, that are longer than 20 characters."""
    t = F.regexp_replace(col(text), r"^\s+|\s+$", "")
    for p in fixed.INTRO_PATTERNS:
        t = F.regexp_replace(t, "(?i)" + p, "")
    kept = F.filter(F.split(t, r"(?<=[.!?])\s+"), lambda s: F.length(s) > 20)

    def whole(joined: Column) -> Column:
        # Position of the last full stop, counted from the front.
        last = F.length(joined) - F.locate(".", F.reverse(joined)) + 1
        cut = F.contains(joined, F.lit(".")) & (last - 1 > F.floor(F.length(joined) / 2))
        return F.when(
            (joined != "") & ~joined.rlike(r"[.!?]$") & cut, F.left(joined, last.cast("int"))
        ).otherwise(joined)

    return let(F.array_join(first_items(kept, limit), " "), whole)


def digest_seconds(text: Column | str) -> Column:
    """Spoken length estimate, three seconds per sentence plus one minute."""
    return F.size(sentences(text)) * 3 + 60


# --- F24, F27: sizes --------------------------------------------------------

def token_estimate(text: Column | str) -> Column:
    return F.floor(F.length(col(text)) / fixed.CHARS_PER_TOKEN)


def route_by_size(text: Column | str, small: str = "remote", large: str = "local") -> Column:
    """which text model goes first."""
    return F.when(token_estimate(text) <= fixed.ROUTE_TOKENS, f"{small},{large}").otherwise(
        f"{large},{small}"
    )


def length_class(text: Column | str) -> Column:
    """``long`` when reading the text aloud takes more than half an hour."""
    minutes = F.size(words(text)) / fixed.WORDS_PER_MINUTE
    return F.when(minutes > fixed.LONG_MINUTES, "long").otherwise("short")


def keep_or_summarise(text: Column | str, summary: Column | str, most: int | None = None) -> Column:
    """Short text as it is, else its summary, else the text, cut where there is a limit."""
    t = col(text)
    cut = t
    if most is not None:
        cut = F.when(F.length(t) > most, F.concat(F.left(t, F.lit(most)), F.lit("..."))).otherwise(t)
    return F.when(F.length(t) < fixed.SHORT_TEXT_CHARS, t).otherwise(F.coalesce(col(summary), cut))


# --- predicates -------------------------------------------------------------

def is_chart_topic(title: Column | str, ascii_boundary: bool = False) -> Column:
    """Chart-trading titles."""
    t = col(title)

    def named(low: Column) -> Column:
        # A pattern is only tried on texts that hold all its letters.
        return any_of(
            reduce(lambda a, b: a & b, [F.contains(low, F.lit(part)) for part in _literals(p)])
            & t.rlike("(?iu)" + bounded(p, ascii_boundary))
            for p in fixed.CHART_TOPIC_PATTERNS
        )

    return contains_any(F.lower(t), fixed.CHART_TOPIC_KEYWORDS) | let(_folded(t), named)


def _literals(pattern: str) -> list[str]:
    """Stretches of lower-cased letters and blanks that every match of a simple pattern holds,
    longest first."""
    always = re.sub(r"\([^)]*\)\?", "|", pattern).replace(r"\b", "|")
    return sorted((p.lower() for p in re.findall("[A-Za-z ]+", always)), key=len, reverse=True)


# Letters that equal ASCII ones when case is ignored by Unicode, but not in lower case.
_FOLDS = {"\u017f": "s", "\u0131": "i", "\u0130": "i", "\u212a": "k"}


def _folded(text: Column) -> Column:
    """Lower case in which ASCII letters stand wherever a pattern without case would match them."""
    odd = any_of(F.contains(text, F.lit(c)) for c in _FOLDS)
    return F.lower(F.when(odd, F.translate(text, "".join(_FOLDS), "".join(_FOLDS.values()))).otherwise(text))


def is_suppressed_topic(
    title: Column | str,
    source: Column | str,
    sources: Iterable[str] = fixed.SUPPRESSED_SOURCES,
    topic: str = fixed.SUPPRESSED_TOPIC,
    ascii_boundary: bool = False,
) -> Column:
    """A topic that is not wanted from certain sources."""
    hay = F.replace(F.lower(col(source)), F.lit(" "), F.lit(""))
    return contains_any(hay, sources) & col(title).rlike("(?iu)" + bounded(topic, ascii_boundary))


def is_navigation(text: Column | str) -> Column:
    """Navigation, promotion or a section header."""
    raw = col(text)
    t = F.trim(F.lower(raw))
    return (
        F.array_contains(strings(fixed.NAV_WORDS), t)
        | ((F.length(raw) < 15) & ~F.contains(raw, F.lit(" ")))
        | contains_any(t, fixed.PROMO_PHRASES)
        | starts_with_any(t, fixed.SECTION_HEADERS)
    )


def is_market_line(line: Column | str) -> Column:
    """A line of market data."""
    t = F.lower(col(line))
    return (
        (F.length(col(line)) > 20)
        & ~contains_any(t, fixed.MARKET_SKIP_WORDS)
        & contains_any(t, fixed.MARKET_WORDS)
    )


def strip_suffixes(text: Column | str, suffixes: Iterable[str] = fixed.HEADLINE_SUFFIXES) -> Column:
    out = col(text)
    for s in suffixes:
        out = F.trim(F.replace(out, F.lit(s), F.lit("")))
    return out


def is_truncated(text: Column | str, endings: Iterable[str] = fixed.TRUNCATED_ENDINGS) -> Column:
    return ends_with_any(text, endings)


def is_headline(line: Column | str) -> Column:
    """At least five words or a source mark at the end, and not cut off."""
    t = col(line)
    clean = strip_suffixes(t)
    return (
        (F.length(t) >= 20)
        & ~contains_any(F.lower(t), fixed.ROUNDUP_SKIP_WORDS)
        & (has_words(t, 5) | t.rlike(fixed.HEADLINE_SOURCE_PATTERN))
        & ~is_truncated(clean)
        & (F.length(clean) >= 15)
    )


def is_speakable(title: Column | str) -> Column:
    """P20: fit for the digest: long enough, no junk phrase, not cut off."""
    t = F.trim(col(title))
    return (
        t.isNotNull()
        & (F.length(t) >= 10)
        & ~contains_any(F.lower(t), fixed.DIGEST_SKIP_PHRASES)
        & ~ends_with_any(t, fixed.TRUNCATED_ENDINGS_DIGEST)
        & (F.length(spoken_headline(t)) > 10)
    )


def is_linked_headline(text: Column | str) -> Column:
    """P20: fit as a linked headline."""
    t = col(text)
    low = F.lower(t)
    return (
        (F.length(t) >= 10)
        & ~contains_any(low, fixed.LINKED_SKIP_PHRASES)
        & ~is_truncated(t)
        & ~F.trim(low).isin(fixed.SOURCE_ONLY_HEADLINES)
        & has_words(t, 4)
    )


def linked_headline(link_text: Column | str, parent_text: Column | str) -> Column:
    """a short link text gives way to its parent text without source names."""
    a, p = col(link_text), col(parent_text)
    out = strip_suffixes(p, fixed.LINKED_SUFFIXES)
    out = F.trim(F.regexp_replace(out, r"\s*\(\s*\)\s*$", ""))
    out = F.trim(F.regexp_replace(out, r"\s*\($", ""))
    return F.when((F.length(a) < 20) & (F.length(p) > F.length(a) + 5), out).otherwise(a)


def is_model_skip(summary: Column | str) -> Column:
    """The model said the video should be skipped."""
    s = F.trim(col(summary))
    return F.startswith(s, F.lit("SKIP_TA")) | (
        F.startswith(s, F.lit("Skipped")) & F.contains(F.lower(s), F.lit("technical analysis"))
    )


def is_researchable(
    category: Column | str,
    url: Column | str,
    matched: Column | str,
    categories: Iterable[str] = fixed.RESEARCH_CATEGORIES,
    all_items: bool = False,
    only_unmatched: bool = True,
) -> Column:
    """Items whose article is worth reading."""
    c = F.coalesce(F.lower(col(category)), F.lit(""))
    test = ~contains_any(c, fixed.RESEARCH_EXCLUDED) & F.coalesce(
        F.startswith(col(url), F.lit("http")), F.lit(False)
    )
    if not all_items:
        test = test & contains_any(c, [x.lower() for x in categories])
    if only_unmatched:
        test = test & ~F.coalesce(col(matched), F.lit(False))
    return test


def is_blank_row(*cells: Column | str) -> Column:
    """P25: every cell is empty or ``FALSE``."""
    return ~F.exists(
        F.array(*[F.coalesce(F.trim(col(c)), F.lit("")) for c in cells]),
        lambda c: (c != "") & (F.upper(c) != "FALSE"),
    )


def needs_matching(skip: Column | str, matched: Column | str, url: Column | str) -> Column:
    """Rows that wait for entity matching."""
    up = lambda c: F.coalesce(F.upper(F.trim(col(c))), F.lit(""))
    return (up(skip) != "TRUE") & ~up(matched).isin("TRUE", "FALSE") & (up(url) != "")
