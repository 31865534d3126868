"""HTML expressions: F1-F5, F7, F16, F28 and the block sequence behind C1 and C5.

A page is one bounded value, so everything that needs order inside a page works
on an array within the row: nothing is exploded and shuffled to find out which
header a link stands under.
"""

from __future__ import annotations

from collections.abc import Iterable
from html.entities import html5

from pyspark.sql import Column, functions as F

from newsmill import fixed
from newsmill.functions.arrays import (
    any_of, col, first_chars, first_items, first_present, let, lookup, squeeze,
)
from newsmill.functions.urls import netloc, title_case

_OPEN, _SHUT = "\x01", "\x02"


def landed(html: Column | str, cap: int | None = None) -> Column:
    """S3: body of a landed page, or its first ``cap`` characters."""
    return first_chars(html, cap)


def drop_elements(html: Column | str, tags: Iterable[str] = fixed.BOILERPLATE_TAGS) -> Column:
    """Remove elements with their content."""
    names = "|".join(tags)
    return F.regexp_replace(col(html), rf"(?is)<({names})\b[^>]*>.*?</\1\s*>", " ")


def drop_comments(html: Column | str) -> Column:
    drop = lambda h: F.regexp_replace(h, r"(?s)<!--.*?-->", " ")
    return let(col(html), lambda h: F.when(F.contains(h, F.lit("<!--")), drop(h)).otherwise(h))


# All names of the standard, as one literal; those of the fixed table come first.
_NAMES = {f"&{name}": chars for name, chars in html5.items()}
_BARE = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
_REFERENCE = rf"(&#[0-9]+;?|&#[xX][0-9A-Fa-f]+;?|&[A-Za-z][A-Za-z0-9]*;|&(?:{_BARE})|[^&]+|&)"
# Numbers 128 to 159 mean the characters of an older code page.
_OLD = {chr(n): bytes([n]).decode("cp1252", "ignore") for n in range(128, 160)}
_OLD = {old: new for old, new in _OLD.items() if new}


def _by_number(reference: Column) -> Column:
    """The character of a decimal or hexadecimal reference."""
    hexed = F.regexp_extract(reference, "^&#[xX]0*([0-9A-Fa-f]+)", 1)
    # A number of more than eight digits is no character, and conv fails beyond 64 bits.
    number = F.when(hexed == "", F.regexp_extract(reference, "^&#([0-9]+)", 1)).when(F.length(hexed) <= 8, F.conv(hexed, 16, 10)).try_cast("long")
    known = (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    code = F.unhex(F.lpad(F.hex(F.when(known, number).otherwise(0xFFFD)), 8, "0"))
    return F.translate(F.decode(code, "UTF-32"), "".join(_OLD), "".join(_OLD.values()))


def unescape(text: Column | str) -> Column:
    """Decode character references, by name, with or without the semicolon where the standard has
    both, and by decimal or hexadecimal number; each is read once.  Unknown ones stay."""
    common = lookup(dict(fixed.CHARACTER_ENTITIES))
    every = F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in _NAMES.items())), F.lit("\x01"), F.lit("\x02"))
    decoded = lambda t: F.transform(
        F.regexp_extract_all(t, F.lit(_REFERENCE), F.lit(1)),
        lambda p: F.when(~F.startswith(p, F.lit("&")) | (F.length(p) == 1), p)
        .when(F.startswith(p, F.lit("&#")), _by_number(p))
        .otherwise(F.coalesce(F.try_element_at(common, p), F.try_element_at(every, p), p)),
    )
    return let(col(text), lambda t: F.when(F.contains(t, F.lit("&")), F.array_join(decoded(t), "")).otherwise(t))


def plain_text(html: Column | str, separator: str = " ") -> Column:
    """Text of a fragment, tags replaced by ``separator``, white space collapsed."""
    return squeeze(unescape(F.regexp_replace(col(html), r"(?s)<[^>]*>", separator)))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in a start tag."""
    raw = F.regexp_extract(
        tag, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", 1
    )
    return unescape(F.regexp_replace(raw, r"""^["']|["']$""", ""))


def element(html: Column, tag: str) -> Column:
    """Content of the first element of this name; an unclosed one reaches to the end."""
    return F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)(?:</{tag}\s*>|$)", 1)


def start_tag(html: Column, tag: str, condition: str = "") -> Column:
    """First start tag of this name whose attributes match ``condition``."""
    return F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*{condition}[^>]*>", 0)


# --- F1 ---------------------------------------------------------------------

_ANCHOR = r"""(?is)<a\b[^>]*?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)[^>]*>(.*?)</a\s*>"""


def links(html: Column | str) -> Column:
    """``array<struct<href, text, inner>>`` in document order."""
    h = drop_comments(html)
    hrefs = F.regexp_extract_all(h, F.lit(_ANCHOR), F.lit(1))
    inner = F.regexp_extract_all(h, F.lit(_ANCHOR), F.lit(2))
    return F.transform(
        F.arrays_zip(hrefs.alias("href"), inner.alias("inner")),
        lambda a: F.struct(
            F.trim(unescape(F.regexp_replace(a["href"], r"""^["']|["']$""", ""))).alias("href"),
            plain_text(a["inner"], "").alias("text"),
            a["inner"].alias("inner"),
        ),
    )


# --- blocks -----------------------------------------------------------------

def may_link(html: Column | str) -> Column:
    """Whether a block of :func:`blocks` can hold an anchor; the dropped marks may have stood inside one."""
    h = col(html)
    return F.contains(F.lower(h), F.lit("<a")) | F.contains(h, F.lit(_OPEN)) | F.contains(h, F.lit(_SHUT))


def blocks(html: Column | str, tags: Iterable[str] = ("h1", "h2", "h3", "h4", "p", "li")) -> Column:
    """Headings, paragraphs and list items: ``array<struct<pos, tag, body, text>>``.

    A block reaches from its start tag to the next start or end tag of the same
    set.  That is a position-based restatement of the element tree, and it does
    not depend on end tags being there.
    """
    names = "|".join(tags)
    # translate goes character by character, so only where there is one to drop
    bare = let(
        drop_comments(html),
        lambda h: F.when(F.contains(h, F.lit(_OPEN)) | F.contains(h, F.lit(_SHUT)), F.translate(h, _OPEN + _SHUT, "")).otherwise(h),
    )
    marked = F.regexp_replace(
        bare,
        rf"(?i)<({names})(?:\s[^>]*)?>",
        f"{_OPEN}$1{_SHUT}",
    )
    pieces = F.split(marked, _OPEN)
    rest = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.transform(
        F.transform(
            rest,
            lambda p: F.struct(
                F.lower(F.substring_index(p, _SHUT, 1)).alias("tag"),
                F.regexp_replace(
                    F.substring_index(p, _SHUT, -1), rf"(?is)</(?:{names})\s*>.*$", ""
                ).alias("body"),
            ),
        ),
        lambda b, i: F.struct(
            i.alias("pos"),
            b["tag"].alias("tag"),
            b["body"].alias("body"),
            plain_text(b["body"]).alias("text"),
        ),
    )


def with_sections(
    block_array: Column,
    is_header,
    default: str = "General",
) -> Column:
    """W2 inside a page: every non-header block with the text of the last header before it."""
    def place(headers: Column) -> Column:
        def section(b: Column) -> Column:
            before = F.filter(headers, lambda h: h["pos"] < b["pos"])
            return F.coalesce(F.try_element_at(before, F.lit(-1))["text"], F.lit(default))

        return F.transform(
            F.filter(block_array, lambda b: ~is_header(b)),
            lambda b: F.struct(
                b["pos"].alias("pos"),
                b["tag"].alias("tag"),
                b["body"].alias("body"),
                b["text"].alias("text"),
                section(b).alias("section"),
            ),
        )

    return let(F.filter(block_array, is_header), place)


def is_heading(b: Column) -> Column:
    """A heading that sets the category: not empty, shorter than 100 characters."""
    return F.startswith(b["tag"], F.lit("h")) & (b["text"] != "") & (F.length(b["text"]) < 100)


def link_context(block_text: Column | str, cap: int | None = None) -> Column:
    """text around a link."""
    return first_chars(squeeze(block_text), cap)


# --- F2, F3, F4 -------------------------------------------------------------

def _content(html: Column, tags: Iterable[str]) -> Column:
    return let(html, lambda h: first_present(*[element(h, t) for t in tags], h))


_CONTAINERS = ["article", *fixed.CONTENT_CLASSES, "main", "body"]
_TOKEN = r"(?s)(</?[A-Za-z][^>]*(?:>|\z)|<[!?][^>]*(?:>|\z)|[^<]+|<)"
# tokens folded at a time; what they add to the text is appended once
_FOLDED = 256


def _class_test(tag: Column, attributes: str, names: Iterable[str]) -> Column:
    any_name = "|".join(names)
    return tag.rlike(
        rf"""(?is)\s(?:{attributes})\s*=\s*(?:"[^"]*(?:{any_name})[^"]*"|'[^']*(?:{any_name})[^']*'|[^\s"'>]*(?:{any_name}))"""
    )


def _page_token(t: Column) -> Column:
    """(name, opens, shuts, removed, rank, text) of a tag or a stretch of text; rank: the place of a
    container in the order of preference."""
    name = F.lower(F.regexp_extract(t, "^</?([A-Za-z][^\\s/>]*)", 1))
    none = F.lit(len(_CONTAINERS))

    def of_tag(n: Column) -> Column:
        shuts = F.startswith(t, F.lit("</"))
        opens = ~shuts & (n != "") & ~n.isin(fixed.VOID_TAGS) & ~F.endswith(t, F.lit("/>"))
        marked = F.when(opens, _class_test(t, "class|id", fixed.RELATED_MARKS)).otherwise(False)
        rank = F.when(n == "article", 0)
        with_class = F.when(opens & _class_test(t, "class", fixed.CONTENT_CLASSES), t)
        for i, c in enumerate(fixed.CONTENT_CLASSES):
            rank = rank.when(_class_test(with_class, "class", [c]), i + 1)
        for other in ("main", "body"):
            rank = rank.when(n == other, _CONTAINERS.index(other))
        return F.struct(
            n.alias("name"), opens.alias("opens"), shuts.alias("shuts"),
            (n.isin(fixed.BOILERPLATE_TAGS) | marked).alias("removed"), rank.otherwise(none).alias("rank"),
            F.lit("").alias("text"),
        )

    words = F.struct(
        F.lit("").alias("name"), F.lit(False).alias("opens"), F.lit(False).alias("shuts"), F.lit(False).alias("removed"),
        none.alias("rank"), t.alias("text"),
    )
    return F.when(F.startswith(t, F.lit("<")) & (F.length(t) > 1), let(name, of_tag)).otherwise(words)


def _folded(tokens: Column) -> Column:
    """Text of the first container of the best kind, outside removed elements.

    One pass with the stack of open elements: ``hidden`` of them are removed ones, ``best`` is the
    rank of the container that is read, ``floor`` the height of the stack inside it (0: the
    whole page, -1: it has ended)."""
    kinds = "array<struct<name: string, removed: boolean>>"

    def state(stack, hidden, best, floor, text, fresh) -> Column:
        return F.struct(
            stack.cast(kinds).alias("stack"), hidden.cast("int").alias("hidden"), best.cast("int").alias("best"),
            floor.cast("int").alias("floor"), text.alias("text"), fresh.alias("fresh"),
        )

    def step(s: Column, t: Column) -> Column:
        hidden = s["hidden"] + t["removed"].cast("int")
        begins = (t["rank"] < s["best"]) & (hidden == 0)
        opened = state(
            F.concat(s["stack"], F.array(F.struct(t["name"].alias("name"), t["removed"].alias("removed")))), hidden,
            F.when(begins, t["rank"]).otherwise(s["best"]), F.when(begins, F.size(s["stack"]) + 1).otherwise(s["floor"]),
            F.when(begins, F.lit("")).otherwise(s["text"]), begins | s["fresh"],
        )

        def shut(at: Column) -> Column:
            left = F.slice(s["stack"], F.lit(1), at)
            ended = s["floor"] > at
            return state(
                left, F.size(F.filter(left, lambda e: e["removed"])), s["best"],
                F.when(ended, -1).otherwise(s["floor"]), s["text"], s["fresh"],
            )

        # the innermost open element of the name; 0 where there is none
        at = F.size(s["stack"]) - F.array_position(F.reverse(s["stack"]["name"]), t["name"])
        has = F.array_contains(s["stack"]["name"], t["name"])
        shown = (s["hidden"] == 0) & (s["floor"] >= 0)
        said = state(
            s["stack"], s["hidden"], s["best"], s["floor"],
            F.when(shown, F.concat(s["text"], F.lit(" "), t["text"])).otherwise(s["text"]), s["fresh"],
        )
        return (
            F.when(t["opens"], opened).when(t["shuts"] & has, let(at.cast("int"), shut)).when(t["text"] != "", said).otherwise(s)
        )

    start = state(F.array(), F.lit(0), F.lit(len(_CONTAINERS)), F.lit(0), F.lit(""), F.lit(False))

    def stretch(s: Column, block: Column) -> Column:
        empty = state(s["stack"], s["hidden"], s["best"], s["floor"], F.lit(""), F.lit(False))
        return let(
            F.aggregate(block, empty, step),
            lambda e: state(
                e["stack"], e["hidden"], e["best"], e["floor"],
                F.when(e["fresh"], e["text"]).otherwise(F.concat(s["text"], e["text"])), F.lit(False),
            ),
        )

    starts = F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1)), F.lit(_FOLDED))
    return F.aggregate(F.transform(starts, lambda i: F.slice(tokens, i, F.lit(_FOLDED))), start, stretch, lambda s: s["text"])


def article_text(html: Column | str, cap: int | None = None) -> Column:
    """the text of the article, else of the first element with a content class, of ``main``, of
    the body, of the page; without navigation, forms and the like, and without elements that a
    class or id marks as related matter.  Every page goes the same way."""
    clean = drop_elements(drop_comments(html), ["script", "style"])
    tokens = F.transform(F.regexp_extract_all(clean, F.lit(_TOKEN), F.lit(1)), _page_token)
    return first_chars(squeeze(unescape(let(tokens, _folded))), cap)


def paragraphs(html: Column | str, min_chars: int = 50) -> Column:
    """texts of the paragraphs longer than ``min_chars``."""
    body = drop_elements(
        drop_comments(html), ["script", "style", "nav", "header", "footer", "aside", "iframe"]
    )
    content = _content(body, ["article", "main", "body"])
    texts = F.transform(
        F.filter(blocks(content, ("p",)), lambda b: b["tag"] == "p"), lambda b: b["text"]
    )
    return F.filter(texts, lambda t: F.length(t) > min_chars)


def paragraph_text(html: Column | str) -> Column:
    return F.array_join(paragraphs(html), "\n\n")


def text_lines(html: Column | str) -> Column:
    """trimmed, non-empty lines; ``<br>``, block ends and tags break lines."""
    broken = lambda h: F.regexp_replace(h, r"(?i)<br\s*/?>", "\n")
    text = let(
        drop_comments(html),
        lambda h: F.when(any_of(F.contains(h, F.lit(b)) for b in ("<br", "<BR", "<Br", "<bR")), broken(h)).otherwise(h),
    )
    text = F.regexp_replace(text, r"(?s)<[^>]*>", "\n")
    lines = F.transform(F.split(unescape(text), "\n"), squeeze)
    return F.filter(lines, lambda x: x != "")


def leading_lines(html: Column | str, lines: int | None = None, cap: int | None = None) -> Column:
    """the lines of a page, or its first ones, as one text."""
    body = drop_elements(
        html, ["script", "style", "nav", "header", "footer", "aside"]
    )
    content = _content(body, ["article", "body"])
    return first_chars(F.array_join(first_items(text_lines(content), lines), "\n"), cap)


# --- F7, F16 ----------------------------------------------------------------

def _meta(html: Column, key: str) -> Column:
    tag = start_tag(html, "meta", rf"""(?:property|name)\s*=\s*["']?{key}["'\s/>]""")
    return attribute(tag, "content")


def page_title(html: Column | str) -> Column:
    return plain_text(element(col(html), "title"), "")


def site_name(html: Column | str, url: Column | str) -> Column:
    """site name tag, else the title before ``|``, else the first host label."""
    h = col(html)
    title = F.trim(F.substring_index(page_title(h), "|", 1))
    return first_present(
        _meta(h, "og:site_name"), title, title_case(F.substring_index(netloc(url), ".", 1))
    )


def page_name(html: Column | str, url: Column | str, cap: int | None = None) -> Column:
    """F7, generic: site name tag, else the title, else the host."""
    h = col(html)
    return first_present(
        _meta(h, "og:site_name"), first_chars(page_title(h), cap), netloc(url)
    )


def _day(text: Column) -> Column:
    return F.when(F.length(text) >= 10, F.left(text, F.lit(10)))


def _class_text(html: Column, mark: str) -> Column:
    """Text of the first element whose class holds ``mark``, up to the next tag that closes it."""
    return plain_text(
        F.regexp_extract(
            html,
            rf"""(?is)<([a-z][a-z0-9]*)\b[^>]*\sclass\s*=\s*["']?[^"'>]*{mark}[^>]*>(.*?)</\1\s*>""",
            2,
        )
    )


def published_day(html: Column | str, url: Column | str) -> Column:
    """F16: day of a page as ``yyyy-MM-dd``, from the most to the least reliable carrier."""
    h = col(html)
    time_tag = start_tag(h, "time")
    script = F.regexp_extract(
        h,
        r"""(?is)<script\b[^>]*type\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script\s*>""",
        1,
    )
    class_text = _class_text(h, "date")
    numeric = F.regexp_extract(class_text, fixed.NUMERIC_DATE_PATTERN, 1)
    month = F.regexp_replace(F.regexp_extract(class_text, fixed.MONTH_DATE_PATTERN, 1), ",", "")
    month_day = F.coalesce(
        F.try_to_timestamp(month, F.lit("MMMM d yyyy")), F.try_to_timestamp(month, F.lit("MMM d yyyy"))
    )
    return first_present(
        _day(_meta(h, "article:published_time")),
        _day(_meta(h, "og:published_time")),
        _day(attribute(time_tag, "datetime")),
        F.replace(
            F.regexp_extract(plain_text(element(h, "time")), fixed.NUMERIC_DATE_PATTERN, 1),
            F.lit("/"), F.lit("-"),
        ),
        F.regexp_extract(col(url), r"/p/(\d{4}-\d{2}-\d{2})", 1),
        _day(F.get_json_object(script, "$.datePublished")),
        F.left(F.replace(numeric, F.lit("/"), F.lit("-")), F.lit(10)),
        F.date_format(month_day, "yyyy-MM-dd"),
    )


def newsletter_date_text(html: Column | str) -> Column:
    """F16, newsletter form: the raw date text of an issue."""
    h = col(html)
    # Read once, and only where no mark-up tells the date.
    visible = let(
        plain_text(drop_elements(h, ["script", "style"])),
        lambda v: first_present(*[F.regexp_extract(v, p, 1) for p in (fixed.ISSUE_DATE_PATTERN, r"(\d{1,2}/\d{1,2}/\d{4})", r"(\d{4}-\d{2}-\d{2})")]),
    )
    metas = [_meta(h, k) for k in ("article:published_time", "date", "og:published_time")]
    classes = [_class_text(h, m) for m in fixed.DATE_CLASS_MARKS]
    # Each kind of mark-up is searched only in pages that hold its word.
    return let(
        F.lower(h),
        lambda low: F.coalesce(
            F.when(F.contains(low, F.lit("<time")), first_present(attribute(start_tag(h, "time"), "datetime"), plain_text(element(h, "time")))),
            F.when(F.contains(low, F.lit("<meta")), first_present(*metas)),
            F.when(F.contains(low, F.lit("class")), first_present(*classes)),
            visible,
        ),
    )


# --- F28 --------------------------------------------------------------------

def keyword_section(text: Column, default: str | None = "General") -> Column:
    """section named by a heading text, by the keyword map."""
    hit = None
    for key, name in fixed.SECTION_KEYWORDS.items():
        test = F.contains(text, F.lit(key))
        hit = F.when(test, name) if hit is None else hit.when(test, name)
    return hit.otherwise(F.lit(default).cast("string"))


def training_section(text: Column) -> Column:
    """section of a training link, compared without case."""
    hit = None
    for name in fixed.TRAINING_SECTIONS:
        test = F.contains(F.lower(text), F.lit(name.lower()))
        hit = F.when(test, name) if hit is None else hit.when(test, name)
    return hit.otherwise("Unknown")
