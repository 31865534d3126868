"""Main text of web pages: blocks labelled content or boilerplate by a minimum cut.

A page becomes text blocks with their place in the element tree.  A classifier says what a block
costs as content and as boilerplate; these are its capacities to the two terminals.  Blocks that
follow each other, and blocks under one parent, are tied by edges that weigh more the nearer they
are in the tree.  The cheapest labelling is a minimum cut.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from newsmill.llm.common import pick

# Elements and names of the web.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section "
    "summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
UNSEEN = frozenset("head noscript template svg math canvas object select datalist audio video map".split())
SIDE = frozenset("nav footer aside menu dialog button search".split())
MAIN = frozenset("article main".split())
SIDE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert toolbar".split()
)
SIDE_NAMES = frozenset(
    "ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments "
    "commentlist consent cookie cookies copyright disclaimer discussion disqus footer gdpr login masthead menu menus modal "
    "nav navbar navigation newsletter notice notices notification pager pagination paywall popup promo promotion "
    "recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription teaser toolbar topbar widget widgets".split()
)
MAIN_NAMES = frozenset("article articlebody content entry main post story".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# an element of the first kind ends an open element of the second, up to the bound
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
}
ENDS_P = BLOCKS - frozenset("body html caption dd dt li legend tbody td tfoot th thead tr".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in RAW}
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
SENTENCE_END = tuple(".!?:;\"'…。！？»”’")

# Weights of marks, in the classifier's log-odds.
IN_SIDE, IN_MAIN, OUT_OF_MAIN, IN_HEADER = -8.0, 6.0, -4.0, -1.0
SHAPE_BOUND = 3.0
# Smoothness edges in the same unit: NEAR / 2 ^ (tree distance) between blocks that follow each
# other, SIBLING between a block and the last one under its parent.
NEAR, SIBLING = 3.6, 0.4
UNIT = 1000

LENGTHS, DENSITIES, KINDS = 16, 5, 4
FEATURES = LENGTHS + DENSITIES + 2 + KINDS


class Block(NamedTuple):
    text: str
    parent: int  # the element around the block's own
    gap: int  # tree distance to the block before
    side: bool
    main: bool
    header: bool
    form: int  # the outermost form, 0 if none
    length: int
    density: int
    ended: int
    kind: int


class _Node(NamedTuple):
    tag: str
    place: int
    block: bool
    link: bool
    unseen: bool
    side: bool
    main: bool
    header: bool
    form: int
    kind: int


ROOT = _Node("", 0, True, False, False, False, False, False, 0, 0)


def _marks(tag: str, text: str) -> tuple[bool, bool]:
    """(side, main) by the element's name, role, class and id."""
    side, main = tag in SIDE, tag in MAIN
    if not text.strip(" /"):
        return side, main
    names: set[str] = set()
    for name, *values in ATTRIBUTE.findall(text):
        name, value = name.lower(), html.unescape(next((v for v in values if v), ""))
        if name in ("class", "id"):
            for word in value.split():
                parts = [p.lower() for p in PART.findall(word)]
                names.update(p for before, p in zip(["", *parts], parts) if before not in ("has", "with", "no"))
        elif name == "role":
            side |= value.lower() in SIDE_ROLES
            main |= value.lower() in ("main", "article")
        elif name == "itemprop":
            main |= value.lower() == "articlebody"
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            side = True
        elif name == "style":
            side |= bool(re.search(r"display\s*:\s*none", value, re.I))
    if tag in ("html", "body"):
        return False, False
    mains = names & MAIN_NAMES
    return side or bool(names & SIDE_NAMES) or ("header" in names and not mains), main or bool(mains)


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, in one pass.

    Blocks part where an element that is set as a block begins or ends.  Character references
    are decoded and white space is one space.  Unclosed and stray tags are read as browsers do:
    a block ends an open paragraph, an item the item before it."""
    found: list[Block] = []
    stack, places = [ROOT], 0
    open_tags: dict[str, int] = {}
    words: list[tuple[str, bool]] = []
    low = 1

    def close() -> None:
        nonlocal low
        if not words:
            return
        raw = "".join(t for t, _ in words)
        text = " ".join(raw.split())
        linked = sum(len(t) for t, link in words if link)
        words.clear()
        if not text:
            return
        at = len(stack) - 1
        while not stack[at].block:
            at -= 1
        low = min(low, at + 1)
        own = stack[at]
        gap = (at + 1 - low) + (before[0] - low) if found else 0
        density = (DENSITIES - 1) * linked // len(raw)
        found.append(Block(
            text, stack[at - 1].place if at else 0, gap, own.side, own.main, own.header, own.form,
            min(LENGTHS - 1, len(text).bit_length()), density, text.endswith(SENTENCE_END) + 0, own.kind,
        ))
        before[0] = low = at + 1

    before = [1]

    def pop(size: int) -> None:
        nonlocal low
        for n in stack[size:]:
            if n.block:
                close()
                break
        for n in stack[size:]:
            open_tags[n.tag] -= 1
        del stack[size:]
        low = min(low, size)

    def end(tags: tuple, bounds: tuple) -> None:
        """Pops the nearest of the tags, unless a bound is nearer."""
        for t in tags:
            if open_tags.get(t):
                break
        else:
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                pop(i)
                return
            if stack[i].tag in bounds:
                return

    def say(text: str) -> None:
        if text and not stack[-1].unseen:
            words.append((html.unescape(text) if "&" in text else text, stack[-1].link))

    at, size = 0, len(page)
    while at < size:
        token = TOKEN.search(page, at)
        if token is None:
            say(page[at:])
            break
        say(page[at : token.start()])
        at = token.end()
        closing, tag, attributes = token.group(1), token.group(2), token.group(3)
        if tag is None:
            closing, tag, attributes = token.group(4), token.group(5), token.group(6)
            if tag is None:
                continue
        tag = tag.lower()
        if closing:
            if tag == "br":
                say(" ")
            elif open_tags.get(tag):
                end((tag,), ("td", "th", "table") if tag not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "body", "html") else ())
            elif tag in BLOCKS:
                close()
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in ENDS_P:
            end(("p",), ("button", "table", "td", "th", "object"))
        if tag in ENDS:
            end(*ENDS[tag])
        block = tag in BLOCKS
        if block:
            close()
        if tag in VOID:
            continue
        if tag in RAW:
            stop = RAW_ENDS[tag].search(page, at)
            at = stop.end() if stop else size
            continue
        if attributes.endswith("/") and tag in ("svg", "math"):
            continue
        up = stack[-1]
        places += 1
        side, main = _marks(tag, attributes)
        kind = 1 if tag in HEADINGS else 2 if tag in ("li", "dt", "dd") else 3 if tag in ("td", "th") else 0
        outer = tag == "header" and not up.main
        stack.append(_Node(
            tag, places, block, up.link or tag == "a", up.unseen or tag in UNSEEN, up.side or side or outer,
            up.main or main, up.header or tag == "header", up.form or (places if tag == "form" else 0),
            kind if block and kind else (0 if block and tag == "p" and up.kind == 1 else up.kind),
        ))
        open_tags[tag] = open_tags.get(tag, 0) + 1
    close()
    return found


def shape(block: Block) -> tuple[int, int, int, int]:
    """The four places of a block's shape in the weights."""
    return (
        block.length, LENGTHS + block.density, LENGTHS + DENSITIES + block.ended,
        LENGTHS + DENSITIES + 2 + block.kind,
    )


def prior_weights() -> list[float]:
    """Weights before anything is seen: long sentences without links are content."""
    return (
        [0.3 * (i - 6) for i in range(LENGTHS)] + [-1.0 * i for i in range(DENSITIES)] + [-0.5, 0.5] + [0.5, 1.5, -0.5, -0.5]
    )


def _side(found: list[Block]) -> list[bool]:
    """Which blocks stand in a menu, a footer, a form ...; a form around most of the page is none."""
    total = sum(len(b.text) for b in found)
    of_form: dict[int, int] = {}
    for b in found:
        if b.form:
            of_form[b.form] = of_form.get(b.form, 0) + len(b.text)
    return [b.side or bool(b.form and 2 * of_form[b.form] <= total) for b in found]


def costs(found: list[Block], weights: list[float]) -> list[int]:
    """Log-odds of content, in thousandths: marks of the elements around, and the shape."""
    side = _side(found)
    any_main = any(b.main and not s for b, s in zip(found, side))
    out = []
    for b, s in zip(found, side):
        odds = max(-SHAPE_BOUND, min(SHAPE_BOUND, sum(weights[i] for i in shape(b))))
        if s:
            odds += IN_SIDE
        elif b.main:
            odds += IN_MAIN + (IN_HEADER if b.header else 0.0)
        elif any_main:
            odds += OUT_OF_MAIN
        out.append(round(odds * UNIT))
    return out


def ties(found: list[Block]) -> list[tuple[int, int, int]]:
    """Smoothness edges (block, block, capacity)."""
    out, last = [], {}
    for i, b in enumerate(found):
        if i:
            out.append((i - 1, i, round(NEAR * UNIT / 2 ** min(b.gap, 20))))
        if last.get(b.parent, i - 1) != i - 1:
            out.append((last[b.parent], i, round(SIBLING * UNIT)))
        last[b.parent] = i
    return out


def minimum_cut(odds: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which blocks are content in the cheapest labelling; of several, the one with the least content.

    A label costs |odds| where it goes against them, an edge its capacity where its ends differ.  A
    block whose odds outweigh all its edges has its label in every minimum cut: it is taken out
    and its edges become odds of its neighbours.  Max-flow settles the rest."""
    n = len(odds)
    odds, near = list(odds), [[] for _ in range(n)]
    slack = [0] * n
    for a, b, c in edges:
        near[a].append((b, c))
        near[b].append((a, c))
        slack[a] += c
        slack[b] += c
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is not None or abs(odds[i]) <= slack[i]:
            continue
        label[i] = odds[i] > 0
        for j, c in near[i]:
            if label[j] is None:
                odds[j] += c if label[i] else -c
                slack[j] -= c
                todo.append(j)
    left = [i for i in range(n) if label[i] is None]
    if left:
        for i, content in zip(left, _max_flow(left, odds, near, label)):
            label[i] = content
    return label


def _max_flow(left: list[int], odds: list[int], near: list, label: list) -> list[bool]:
    """The source's side of the least minimum cut, by blocking flows in layers."""
    place = {i: k for k, i in enumerate(left)}
    source, sink = len(left), len(left) + 1
    arcs: list[list[int]] = [[] for _ in range(sink + 1)]
    to: list[int] = []
    room: list[int] = []

    def tie(a: int, b: int, there: int, back: int) -> None:
        arcs[a].append(len(to))
        arcs[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for k, i in enumerate(left):
        if odds[i] > 0:
            tie(source, k, odds[i], 0)
        elif odds[i] < 0:
            tie(k, sink, -odds[i], 0)
        for j, c in near[i]:
            if label[j] is None and i < j:
                tie(k, place[j], c, c)
    while True:
        layer = [-1] * (sink + 1)
        layer[source] = 0
        todo = deque([source])
        while todo:
            a = todo.popleft()
            for e in arcs[a]:
                if room[e] and layer[to[e]] < 0:
                    layer[to[e]] = layer[a] + 1
                    todo.append(to[e])
        if layer[sink] < 0:
            return [layer[k] >= 0 for k in range(len(left))]
        turn = [0] * (sink + 1)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                full = next(k for k, e in enumerate(path) if not room[e])
                a = to[path[full] ^ 1]
                del path[full:]
                continue
            while turn[a] < len(arcs[a]):
                e = arcs[a][turn[a]]
                if room[e] and layer[to[e]] == layer[a] + 1:
                    break
                turn[a] += 1
            if turn[a] < len(arcs[a]):
                path.append(e)
                a = to[e]
            elif path:
                e = path.pop()
                a = to[e ^ 1]
                turn[a] += 1
            else:
                break


def main_text(page: str | None, weights: list[float]) -> str:
    """The blocks that the cut calls content, joined by one space; empty if there is none."""
    found = blocks(page or "")
    return " ".join(b.text for b, content in zip(found, minimum_cut(costs(found, weights), ties(found))) if content)


def shape_counts(pages: DataFrame) -> DataFrame:
    """(length, density, ended, kind, content, n): blocks of each shape in menus, footers and the
    like (content false) and in main elements (true).  At most
    2 * 16 * 5 * 2 * 4 rows, counted within a batch and before the shuffle."""

    def each(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            counts: dict[tuple, int] = {}
            for page in batch.column(0):
                found = blocks(page.as_py() or "")
                for b, side in zip(found, _side(found)):
                    if side or b.main:
                        cell = (b.length, b.density, b.ended, b.kind, not side)
                        counts[cell] = counts.get(cell, 0) + 1
            if counts:
                columns = [list(c) for c in zip(*((*cell, n) for cell, n in counts.items()))]
                kinds = [pa.int32()] * 4 + [pa.bool_(), pa.int64()]
                names = ["length", "density", "ended", "kind", "content", "n"]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    shapes = "length int, density int, ended int, kind int, content boolean, n long"
    cell = ["length", "density", "ended", "kind", "content"]
    return pages.select("html").mapInArrow(each, shapes).groupBy(*cell).agg(F.sum("n").alias("n"))


def fit(counts: list[tuple], strength: float = 1.0, weight: float = 500.0) -> list[float]:
    """Logistic weights of block shapes from counted cells, both labels weighing the same.

    Newton steps on the log-likelihood less ``strength`` / 2 times the squared distance to the
    weights before; without blocks of both labels these stay."""
    import numpy as np

    start = np.array(prior_weights())
    totals = {label: sum(n for *_, content, n in counts if content == label) for label in (False, True)}
    if not all(totals.values()):
        return start.tolist()
    x = np.zeros((len(counts), FEATURES))
    for row, (length, density, ended, kind, _, _) in enumerate(counts):
        x[row, [length, LENGTHS + density, LENGTHS + DENSITIES + ended, LENGTHS + DENSITIES + 2 + kind]] = 1
    y = np.array([float(content) for *_, content, _ in counts])
    w = np.array([weight * n / totals[content] for *_, content, n in counts])
    beta = start.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (w * (y - p)) - strength * (beta - start)
        curve = (x * (w * p * (1 - p))[:, None]).T @ x + strength * np.eye(FEATURES)
        move = np.linalg.solve(curve, gradient)
        beta += move / max(1.0, float(np.abs(move).max()))
        if np.abs(move).max() < 1e-9:
            break
    return [round(float(b), 6) for b in beta]


def train(pages: DataFrame, sample: int = 2000) -> list[float]:
    """Weights of block shapes, learnt from the blocks whose elements tell what they are.

    Learns from at most ``sample`` different pages, those with the least hashes; the hash is all
    that the first scan takes from a page.  None of the counts, costs or cuts depends on it
    otherwise."""
    hashed = pages.select(F.xxhash64("html").alias("hash"), "html")
    least = hashed.groupBy("hash").agg(F.lit(1)).orderBy("hash").limit(sample).agg(F.max("hash")).first()[0]
    if least is None:
        return prior_weights()
    once = hashed.where(F.col("hash") <= least).groupBy("hash").agg(F.first("html").alias("html"))
    return fit(sorted(tuple(r) for r in shape_counts(once).collect()))


def extract(
    df: DataFrame, html_col: str = "html", keys: tuple[str, ...] = ("page_id", "url"), weights: list[float] | None = None
) -> DataFrame:
    """(keys, text, n_chars): the main text of every row.

    Null and empty pages give an empty text.  Repeated rows stay.  Columns other than the keys
    are left out.  The weights are learnt from a
    bounded sample of ``df`` unless given.  A page is handled on its own,
    in time and memory that follow its length."""
    pages = df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{html_col}`").alias("_html"))
    if weights is None:
        weights = train(pick(df, html=html_col))
    shared = list(weights)

    def each(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(page.as_py(), shared) for page in batch.column(batch.num_columns - 1)]
            lengths = pa.array([len(t) for t in texts], pa.int64())
            yield pa.record_batch([*batch.columns[:-1], pa.array(texts, pa.string()), lengths], names)

    names = [*keys, "text", "n_chars"]
    kinds = dict(df.dtypes)
    return pages.mapInArrow(each, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", text string, n_chars long")
