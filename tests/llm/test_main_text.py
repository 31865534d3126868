"""op11: the cut against all labellings, the parser and whole pages against what they must give."""

import html
import itertools
import random
import re

import pytest

from newsmill.llm import main_text

PRIOR = main_text.prior_weights()


def energy(odds, edges, labels):
    return sum(abs(o) for o, l in zip(odds, labels) if (o > 0) != l and o) + sum(c for a, b, c in edges if labels[a] != labels[b])


def test_cut_against_all_labellings():
    rng = random.Random(11)
    for _ in range(400):
        n = rng.randrange(1, 9)
        odds = [rng.randrange(-6, 7) for _ in range(n)]
        edges = [(a, b, rng.randrange(0, 5)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
        every = sorted(itertools.product([False, True], repeat=n), key=lambda l: (energy(odds, edges, l), sum(l)))
        assert tuple(main_text.minimum_cut(odds, edges)) == every[0], (odds, edges)


def test_cut_of_a_long_chain():
    rng = random.Random(2)
    odds = [rng.choice([-400, 400, 300, -200]) for _ in range(30_000)]
    edges = [(i, i + 1, 500) for i in range(len(odds) - 1)]
    got = main_text.minimum_cut(odds, edges)
    best = [0, 0]  # of the prefix, by the last label
    for i, o in enumerate(odds):
        cost = [max(o, 0), max(-o, 0)]
        tie = 500 if i else 0
        best = [min(best[x], best[1 - x] + tie) + cost[x] for x in (0, 1)]
    assert energy(odds, edges, got) == min(best)


ARTICLE = [
    "The council voted on Tuesday to reopen the harbour, after two years of repairs.",
    "Short.",
    "Ships may call again from May, said the harbour master, who had asked for more time & money.",
    "Café owners — forty of them — expect guests.",
]
PARTS = "".join(f"<p>{html.escape(a)}" for a in ARTICLE)
PAGES = {
    "semantic": f"<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><article><h1>Harbour</h1>{PARTS}</article>"
    "<section class=comments><article><p>I do not believe a word of it, and neither should you.</p></article></section>"
    "<aside><p>Most read today: a long sentence about something else, with words.</p></aside><footer>&copy; 2020 All rights.</footer>",
    "classes": f"<body class='has-sidebar'><div id=topMenu><a href=x>One</a> <a href=y>Two</a></div><div class='cookie-notice'><p>We use cookies, as everyone does, to"
    f" make this page better.</p></div><div class='post-content'><h1>Harbour</h1>{PARTS}<div class=ad-slot>Buy this now, it is very good.</div></div>"
    "<div class=sidebar><p>Another long sentence that is not part of it, at all.</p></div>",
    "form around all": f"<form action=/><div class=menu><a href=x>One</a></div><main><h2>Harbour</h2>{PARTS}</main><form><p>Your name</p><input></form></form>",
    "plain": f"<div><a href=1>Home</a> | <a href=2>World</a></div><div><h1>Harbour</h1>{PARTS}</div><div><a href=3>Imprint</a></div>",
    "hidden": f"<main><h1>Harbour</h1>{PARTS}<p style='display: none'>Not to be seen by any reader of it.</p><p hidden>Nor this one, which is hidden.</p>"
    "<script>var p = '</p><p>no</p>';</script><style>p{}</style><noscript>Enable scripts to read this page, please.</noscript><!-- <p>no</p> --></main>",
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    assert main_text.main_text(PAGES[name], PRIOR) == " ".join(["Harbour", *ARTICLE])


def test_parser():
    def texts(page):
        return [b.text for b in main_text.blocks(page)]

    assert texts("<p>a <b>b</i>c</b>d<br>e\n\t f&nbsp;g<p>h&eacute;&#8230;&#x2014;&euro;5 &am &nosuch; 1 < 2") == ["a bcd e f g", "hé…—€5 &am &nosuch; 1 < 2"]
    assert texts("<table><tr><td>1<td>2<tr><td>3</table>x<ul><li>a<ul><li>b</ul>c<li>d</ul>") == ["1", "2", "3", "x", "a", "b", "c", "d"]
    assert texts("a<p") == ["a"] and texts("a<!-- b") == ["a"] and texts("<script>a") == [] and texts("</div></p>") == []
    assert texts("<a title='x>y'>t</a><p class=\"open>q</p>z") != []
    deep = "<div>" * 20_000 + "in" + "</div>" * 20_000
    assert texts(deep) == ["in"]


def test_given_pages(spark, sf):
    """The pages of the given table hold their article in one element."""
    df = spark.read.parquet(f"{sf}/pages.parquet")
    pages = {r.page_id: r.html for r in df.collect()}
    for r in main_text.extract(df).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S).group(1)
        inner = re.sub(r"</?(?:p|h1|br)>", " ", re.sub(r"</?b>", "", inner))
        assert r.text == " ".join(html.unescape(inner).split())
        assert r.n_chars == len(r.text)


def test_hard_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars int, _html string"
    rows = [(1, "u", None), (2, None, ""), (None, "v", " \n"), (3, "w", PAGES["semantic"]), (3, "w", PAGES["semantic"]), (4, "x", "<p>" * 5)]
    rows += [(5, "y", "<article>" + "<p>Many words, in one long page.</p>" * 60_000 + "</article>")]
    df = spark.createDataFrame([(*r, "t", 1, "h") for r in rows], schema)
    got = sorted(((r.page_id or 0, r.n_chars, r.text) for r in main_text.extract(df).collect()))
    text = " ".join(["Harbour", *ARTICLE])
    long = " ".join(["Many words, in one long page."] * 60_000)
    assert got == [(0, 0, ""), (1, 0, ""), (2, 0, ""), (3, len(text), text), (3, len(text), text), (4, 0, ""), (5, len(long), long)]
    assert main_text.extract(df.limit(0)).collect() == []


def test_fit():
    """Weights move to what is seen: long linked blocks are content here."""
    counts = [(9, 4, 1, 0, True, 50), (5, 0, 0, 2, False, 70), (9, 0, 1, 0, False, 30)]
    weights = main_text.fit(counts)

    def odds(length, density, ended, kind):
        return weights[length] + weights[16 + density] + weights[21 + ended] + weights[23 + kind]

    assert odds(9, 4, 1, 0) > 0 > max(odds(5, 0, 0, 2), odds(9, 0, 1, 0))
    assert main_text.fit([c for c in counts if c[4]]) == PRIOR
