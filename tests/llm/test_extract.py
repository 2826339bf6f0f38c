import html
import itertools
import random
import re

import numpy as np
import pytest

from pulse.llm import extract, layouts
from pulse.llm.dom import EDGES, NAMES, Forest, parse
from tests.llm.conftest import table_texts


def leaves(source):
    return [n.text for n in parse(source).nodes if n.text is not None]


@pytest.mark.parametrize(
    "source,want",
    [
        ("<p>a<p>b <b>c</b>\n d<br>e</p>f", ["a", "b c d e", "f"]),
        ("<ul><li>x<li>y<ul><li>z</ul>w</ul>", ["x", "y", "z", "w"]),
        ("<table><tr><td>1<td>2<tr><th>3</table>4", ["1", "2", "3", "4"]),
        ("<head><title>t</title><meta a='>'>no</head><body>yes", ["yes"]),
        ("<p>a<script>var x='<p>no</p>';</script> b<style>p{}</style><!-- <p>no --> c", ["a b c"]),
        ("<p>1 < 2 &amp;&lt; &eacute;&#233;&#x41;&nbsp;x", ["1 < 2 &< ééA x"]),
        ("</div></p>a</b><div>b</section></div>c", ["a", "b", "c"]),
        ('<p title="a>b">x<p title="open>y', ["x", "y"]),
        ("<form><select><option>no</select><textarea>no</textarea>ok<button>no</button></form>", ["ok"]),
        ("<![CDATA[raw]]><script>never closed <p>a", ["raw"]),
        ("<dl><dt>a<dd>b<dt>c</dl><h1>d</h1>e", ["a", "b", "c", "d", "e"]),
        ("<svg><text>no</text></svg>a<my-part>b</my-part>", ["a", "b"]),
        ("", []),
        (" \n<div></div><p> </p>", []),
        ("<", ["<"]),
        ("<p", []),
    ],
)
def test_runs_of_text(source, want):
    assert leaves(source) == want


def test_deep_and_hostile_pages_take_linear_time():
    deep = parse("<div>" * 20_000 + "x" + "</span>" * 20_000)
    assert len(deep.nodes) == 20_002 and deep.nodes[-1].text == "x"
    assert len(leaves("<p a=\"" * 50_000)) <= 1
    assert leaves("<a b='" * 20_001 + ">t") is not None
    assert len(leaves("<b><p>x" * 5_000)) == 5_000


def model(rng):
    return extract.Model(rng.normal(size=len(NAMES)), rng.normal(size=(EDGES, 2, 2)))


def test_marginals_equal_enumeration():
    """Sum-product on a tree against the sum over all assignments."""
    rng = np.random.default_rng(1)
    pages = [parse("<div class=ad>a b<p>c</p></div><article><p>d e f</p>g</article>"), parse("x"), parse("<p>y")]
    m = model(rng)
    got, joint = extract.marginals(Forest.of(pages), m, pairs=True)
    first = 0
    for page in pages:
        forest, n = Forest.of([page]), len(page.nodes)
        scores = forest.scores(m.weights)
        total, each, both = 0.0, np.zeros(n), np.zeros((n, 2, 2))
        for states in itertools.product((0, 1), repeat=n):
            log = sum(scores[k] for k in range(n) if states[k])
            log += sum(m.edges[forest.edges[k]][states[forest.parent[k]], states[k]] for k in range(n) if forest.parent[k] >= 0)
            total += np.exp(log)
            each += np.exp(log) * np.array(states)
            for k in range(n):
                if forest.parent[k] >= 0:
                    both[k, states[forest.parent[k]], states[k]] += np.exp(log)
        assert np.allclose(got[first : first + n], each / total)
        assert np.allclose(joint[first : first + n], both / total)
        first += n


def test_the_fit_climbs_the_likelihood():
    pages = [parse(x) for x in layouts.pages(random.Random(1), ["some words to draw from, as many as are needed here."], 40)]
    pages = [p for p in pages if p.nodes]
    labels = [extract.labels_of(p) for p in pages]
    truth, forest = np.concatenate(labels), Forest.of(pages)
    leaf = np.array([n.text is not None for p in pages for n in p.nodes])
    few, many = (extract.fitted(pages, labels, extract.Settings(rounds=n)) for n in (2, 120))
    right = [np.mean((extract.marginals(forest, m)[0] >= 0.5)[leaf] == truth[leaf]) for m in (few, many)]
    assert right[1] > 0.97 and right[1] > right[0]


def stock():
    found = [parse(r["html"] or "") for r in table_texts("pages")]
    return [n.text for p in found for n in p.nodes if n.text is not None and n.words >= 5]


@pytest.fixture(scope="module")
def learned(spark):
    return extract.trained(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))


def test_made_pages_that_were_not_learned(learned):
    pages = [p for p in (parse(x) for x in layouts.pages(random.Random(99), stock(), 200)) if p.nodes]
    sure, _ = extract.marginals(Forest.of(pages), learned)
    truth = np.concatenate([extract.labels_of(p) for p in pages])
    leaf = np.array([n.text is not None for p in pages for n in p.nodes])
    words = np.array([n.words for p in pages for n in p.nodes])
    wrong = leaf & ((sure >= 0.5) != truth)
    assert wrong.sum() < 0.02 * leaf.sum() and (words * wrong).sum() < 0.04 * (words * leaf).sum()


LONG = "The committee met on Tuesday to talk about the new bridge, and after three hours it had come to no decision at all. "

#: Pages written by hand in the manner of common sites; none of them is learned from.
BY_HAND = [
    (
        f"""<html><head><title>Bridge</title></head><body class="home page"><div id="cookie-law">We use cookies to give you the best experience. <a href=#>OK</a></div>
        <div class="header-wrap"><a href="/">The Daily News</a><ul class="main-menu"><li><a href=/>Home</a><li><a href=/s>Sport</a></ul></div>
        <div class="article-content"><h1>No decision on bridge</h1><p>{LONG}</p><p>{LONG}It will meet again in May.</p></div>
        <div class="comments-area"><h3>2 Comments</h3><div class="comment-body"><p>I knew that this would happen, they never decide anything in this town.</p><a>Reply</a></div></div>
        <div class="site-info">Copyright 2020 The Daily News. All rights reserved.</div></body></html>""",
        ["No decision on bridge", LONG.strip(), LONG + "It will meet again in May."],
    ),
    (
        f"""<body><header><nav><a href=/>Start</a> <a href=/a>About</a></nav></header><main><article><header><h1>Bridge</h1></header>
        <p>{LONG}<aside class="ad-box">Buy a new car today at the lowest price in town!</aside><p>{LONG}</article>
        <aside class="sidebar"><h2>Popular</h2><ul><li><a href=1>Cats of the year</a><li><a href=2>Dogs of the year</a></ul></aside></main>
        <form action=/q><label>Search</label><input></form><footer>&copy; 2021 <a href=/i>Imprint</a></footer>""",
        ["Bridge", LONG.strip(), LONG.strip()],
    ),
    (
        f"""<div class="notice">Our office is closed on Monday, please call us again on Tuesday.</div><article><h1>T</h1><p>{LONG}</p><ul><li>First point of the plan.</li><li>Second point of the plan.</li></ul></article>
        <section id="reader-comments"><article class="comment"><p>What a waste of time this whole meeting was, if you ask me.</p></article></section>""",
        ["T", LONG.strip(), "First point of the plan.", "Second point of the plan."],
    ),
]


@pytest.mark.parametrize("source,want", BY_HAND)
def test_pages_by_hand(learned, source, want):
    (text, _), = extract.contents([parse(source)], learned)
    assert text.split("\n\n") == [" ".join(w.split()) for w in want]


def article_of(source):
    body = re.search("<article>(.*)</article>", source, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub("</?b>|<br>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", body)]
    return "\n\n".join(b for b in blocks if b)


def test_the_articles_of_the_table(spark, learned):
    got = extract.extracted(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), model=learned)
    want = {r["page_id"]: article_of(r["html"]) for r in table_texts("pages", "/root/testdata/sf0.01")}
    rows = got.collect()
    assert len(rows) == len(want) and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert sum(r["text"] == want[r["page_id"]] for r in rows) >= 0.99 * len(rows)


def test_odd_pages(spark, learned):
    rows = [
        (None, None, None, "x"),
        (1, "u", "", "x"),
        (2, "u", "no markup at all", "x"),
        (2, "u", "no markup at all", "x"),
        (3, "u", "<article><p>" + LONG * 20_000 + "</article>", "x"),
        (4, "u", "<nav><a href=/>Home</a> <a href=/b>News</a></nav>", "x"),
        (5, "u", "<div>" * 3_000 + LONG, "x"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {(r["page_id"], r["n_chars"]) for r in extract.extracted(pages, model=learned).collect()}
    assert {(None, 0), (1, 0), (4, 0), (3, len(LONG) * 20_000 - 1)} <= got
    assert extract.extracted(pages.where("false"), model=learned).collect() == []
    # A table with nothing to learn from is learned from made pages alone.
    few = extract.extracted(pages.where("page_id = 1"), extract.Settings(made=30, rounds=20))
    assert [r["text"] for r in few.collect()] == [""]
