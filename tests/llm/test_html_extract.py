"""Pages that once lost text, labels of whole small pages against all labellings, long and deep pages in linear time."""

import time

import numpy as np
import pytest

from colloquy.llm import html_extract as H


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<body><article class="legal"><p>One two three four five.</p><p>Six seven eight.</p></article></body>', "One two three four five.\nSix seven eight."),
        ('<body><div class="article-header"><h1>The title here</h1></div><div class=content><p>Some text is here, and more of it.</p></div>', "The title here\nSome text is here, and more of it."),
        ("<p><a href=foo'bar>link</a> text one goes on here.</p><p>Second paragraph here, with words.</p><p>it's ok, third.</p>", "link text one goes on here.\nSecond paragraph here, with words.\nit's ok, third."),
        ("<p>Before the code, words.</p><script src=a/>var x='leak';</script><p>After it, words.</p>", "Before the code, words.\nAfter it, words."),
        ("<article><p>a &lt;b&gt; &amp; c&nbsp;d &#233; words, here.<p title='a>b' x=\">\">Next  one\tis\nhere.</article><div class='comments'><p>I think, reader, that this is so.</p></div>", "a <b> & c d é words, here.\nNext one is here."),
        ("<svg/><p>Text after a picture, here.</p><math><mi>x</mi></math><style>p{}</style><p hidden>Nothing of this, no.</p>", "Text after a picture, here."),
        ("<article><p>Cut off in the middle, so", "Cut off in the middle, so"),
    ],
)
def test_pages(page, text):
    assert H.extract(page) == text


def test_labels_of_whole_pages():
    rng = np.random.default_rng(3)
    parts = [
        "<p>Some words, and more of them.</p>",
        "<li><a href=x>go</a></li>",
        "<div class=ad>Buy it now.</div>",
        "<div>",
        "</div>",
        "<article>",
        "</article>",
        "<nav>",
        "</nav>",
        "<h2>Head</h2>",
        "plain words here",
        "<p>x",
        "<div class=content>",
    ]
    for _ in range(60):
        page = "".join(rng.choice(parts, int(rng.integers(2, 16))))
        found = H.blocks(page)
        if len(found) > 12:
            continue
        odds, edges = H.graph(found)
        cost = lambda keep: sum(max(o, 0) if not k else max(-o, 0) for o, k in zip(odds, keep)) + sum(c for a, b, c in edges if keep[a] != keep[b])  # noqa: E731,B023
        best = min((cost(k) for k in ([m >> i & 1 == 1 for i in range(len(found))] for m in range(1 << len(found)))), default=0)
        kept = H.min_cut(odds, edges)
        assert abs(cost(kept) - best) < 1e-6
        assert H.extract(page) == "\n".join(b.text for b, k in zip(found, kept) if k)


def test_cut_of_long_chains():
    """Flow over many nodes: against the two-state recursion, which is exact on a chain."""
    rng = np.random.default_rng(4)
    for n in (2, 50, 3000):
        odds, caps = (rng.normal(size=n) / 3).tolist(), rng.random(n - 1).tolist()
        kept = H.min_cut(odds, [(i, i + 1, c) for i, c in enumerate(caps)])
        got = sum(max(o, 0) if not k else max(-o, 0) for o, k in zip(odds, kept)) + sum(c for i, c in enumerate(caps) if kept[i] != kept[i + 1])
        keep, drop = max(-odds[0], 0), max(odds[0], 0)
        for o, c in zip(odds[1:], caps):
            keep, drop = min(keep, drop + c) + max(-o, 0), min(drop, keep + c) + max(o, 0)
        assert abs(got - min(keep, drop)) < 1e-6


def test_long_and_deep_pages():
    pages = [
        "<body>" + "<p>some words in a paragraph, more.</p>" * 25000,
        "".join(f"<div class={'ad' if i % 7 == 0 else 'x'}><p>word {i}</p></div>" for i in range(20000)),
        "<div>" * 60000 + "text",
        "<p>" + "<b>x" * 60000,
        "<p " + "a=\"b'" * 200000 + ">x",
        "<" * 300000,
        "<div>" * 20000 + "</b>x</p>" * 20000,
    ]
    for page in pages:
        began = time.process_time()
        H.extract(page)
        assert time.process_time() - began < 5  # quadratic ways take minutes


def test_learned_weights(spark):
    assert (H.fit(np.zeros((0, len(H.START))), np.zeros(0, bool)) == H.START).all()
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    w = H.learn(pages.select("url", "html"))
    assert (w == H.learn(pages.select("url", "html").repartition(5))).all() or np.allclose(w, H.learn(pages.select("url", "html").repartition(5)))
    assert w[1] > 0 > w[2]  # long blocks are text, blocks of links are not
    small = H.learn(pages.select("url", "html"), train_pages=20, train_blocks=50)
    assert np.abs(small - H.START).max() < 5
