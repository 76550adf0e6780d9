"""Main text of pages: exact inference, the parser, held-out layouts, odd pages."""

import html
import itertools
import random

import numpy as np
import pytest

from factloom.llm import pagetext as P


@pytest.fixture(scope="module")
def model(spark):
    return P.learn(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"), limit=60, layouts=700)


def test_messages_equal_enumeration():
    rng = np.random.default_rng(2)
    page = P.parse_page("<body><div><p>a<p>b</div><ul><li>c</ul></body>")
    forest = P.Forest([page, page])
    weights, edges = rng.normal(size=len(P._FEATURES)), rng.normal(size=(P.N_KINDS, 2, 2))
    got, pairs = forest.infer(weights, edges)
    n = len(page.parent)
    unary = [sum(weights[f] for f in x) for x in page.features]
    total, marginal, expected = 0.0, np.zeros(n), np.zeros_like(edges)
    for y in itertools.product((0, 1), repeat=n):
        score = sum(u for u, v in zip(unary, y, strict=True) if v) + sum(edges[forest.kind[k], y[page.parent[k]], y[k]] for k in range(1, n))
        p = np.exp(score)
        total += p
        marginal += p * np.array(y)
        for k in range(1, n):
            expected[forest.kind[k], y[page.parent[k]], y[k]] += p
    assert np.allclose(got[:n], marginal / total) and np.allclose(got[n:], marginal / total)
    assert np.allclose(pairs, 2 * expected / total)


def test_parser():
    page = P.parse_page("<!DOCTYPE html><p><b>one<br>two<p>three</b> four<script>x='</p>'</script><ul><li>a<li>b</ul><!-- <p>no --><table><tr><td>1<td>2</table><a title='>'>z</a>&lt;")
    keep = [True] * len(page.texts)
    assert P.page_text(page, keep) == "one two three four a b 1 2 z<"
    assert [page.tag[page.parent[n]] for n in page.leaf_of] == ["p", "p", "li", "li", "td", "td", "html"]
    assert P.page_text(P.parse_page("x &amp;amp; &#8217;&nbsp; \n y &copy z"), [True]) == "x &amp; ’ y © z"
    for odd in ("", "<", "<a", '<a "' * 3000, "<!-- ", "</p>" * 10, "<script>", "a < b", "<p" * 1000, "\x00<p>\x00"):
        page = P.parse_page(odd)
        P.page_text(page, [True] * len(page.texts))


def test_held_out_layouts(model):
    rng = random.Random(99)
    content = ["A long sentence about the harbour, the ships and their captains.", "Short one.", "It rained; nobody came, and the market closed early that day."]
    other = ["Home", "About us", "Our weekly selection of deals", "All rights reserved", "Read more news here"]
    right = wrong = missed = 0
    for _ in range(300):
        page, y = P.labelled(P.draw_layout(rng, content, other), lambda p, n: P._MARK in p.texts[p.leaf_of.index(n)])
        forest = P.Forest([page])
        said = forest.infer(*model)[0][forest.leaves[0]] > 0.5
        truth = y[forest.leaves[0]]
        right, wrong, missed = right + (said & truth).sum(), wrong + (said & ~truth).sum(), missed + (~said & truth).sum()
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.97


LINE = "Thereafter the committee went on to discuss the matter at length. It was, by all accounts, a long evening."


@pytest.mark.parametrize(
    "source, text",
    [
        (f"<div class='topbar'><a href=/>Home</a></div><div class='content-area'><h1>A title</h1><p>{LINE}</p></div><div id='sidebar-right'><h3>Related</h3><p>{LINE}</p></div><div class='site-footer'>&copy; 2020</div>", f"A title {LINE}"),
        (f"<header><h1>Site</h1><nav><a>q</a></nav></header><main><h1>T</h1><p>{LINE}</p><div class='advertisement'>Buy <b>now</b>!</div><p>{LINE}</p></main><section id='comments'><h2>3 Comments</h2><div class='comment'><p>{LINE}</p></div></section>", f"T {LINE} {LINE}"),
        (f"<div class='cookie-banner'><p>We use cookies. {LINE}</p></div><article><h1>H</h1><p>{LINE}</p></article><form action=/s><label>Mail</label><input><p>Sign up</p></form>", f"H {LINE}"),
        (LINE, LINE),
        ("", ""),
        ("<html><head><title>x</title></head><body></body></html>", ""),
    ],
)
def test_pages_of_other_shapes(model, source, text):
    page = P.parse_page(source)
    forest = P.Forest([page])
    assert P.page_text(page, forest.infer(*model)[0][forest.leaves[0]] > 0.5) == text


def test_rows_of_odd_kinds(spark, model):
    given = [(1, "u", f"<article><p>{LINE}</p></article>", "t"), (1, "u", f"<article><p>{LINE}</p></article>", "t"), (None, None, None, None), (2, None, "", None), (3, "v", "<article>" + f"<p>{html.escape(LINE)}</p>" * 20000 + "</article>", "t")]
    df = spark.createDataFrame(given, "page_id long, url string, html string, text string")
    got = sorted(P.main_text(df, model).collect(), key=repr)
    assert len(got) == 5
    by = {r["page_id"]: r for r in got}
    assert by[1]["text"] == LINE and by[1]["n_chars"] == len(LINE)
    assert by[None]["text"] == "" and by[2]["text"] == "" and by[2]["n_chars"] == 0
    assert by[3]["text"] == " ".join([LINE] * 20000)
    assert P.main_text(df.limit(0), model).collect() == []
    weights, edges = P.learn(df.limit(0), layouts=20)
    assert np.isfinite(weights).all() and np.isfinite(edges).all()
