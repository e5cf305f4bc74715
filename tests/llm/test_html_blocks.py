"""The block labeller: reading of markup, the network against loops, and texts of pages in and out of its layouts."""

import html as entities
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siglab.llm import html_blocks
from siglab.llm.html_blocks import Block, Network, Pages, Paths, blocks

SF = "/root/testdata/sf0.001"


def texts(html):
    return [b.text for b in blocks(html, Paths())]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", []),
        ("just text", ["just text"]),
        ("<p>one<p>two</p></p>three", ["one", "two", "three"]),
        ("<p>a <b>bold</b>\n\tand <i>it</i>alic&nbsp;&amp; &lt;tag&gt; &#8364;</p>", ["a bold and italic & <tag> €"]),
        ("<head><title>no</title><style>p{}</style></head><body>yes", ["yes"]),
        ('<script>var t="</p>";x("<p>no</p>")</script><p>yes', ["yes"]),
        ("<script>never ends <p>no</p>", []),
        ("<p>a<!-- <p>no</p> -->b</p><!-- open <p>no", ["ab"]),
        ("<ul><li>1<li>2<ul><li>2a</ul><li>3</ul>", ["1", "2", "2a", "3"]),
        ("<table><tr><td>a<td>b<tr><th>c</table>", ["a", "b", "c"]),
        ("</div></p>x</nope><p>y", ["x", "y"]),
        ("<p>line<br>break<br/>again</p>", ["line break again"]),
        ('<p title="a > b">x</p><p data-x=\'"\'>y</p>', ["x", "y"]),
        ("1 < 2 and <3", ["1 < 2 and <3"]),
        ("<P CLASS=Big>x</P><Article>y</ARTICLE>", ["x", "y"]),
        ("<svg><text>no</text></svg><textarea><p>no</textarea>z", ["z"]),
        ("<p>   \n </p><div><div></div></div>", []),
        ("<p>unclosed <b", ["unclosed <b"]),
        ("<?xml version='1.0'?><!DOCTYPE html><![CDATA[x]]>y", ["y"]),
    ],
)
def test_blocks_of_markup(html, want):
    assert texts(html) == want


def test_paths_and_links():
    paths = Paths()
    page = blocks('<body><div class="siteHeader top-2" id=x9 role="banner"><a href=1>link</a> rest</div><div style="display:none"><p>x</div><p hidden>y', paths)
    names = {at: key for key, at in paths.known.items()}
    assert names[page[0].path][1:] == ("div", ("site", "header", "top", "banner")) and page[0].linked == 4
    assert names[names[page[1].path][0]][1:] == ("div", ("hidden",)) and names[page[2].path][1:] == ("p", ("hidden",))
    assert set(np.flatnonzero(paths.vectors[names[page[1].path][0]][: html_blocks.BAG])) <= set(np.flatnonzero(paths.vectors[page[1].path][: html_blocks.BAG]))


def test_deep_and_long_pages_take_time_in_proportion():
    deep = "<div>" * 60_000 + "x" + "</div>" * 60_000
    paths = Paths()
    assert [b.text for b in blocks(deep, paths)] == ["x"] and len(paths.vectors) <= html_blocks.DEPTH + 2
    assert len(texts("<p>a b c" * 50_000)) == 50_000
    assert len(texts('<a href="' * 20_000)) == 1


def test_word_vectors_equal_counts_of_hashed_words():
    said = ["a b a", "", "longer words, here and there", "b", "ünï çødé"]
    got = html_blocks._word_vectors(said)
    single = {w: int(np.flatnonzero(html_blocks._word_vectors([w])[0])[0]) for t in said for w in t.split()}
    for row, t in zip(got, said):
        counts = np.bincount([single[w] for w in t.split()], minlength=html_blocks.WORDS)
        if t:
            assert np.allclose(row, np.log1p(counts) / np.log1p(max(1, len(t.split()))), atol=1e-6)


def some_pages(paths, n=9, seed=3):
    rng = np.random.default_rng(seed)
    made = html_blocks._Layouts(paths, seed)
    main = [Block(0, " ".join(f"w{k}" for k in rng.integers(0, 50, rng.integers(2, 60)))) for _ in range(6)]
    return [made.lay(main) for _ in range(n)]


def test_network_equals_a_loop_over_blocks():
    paths = Paths()
    pages = [p for p, _ in some_pages(paths)] + [[]]
    data, net = Pages.of(pages, paths), Network.new(4)
    got, w, n = net.chances(data, together=4), net.weights, html_blocks.HIDDEN
    for k in range(len(pages)):
        x = [np.concatenate([data.vectors[data.path[i]], data.rest[i]]) for i in range(data.begin[k], data.begin[k + 1])]
        states = {}
        for side, order in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
            h, c = np.zeros(n), np.zeros(n)
            for t in order:
                z = x[t] @ np.concatenate([w[f"{side}p"], w[f"{side}r"]]) + w[f"{side}c"] + h @ w[f"{side}h"]
                i, f, o, g = 1 / (1 + np.exp(-z[:n])), 1 / (1 + np.exp(-z[n : 2 * n])), 1 / (1 + np.exp(-z[2 * n : 3 * n])), np.tanh(z[3 * n :])
                c = f * c + i * g
                h = o * np.tanh(c)
                states[side, t] = h
        want = [1 / (1 + np.exp(-(np.r_[states["f", t], states["b", t]] @ w["o"] + w["oc"][0]))) for t in range(len(x))]
        assert np.allclose(got[data.begin[k] : data.begin[k + 1]], want, atol=1e-4)


def test_slopes_equal_differences_of_the_loss():
    paths = Paths()
    made = some_pages(paths, 4)
    data, truth = Pages.of([p for p, _ in made], paths), np.array([y for _, ys in made for y in ys], np.float32)
    net = Network({k: v.astype(np.float64) for k, v in Network.new(2, hidden=5).weights.items()})
    _, slopes = net.slopes(data, truth)
    rng = np.random.default_rng(1)
    for name, w in net.weights.items():
        for at in rng.permutation(np.flatnonzero(np.abs(slopes[name]).ravel() > 1e-5))[:4]:
            old, losses = w.flat[at], []
            for step in (1e-2, -1e-2):
                w.flat[at] = old + step
                losses.append(net.slopes(data, truth)[0])
            w.flat[at] = old
            assert (losses[0] - losses[1]) / 2e-2 == pytest.approx(slopes[name].flat[at], rel=0.05, abs=2e-5), name


@pytest.fixture(scope="module")
def network(spark):
    return html_blocks.fitted(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def article(html):
    """The blocks of the one article of a page of the given tables, by regular expressions."""
    inner = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    return [t for x in re.split(r"</?(?:p|h1)>", inner) if (t := " ".join(entities.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()))]


def told(pages, network):
    paths = Paths()
    return list(html_blocks.main_blocks([blocks(h, paths) for h in pages], paths, network))


def test_pages_that_were_not_learnt_from(network):
    pages = pd.read_parquet(f"{SF}/pages.parquet").html.tolist()
    assert told(pages, network) == [article(h) for h in pages]


_FRAMES = [
    '<body><header><h2>{1}</h2><nav><a href=/>{2}</a> <a href=/>{3}</a></nav></header><main><article>{main}</article></main><aside><h3>{4}</h3><ul><li><a href=/>{5}</a></li></ul></aside><footer><p>{6}</p></footer>',
    '<body><div id="cookie-notice"><p>{7}</p><button>{1}</button></div><div class="top-menu"><ul><li><a>{2}</a></li><li><a>{3}</a></li></ul></div><div class="post-content">{main}<div class="ad-slot">{4}</div></div>'
    '<div id="comments"><h3>{5}</h3><div class="comment"><p>{7}</p></div><div class="comment"><p>{6}</p></div></div><div class="site-footer">{1}</div>',
    '<table><tr><td class="sidebar"><p><a>{1}</a></p><p><a>{2}</a></p></td><td class="content">{main}</td></tr></table><form class="search"><label>{3}</label><button>{4}</button></form><p class="footer">{5}</p>',
    '<div class="wrapper"><div role="navigation"><a>{2}</a></div><section class="story">{main}</section><section class="reader-comments"><article class="comment"><p>{7}</p></article><article class="comment"><p>{6}</p></article></section>'
    '<div class="newsletter-signup"><h4>{1}</h4><p>{5}</p></div><footer>{3}</footer></div>',
]


def test_layouts_by_hand_that_were_not_learnt(network):
    """Blocks of held-out articles in four kinds of pages that the layouts of the fit don't contain as they are."""
    rng = np.random.default_rng(8)
    right = wrong = lost = 0
    for k, html in enumerate(pd.read_parquet(f"{SF}/pages.parquet").html):
        main = article(html)
        words = " ".join(main).split()
        say = lambda n: " ".join(rng.choice(words, n))
        body = "".join(f"<h1>{entities.escape(t)}</h1>" if i == 0 and len(t) < 100 else f"<p>{entities.escape(t)}</p>" for i, t in enumerate(main))
        page = _FRAMES[k % 4].format("", *(entities.escape(say(n)) for n in (2, 1, 2, 4, 3, 9, 25)), main=body)
        (got,) = told([page], network)
        right += len(set(got) & set(main))
        wrong += len(set(got) - set(main))
        lost += len(set(main) - set(got))
    assert right / (right + lost) > 0.97 and right / (right + wrong) > 0.97, (right, wrong, lost)


def test_whole_table_and_awkward_rows(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    odd = spark.createDataFrame([(None, None, None), (7, "u", ""), (7, "u", ""), (8, None, "<p>"), (9, "v", "<body>" + "<p>word and word.</p>" * 30_000 + "</body>")], "page_id long, url string, html string")
    both = pages.unionByName(odd).withColumn("text", F.lit("x")).withColumn("n_chars", F.lit(1))
    got = html_blocks.extract(both, sample=60)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = got.toPandas()
    assert len(rows) == pages.count() + 5 and (rows.text.str.len() == rows.n_chars).all() and rows.text.notna().all()
    assert (rows[rows.page_id.isna() | rows.page_id.isin([7, 8]) & rows.url.isin(["u", None])].n_chars == 0).sum() >= 3
    assert html_blocks.extract(pages.limit(0)).count() == 0
    assert [tuple(r) for r in html_blocks.extract(odd.limit(2)).select("text", "n_chars").collect()] == [("", 0), ("", 0)]
