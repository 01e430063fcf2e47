"""Block cutting on malformed pages, and the labeller on pages that were written by hand."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom.llm import html_extract as h

RECIPE = """<html><body><div class="hdr top"><a href="/">Tasty Corner</a></div><ul class="topnav"><li><a href=/r>Recipes</a><li><a href=/v>Videos</a><li><a href=/s>Shop</a></ul>
<div class="page"><section class="recipe-body"><h1>Slow tomato soup</h1><p>This soup takes an hour, most of which needs no attention at all, and it keeps for three days.</p>
<h2>What you need</h2><ul><li>one kilogram of ripe tomatoes</li><li>two onions</li><li>a spoon of olive oil</li></ul>
<h2>Method</h2><p>Chop the onions and let them soften in the oil over a low flame for ten minutes.</p><p>Add the tomatoes, cover the pot, and leave it alone for forty minutes before you blend it.</p></section>
<div class="rail"><h3>Popular</h3><ul><li><a href=/1>Bean stew</a></li><li><a href=/2>Flat bread</a></li></ul></div></div>
<div class="colophon"><p>© 2020 Tasty Corner. All rights reserved.</p><a href=/t>Terms</a> <a href=/p>Privacy</a></div></body></html>"""
NEWS = """<!doctype html><body><div id="cookie-bar"><p>We use cookies to improve your visit.</p><button>Accept</button></div><nav><a href=/w>World</a> <a href=/b>Business</a></nav>
<main id="story"><h1>Bridge reopens after repairs</h1><p>The old bridge over the river reopened on Monday after nine months of work, the city said.</p>
<blockquote>It has never looked better, and it will last another century.</blockquote><p>Traffic had been sent over the northern crossing, which added half an hour to most trips.</p>
<div class="advertisement"><p>Buy now and save half!</p></div><p>Local shops reported that customers came back on the first day.</p></main>
<section id="comments"><h3>Comments</h3><div class="comment"><p>Finally, I missed that bridge so much!</p></div></section><footer><p>Contact us</p></footer>"""
BLOG = """<body><div class="masthead"><h2>Notes from the shed</h2></div><div class="post-wrap"><div class="hentry"><h1>Sharpening a plane</h1>
<p>A plane iron wants a flat back before anything else, so start there and be patient.</p><p>I use three stones, and I spend most of the time on the first one of them.</p>
<p>When the burr comes off in one piece, you are done &amp; can go back to work.</p></div></div><div class="sidebar"><h4>Tags</h4><a href=/t/1>tools</a> <a href=/t/2>wood</a></div>
<form class="search"><label>Search</label><input name=q></form><div class="legal">Copyright notice and terms of use</div></body>"""
PAGES = {
    "recipe": (RECIPE, ["Slow tomato soup", "This soup takes", "What you need", "one kilogram", "two onions", "a spoon of", "Method", "Chop the onions", "Add the tomatoes"]),
    "news": (NEWS, ["Bridge reopens", "The old bridge", "It has never", "Traffic had been", "Local shops"]),
    "blog": (BLOG, ["Sharpening a plane", "A plane iron", "I use three", "When the burr"]),
}


def test_pages_by_hand():
    """Layouts and class names that the training pages don't have: nine in ten blocks are labelled right."""
    right, net = [], h.trained()
    for page, want in PAGES.values():
        cut = h.blocks(page)
        main = [any(b[0].startswith(w) for w in want) for b in cut]
        assert sum(main) == len(want)
        right += list(net.label([h.vectors(cut)])[0] == main)
    assert np.mean(right) >= 0.9


def test_states_matter():
    """Without the LSTM's states the same output layer errs several times as often."""
    pages, net = h.labelled_pages(150, 12345), h.trained()
    wrong = lambda n: np.mean(np.concatenate([p != (y > 0) for p, (_, y) in zip(n.label([x for x, _ in pages]), pages, strict=True)]))
    bare = h.Labeller()
    bare.w = {k: v.copy() for k, v in net.w.items()}
    bare.w["out"][: 2 * h.HIDDEN] = 0
    assert wrong(net) < 0.03 and wrong(bare) > 3 * wrong(net)


@pytest.mark.parametrize("bad", ['<script "', "<div>x", "</p>y", '<a href="', "<!-- ", "<p class='", "<b <i ", "&", "<", '<a b="c>', "<textarea>", "<p><b>x<br>"])
def test_malformed_pages_take_linear_time(bad):
    began = time.time()
    h.blocks("<p>kept</p>" + bad * ((1 << 20) // len(bad)))
    assert time.time() - began < 10
    assert h.blocks("<p>kept</p>" + bad)[0][0] == "kept"


def test_cutting():
    cut = lambda page: [b[0] for b in h.blocks(page)]
    assert cut('<p title="a > b">x</p><P>1 < 2 &lt; 3<br>4') == ["x", "1 < 2 < 3 4"]
    assert cut("<div><p>a<div>b</p>c</div>d<script>p('<p>no</p>')</script >e") == ["a", "b", "c", "de"]
    assert cut("<!-- <p>no</p> --><p>yes</p><style>p{}</style><p>cut <a hre") == ["yes", "cut"]
    assert cut("") == cut("<p> \n </p>") == []


def test_every_word_counts():
    same = " ".join(["alpha"] * 64)
    a, b = (h.vectors([(same + tail, 0, "p", 0)]) for tail in (" beta" * 64, " gamma" * 64))
    assert not np.array_equal(a[0, h.PATH : h.PATH + h.WORDS], b[0, h.PATH : h.PATH + h.WORDS])


def test_extract_and_its_stored_weights(spark):
    rows = [(1, "u", NEWS), (1, "u", NEWS), (2, None, None), (None, "v", ""), (3, "w", "<p>" * 2000 + "Deep text that nobody closed, but it is a sentence of a page.")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("clash"), "n_chars": F.lit(1)})
    got = h.extract(df).collect()
    assert len(got) == 5 and got[0].text == got[1].text and got[0].text.startswith("Bridge reopens") and [r.text for r in got[2:4]] == ["", ""]
    assert h.extract(df.limit(0)).count() == 0
    net = h.stored_labeller(spark)
    assert all(np.array_equal(net.w[k], w) for k, w in h.trained().w.items())
