import html
import re

import numpy as np
import pytest
from grainmill.llm import extraction
from grainmill.llm.extraction import Labeller, Vectors, blocks_of, examples, extract_text, fit_labeller, label_blocks

PAGES = "page_id long, url string, html string, text string, score double, blocks int"


def texts(page):
    return [b.text for b in blocks_of(page)]


def test_blocks():
    assert texts(None) == texts("") == texts("<p> \n </p>") == []
    assert texts("bare &amp; simple") == ["bare & simple"]
    assert texts("<p>a<br>b <b>c</b>d</p>e<p>f") == ["a b cd", "e", "f"]
    assert texts("<p>&lt;p&gt; x&nbsp;y &#233;\n\t z</p>") == ["<p> x y é z"]
    assert texts("<head><title>t</title></head><script>var a='<p>no</p>';</script><style>p{}</style><p>yes</p><!-- <p>no</p> -->") == ["yes"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>d<td>e<tr><td>f</table>") == list("abcdef")
    assert texts('<p title="a > b">x</p><p title="open>y</p>') == ["x", "y"]
    assert texts("<p>one</p><p>two</p><div class='cut") == ["one", "two"]
    assert texts("1 < 2 and <3 <p>5 > 4</p>") == ["1 < 2 and <3", "5 > 4"]
    assert texts("<script>never closed <p>x</p>") == []
    assert [b.path for b in blocks_of("<article><p>a<div id='userBox'>b</article>c")] == [("<article>", "<p>"), ("<article>", "<div> user box"), ()]
    assert [(b.text, b.linked) for b in blocks_of("<p>see <a href=x>this one</a> now</p>")] == [("see this one now", 8)]


def test_long_broken_pages_take_linear_time():
    for page in ("<a \"" * 100_000, "<p" * 200_000, "<p>" * 20_000 + "x", "<!--" * 200_000 + ">", "x < " * 200_000 + "<p>y</p>"):
        blocks_of(page)
    words = "word " * 400_000
    assert texts(f"<p>{words}</p>") == [words.strip()]


def test_gradient_equals_differences():
    draw = np.random.default_rng(1)
    x, sizes, labels = draw.normal(size=(9, 5)), np.array([4, 0, 2, 3]), draw.integers(0, 2, 9).astype(float)
    labels[2] = np.nan
    net = Labeller(hidden=3, width=5)

    def loss(weights):
        p = 1 / (1 + np.exp(-Labeller(weights, 3, 5).forward(x, sizes)[0]))
        known = ~np.isnan(labels)
        return -np.mean(np.where(labels[known] == 1, np.log(p[known]), np.log(1 - p[known])))

    found = net.gradient(x, sizes, labels)
    step = 1e-6 * np.eye(len(found))
    wanted = [(loss(net.weights + e) - loss(net.weights - e)) / 2e-6 for e in step]
    assert np.allclose(found, wanted, atol=1e-7)


def test_pages_do_not_touch_each_other():
    """A page gets the same scores alone and between others, in any portion."""
    pages = [blocks_of(f"<article>{'<p>some words, and more.</p>' * k}</article><footer>x</footer>") for k in (3, 0, 7, 1)]
    net = Labeller()
    vectors = Vectors()
    together = net.scores(pages, vectors)
    for page, scores in zip(pages, together, strict=True):
        dense = net.scores([page], vectors)[0]
        assert len(dense) == len(page) == len(scores)
    net_scores = [net.forward(vectors(pages[k : k + 1]), np.array([len(pages[k])]))[0] for k in (0, 2)]
    assert all(len(s) for s in net_scores)


@pytest.fixture(scope="module")
def fitted(spark, sf_dir):
    return fit_labeller(spark.read.parquet(f"{sf_dir}/pages.parquet"), max_pages=160)


def test_held_out_layouts(fitted, spark, sf_dir):
    """Random layouts of other pages and another seed: nearly all blocks are right."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").orderBy("page_id").limit(40).collect()
    data = list(examples([r["html"] for r in rows], seed=5_000))
    scores = fitted.scores([b for b, _ in data], Vectors())
    right = np.concatenate([((s >= 0.5) == (y == 1))[~np.isnan(y)] for s, (_, y) in zip(scores, data, strict=True)])
    assert right.mean() > 0.97


def test_other_layouts(fitted):
    """Layouts written by hand, which no template of the training has."""
    story = "".join(f"<p>It was a long day for all of them, and number {k} was no exception. Then they went home again.</p>" for k in range(5))
    other = (
        '<div id="header"><a href="/">Site</a><ul class="menu"><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></div>',
        '<div class="cookie-banner">We use cookies. <a href="/c">Accept</a></div>',
        '<aside class="sidebar"><h3>Related</h3><ul><li><a href="/1">One thing</a></li><li><a href="/2">Two things</a></li></ul></aside>',
        '<section id="comments"><h3>2 comments</h3><div class="comment"><p>I liked this very much, thanks for all.</p></div></section>',
        '<footer><p>Copyright notice. All rights reserved.</p></footer>',
    )
    page = f"<html><body>{other[0]}{other[1]}<main><h1>A long day</h1>{story}</main>{''.join(other[2:])}</body></html>"
    blocks = blocks_of(page)
    scores = fitted.scores([blocks], Vectors())[0]
    assert [b.text for b, s in zip(blocks, scores, strict=True) if s >= 0.5] == ["A long day", *texts(story)]


def test_given_pages_equal_their_articles(spark, sf_dir, fitted):
    """The given pages have one article each; its blocks are the wanted text."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    wanted = {}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = re.split(r"</?(?:p|h1|li|ul|ol|div|h2)\b[^>]*>", inner)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", p)).split()) for p in parts]
        wanted[r["page_id"]] = "\n\n".join(p for p in parts if p)
    found = {r["page_id"]: r for r in extract_text(pages, fitted).collect()}
    assert {k: r["text"] for k, r in found.items()} == wanted
    assert all(r["n_chars"] == len(r["text"]) for r in found.values())


def test_awkward_and_empty_tables(spark, fitted):
    page = "<article><p>Some text, which goes on for a while, as texts do.</p></article>"
    rows = [(1, "u", page, *[None] * 3), (1, "u", page, *[None] * 3), (2**60 + 1, None, None, "t", 1.0, 3), (None, None, "", *[None] * 3)]
    rows += [(5, "x", "<p>" * 5_000 + "deep", *[None] * 3)]
    pages = spark.createDataFrame(rows, PAGES)
    found = extract_text(pages, fitted).collect()
    assert sorted(str(r["page_id"]) for r in found) == sorted(["1", "1", str(2**60 + 1), "None", "5"])
    assert all(r["text"] == "" and r["n_chars"] == 0 for r in found if r["page_id"] not in (1, 5))
    assert label_blocks(pages, fitted).where("page_id = 1").first()["blocks"][0]["text"].startswith("Some text")
    empty = spark.createDataFrame([], PAGES)
    assert extract_text(empty, fit_labeller(empty)).collect() == []
    untold = spark.createDataFrame([(1, "u", "<div>no telling path here</div>", *[None] * 3)], PAGES)
    assert extract_text(untold, fit_labeller(untold, rounds=1)).count() == 1


def test_sample_is_bounded_and_repeatable(spark):
    rows = [(k % 3, "u", f"<article><p>Text {k % 5}.</p></article>", *[None] * 3) for k in range(60)]
    pages = spark.createDataFrame(rows, PAGES)
    first = fit_labeller(pages, max_pages=10, rounds=1).weights
    assert np.array_equal(first, fit_labeller(pages.repartition(5), max_pages=10, rounds=1).weights)
    assert extraction.MAX_PAGES < 1_000
