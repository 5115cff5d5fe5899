"""HTML extraction: whole pages against the article element, odd markup, and the cut against all labellings."""

import html
import re
from itertools import product

import numpy as np
import pyarrow.parquet as pq
import pytest

from tidewright.llm import html_text as H
from tidewright.llm.queries import QUERIES


def article(page):
    """What the pages here mark as the article, by a plain reading."""
    body = re.search(r"<article>(.*)</article>", page or "", re.S)
    parts = re.split(r"</?(?:p|h1|article)\b[^>]*>", body[1]) if body else []
    texts = [" ".join(html.unescape(re.sub(r"<[a-z/][^>]*>", lambda m: " " if m[0] == "<br>" else "", x)).split()) for x in parts]
    return "\n".join(x for x in texts if x)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    want = {r["page_id"]: article(r["html"]) for r in pq.read_table(f"{sf}/pages.parquet").to_pylist()}
    got = QUERIES["op7_html_text"](spark, sf).collect()
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_a_page_without_article():
    page = """<html><head><title>T</title></head><body class="nav-open"><header><h1>Site</h1></header>
    <div class="menu-top"><a href=/>Home</a> <a href=/x>About us and all the rest</a></div>
    <div id="wrap"><div><h2>A headline</h2><p>This is the first paragraph of the story, and it goes on for a while &amp; more.</p>
    <p>Short one.</p><p>And a last paragraph that has a <a href=z>link</a> in it, followed by enough words to count.</p></div>
    <form><label>Name</label><input><textarea>type</textarea></form>
    <div class="cookie-notice">We use cookies to make this site better for you and for us all.</div></div>
    <aside>Other things that you may like to read today, they are all here.</aside>
    <section id="comments"><p>I do not agree with a single word of this long story, says a reader.</p></section>
    <footer>&copy; all of it</footer><script>if (a < b) document.write("<p>no</p>")</script></body></html>"""
    assert H.main_text(page) == "A headline\nThis is the first paragraph of the story, and it goes on for a while & more.\nShort one.\nAnd a last paragraph that has a link in it, followed by enough words to count."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<article><p>a<br>b <i>c</i>d &lt;p&gt; &#233;&eacute; &nbsp;x</article>", "a b cd <p> éé x"),
        ("<article><p>one<p>two</p>three<div>four</article>five", "one\ntwo\nthree\nfour"),
        ("<article><table><tr><td>1<td>2<tr><td>3</table><ul><li>a<li>b</ul></article>", "1\n2\n3\na\nb"),
        ("<article><p>x<!-- <p>hidden --> y</p><style>p{}</style><nav>n</nav><p hidden>h</p></article>", "x y"),
        ("<article><p>3 < 4 and 5 > 4</p><p title='a > b'>z</p></article>", "3 < 4 and 5 > 4\nz"),
        ("<article></article>", ""),
        ("<article><p>unclosed <!-- comment", "unclosed"),
        ("<article><pre>a\n  b</pre><p>c</p><script>never closed", "a b\nc"),
    ],
)
def test_markup(page, text):
    assert H.main_text(page) == text


ONE = "The first paragraph of the story goes on for a while, as they do, and then it ends."
TWO = "A second paragraph has rather more to say about the matter than the first one did."


@pytest.mark.parametrize(
    "page",
    [
        f'<div class="has-sidebar"><article><p>{ONE}</p><p>{TWO}</p></article></div>',
        f'<div class="layout no-sidebar"><main><p>{ONE}</p><p>{TWO}</p></main></div>',
        f'<div class="sidebar"><article><p>{ONE}</p><p>{TWO}</p></article></div>',
        f'<div id="content" class="no-ads"><p>{ONE}</p><p>{TWO}</p></div>',
        f'<form id=page><main><p>{ONE}</p><p>{TWO}</p><form><p>Sign up here for all of our news now.</p></form></main></form>',
        f'<article><p class="ad-hoc">{ONE}</p><p data-id="comment-12">{TWO}</p></article>',
        f'<article><p title="a hidden gem">{ONE}</p><p data-hidden="false">{TWO}</p></article>',
        f'<article><a href="/hidden-gems"><p>{ONE}</p></a><p>{TWO}</p></article>',
        f"<article><p><a href=/it's>The first</a>{ONE[9:]}</p><p>{TWO}</p></article>",
        f'<article><p title="unclosed>{ONE}</p><p>{TWO}</p></article>',
        f"<article><p title='a \"quoted\" > one'>{ONE}</p><p id=x class='b'>{TWO}</p></article>",
        f'<main><p>{ONE}</p><p>{TWO}</p><section id="comments"><article class="comment"><p>I do not agree with a single word of it, and never will.</p></article></section></main>',
        f'<article><p>{ONE}</p><p>{TWO}</p><ol><li id="comment-12"><p>I do not agree with a single word of it, and never will.</p></li></ol></article>',
        f'<article><p>{ONE}</p><p>{TWO}</p></article><div class="related"><article><p>Read this other thing here today.</p></article></div>',
        f"<div class=page><div><a href=/>Home</a> <a href=/x>About us</a></div><div>{ONE}</div><div>{TWO}</div><div>Share</div></div>",
        f"<article><svg/><p>{ONE}</p></ p><!--> <p>{TWO}</p></article>",
        "<nav>" * 600 + "<p>Menu</p>" + "</nav>" * 600 + f"<p>{ONE}</p><p>{TWO}</p>",
    ],
)
def test_names_and_attributes(page):
    fitted = H.fitted(*training("/root/testdata/sf0.001"))
    assert H.main_text(page) == H.main_text(page, fitted) == f"{ONE}\n{TWO}"


def training(sf):
    rows, labels = [], []
    for r in pq.read_table(f"{sf}/pages.parquet").to_pylist():
        x, hard, inside, _ = H.features(H.parsed(r["html"]))
        rows.append(x[~hard])
        labels.append(inside[~hard])
    return np.vstack(rows), np.concatenate(labels).astype(float)


def test_fit_is_the_least_loss(spark):
    rows, labels = training("/root/testdata/sf0.001")
    share = np.where(labels > 0, min(1, (1 - labels).sum() / labels.sum()), min(1, labels.sum() / (1 - labels).sum()))

    def loss(w):
        z = rows @ np.array(w)
        return float((share * (np.logaddexp(0, z) - labels * z)).sum() + 25 * ((np.array(w) - np.array(H.PRIOR)) ** 2).sum())

    w = H.fitted(rows, labels)
    assert loss(w) < loss(H.PRIOR)
    for i in range(len(w)):
        for step in (-1e-3, 1e-3):
            assert loss(w) <= loss([x + step * (k == i) for k, x in enumerate(w)])
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert H.fit(pages) == pytest.approx(w, abs=1e-4)
    assert H.fit(pages.where("false")) == H.PRIOR


def test_random_markup_never_fails():
    rng = np.random.default_rng(11)
    bits = ["<p>", "</p>", "<div class='", '"', "'", ">", "<a href=", "</a>", "<article>", "</article>", "text. ", "<!--", "-->", "<script>", "</script>", "<", "</", "&amp", "&#0;", "<li>", "<table><td>", "\n", "=", "/", "<button>", "\u0130"]
    for _ in range(4000):
        H.main_text("".join(rng.choice(bits, rng.integers(0, 40))))


def test_cut_is_the_cheapest():
    rng = np.random.default_rng(7)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        gain = rng.normal(0, 2, n).round(2).tolist()
        edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, n, 12), rng.integers(0, n, 12), rng.random(12).round(2) * 2) if a != b]

        def cost(x):
            return sum(g if g > 0 and not k else -g if g < 0 and k else 0 for g, k in zip(gain, x)) + sum(w for a, b, w in edges if x[a] != x[b])

        assert cost(H.min_cut(gain, edges)) == pytest.approx(min(map(cost, product([False, True], repeat=n))))


def test_a_long_page():
    page = "<article>" + "".join(f"<p>Paragraph {i} has some words.</p><div class=ad>buy</div>" for i in range(20_000)) + "</article>"
    assert H.main_text(page).count("\n") == 19_999


def test_markup_that_never_closes():
    assert H.main_text("<article>" + "<div>word " * 30_000).count("word") == 30_000


def test_odd_rows(spark):
    rows = [(1, None, None, "x"), (None, "u", "<article><p>t</article>", "y"), (2, "u", "plain text only, but it is long enough to be kept as the text.", None), (2, "u", "plain text only, but it is long enough to be kept as the text.", None)]
    got = sorted((r.page_id or 0, r.url, r.text) for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect() if r.page_id != 1)
    assert got == [(0, "u", "t")] + [(2, "u", "plain text only, but it is long enough to be kept as the text.")] * 2
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
