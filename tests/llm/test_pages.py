"""Main texts of generated pages whose articles are known, and of pages made to be hard to read."""

import random
import time

import pytest

from quillstream.llm import html_text

OUTER = ['<nav class="x"><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>', '<div class="ad-slot">Buy this, now, and more, of it, today.</div>', '<div id="sidebar-left"><p>Other things, to read, in short.</p></div>', '<div class="cookie-notice"><p>We use cookies, many of them.</p></div>', "<aside><p>Related, things, here.</p></aside>", "<form><p>Your name, please</p><input></form>", '<section id="comments"><p>I like it, very, very much, thanks.</p></section>', "<script>var t = '<p>no</p>';</script>", "<footer>c 2024, all of it</footer>", '<header class="site"><p>Slogan, and more, of it</p></header>']


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma,", "delta", "eps", "zeta,", "eta"]) for _ in range(n)).strip(",") + "."


def block(rng):
    """(markup, text) of a block of an article."""
    text = words(rng, rng.randrange(2, 60))
    kind = rng.randrange(8)
    if kind == 0:
        return f"<h2>{text}</h2>", [text]
    if kind == 1:
        return f"<p>{text} <a href='x'>link text</a> and <b>bold</b> &amp; more</p>", [f"{text} link text and bold & more"]
    if kind == 2:
        return "<ul>" + "".join(f'<li><a href="s{i}">Source {i}</a></li>' for i in range(3)) + "</ul>", [f"Source {i}" for i in range(3)]
    if kind == 3:
        return f"<blockquote><p>{text}</p></blockquote>", [text]
    if kind == 4:
        return f'<div class="{rng.choice(["share-price", "search-results-table", "side-by-side", "promo-free"])}">{text}</div>', [text]
    if kind == 5:
        return f"<p>one<br>two\n   three {text}", [f"one two three {text}"]
    if kind == 6:
        return f"<p>{text} <math><mi>x</mi></math> &#0000065;&#x42;</p>", [f"{text} x AB"]
    return f"<p>{text}</p>", [text]


@pytest.mark.parametrize("seed", range(60))
def test_op10_known_articles(seed):
    rng = random.Random(seed)
    made = [block(rng) for _ in range(rng.randrange(3, 15))]
    shape = rng.randrange(3)
    body = "".join(m for m, _ in made)
    article = f"<article><h1>Title here</h1>{body}</article>" if shape == 0 else f'<main><div class="no-sidebar"><h1>Title here</h1>{body}</div></main>' if shape == 1 else f'<div class="with-header"><article><h1>Title here</h1>{body}</article></div>'
    around = rng.sample(OUTER, rng.randrange(1, len(OUTER)))
    at = rng.randrange(len(around) + 1)
    page = "<!DOCTYPE html><html><head><title>T</title></head><body>" + "".join(around[:at]) + article + "".join(around[at:]) + "</body></html>"
    assert html_text.main_text(page) == "\n\n".join(["Title here", *[t for _, ts in made for t in ts]])


def test_op10_article_over_siblings():
    page = "<body><div id=a><p>One two three.</p><p>Four five six, seven.</p><p>Eight nine ten.</p></div><div id=b><p>The close.</p></div></body>"
    assert html_text.main_text(page) == "One two three.\n\nFour five six, seven.\n\nEight nine ten.\n\nThe close."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<a title="x>two</a>', "two"),
        ("<div>" * 450 + "<nav>Home About</nav><p>A paragraph, with text.</p>", "A paragraph, with text."),
        ("<p>a &#99999999999; b</p>", "a � b"),
        ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
        ("<p>a</ >b<//c>d</p>", "abd"),
    ],
)
def test_op10_odd_markup(page, want):
    assert html_text.main_text(page) == want


PARTS = "<p>One two three, four.</p><p>Five six seven.</p>"
READ = "One two three, four.\n\nFive six seven."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<article>{PARTS}<p title="the hidden truth">Eight.</p><p class="lead hidden md">Nine.</p><p data-x="display: none">Ten.</p></article>', READ + "\n\nEight.\n\nNine.\n\nTen."),
        (f'<article>{PARTS}<p aria-hidden="true">Eight.</p></article>', READ + "\n\nEight."),
        (f'<article>{PARTS}<p hidden>No.</p><div HIDDEN="">No.</div><p style="color: red; display : none">No.</p></article>', READ),
        (f'<body><form action="/"><input type="hidden" name="s"><nav><a href="a">Home</a></nav><div>{PARTS}</div><footer>End</footer></form></body>', READ),
        (f'<body><form><h1>Title</h1><div>{PARTS}<form><label>Name</label><input></form></div></form></body>', "Title\n\n" + READ),
        (f"<body><article>{PARTS}</article><form><p>Write to us about what you have read here, please, all of you, at any time</p><input><textarea>x</textarea></form></body>", READ),
        ("<body><form><p>Your name</p><input><p>Your word</p><input></form></body>", ""),
        (f"<body><section>{PARTS * 2}</section><section><h2>Sub</h2><ul><li>Aa</li><li>Bb</li></ul></section></body>", f"{READ}\n\n{READ}\n\nSub\n\nAa\n\nBb"),
        (f"<body><div>{PARTS * 4}</div><div>The close.</div></body>", "\n\n".join([READ] * 4) + "\n\nThe close."),
        (f'<body><div class="x1"><a href="a">Home</a> <a href="b">News</a></div><div>{PARTS}</div><div class="x2"><a href="c">About</a> us</div></body>', READ),
        (f"<body><div>{PARTS * 2}</div><table><tr><td>Aa</td><td>Bb</td></tr></table><ul><li>Cc</li></ul></body>", f"{READ}\n\n{READ}\n\nAa\n\nBb\n\nCc"),
    ],
)
def test_op10_nothing_else_is_dropped(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize("page", ["<a " + "b" * 10**6, "<a " + "b " * 400_000 + "=", "<form>" * 100_000 + "x", '<a b="' * 170_000, "<div>" * 100_000 + "x" + "</b>" * 100_000, "<div><p>aa, bb</p>" * 55_000, "<a " + 'b= " ' * 200_000, "<" * 10**6, "<p>" + "word, " * 170_000, "&#" + "1" * 10**6 + ";", "<a class=" + "'\"" * 400_000])
def test_op10_long_pages(page):
    """A page of a megabyte takes a time that grows with its length."""
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 30


def test_op10_empty_table(spark):
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string, text int")).count() == 0
