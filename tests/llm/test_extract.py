import html
import re

import pytest
from weft.llm import extract

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<header class="site"><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><aside>Side</aside>
<main><article><header><div class="post-header"><h1>Title %d &amp; more</h1></div></header><p>First&nbsp; paragraph   of <b>page %d</b>,
with &lt;tags&gt; &quot;quoted&quot;.<p>Second<br>line <i>%d</i></p><ul><li>one<li>two</ul><div class="ad">Buy</div>
<form><input value="x"><button>Send</button></form><section class="comments"><p>Nice!</p></section></article></main>
<footer>&copy; us</footer><noscript>off</noscript></body></html>"""
TEXT = 'Title %d & more\nFirst paragraph of page %d, with <tags> "quoted".\nSecond line %d\none\ntwo'


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def texts(found):
    return {r.page_id: r.text for r in found.collect()}


@pytest.mark.parametrize("pages", [1, 8])
def test_marked_page(spark, pages):
    rows = [(i, f"https://a.example/{i}", PAGE % (i, i, i)) for i in range(pages)]
    assert texts(extract.extract(frame(spark, rows))) == {i: TEXT % (i, i, i) for i in range(pages)}


def test_template_without_marks(spark):
    """No article element: what all pages share is template, the largest open slot is the text."""
    page = "<body><div class=top><a href=x>Home</a> <b>Welcome to us</b></div><div class=x1><p>Always the same line</p>%s</div><div class=x2>Same end</div></body>"
    own = ["".join(f"<p>Paragraph {i} {j} with some words of its own</p>" for j in range(3 + i % 4)) for i in range(12)]
    rows = [(i, f"http://b.example/{i}", page % own[i]) for i in range(12)]
    want = {i: "\n".join(f"Paragraph {i} {j} with some words of its own" for j in range(3 + i % 4)) for i in range(12)}
    assert texts(extract.extract(frame(spark, rows))) == want


def test_copies_of_a_page_keep_their_article(spark):
    rows = [(i, "https://c.example/same", PAGE % (1, 1, 1)) for i in range(20)]
    assert set(texts(extract.extract(frame(spark, rows))).values()) == {TEXT % (1, 1, 1)}


def test_classes_and_nesting():
    import pandas as pd

    rows = [("/html", 1), ("/html/body", 1), ("/html/body/div", 2), ("/html/body/div/p", 2), ("/html/lost/p", 3), ("/html/lost/q", 3)]
    tokens = pd.DataFrame([(i, p, 9, v) for i, (p, v) in enumerate(rows)] + [(10, None, 0, 2), (11, None, 0, 7)], columns=["token", "path", "chars", "vector"])
    tokens.loc[tokens["path"] == "/html/body/div/p", "chars"] = 500
    assert extract.deduce(tokens) == (["/html/body/div/p"], [10])


def test_given_pages(spark):
    """The given pages have one article each, of p and h1 blocks."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1).replace("<br>", " ")
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article))
        want[r.page_id] = "\n".join(x for x in blocks if x)
    assert texts(extract.extract(pages)) == want


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(extract, "BROADCAST_TOKENS", -1)
    rows = [(i, f"https://a.example/{i}", PAGE % (i, i, i)) for i in range(8)]
    assert texts(extract.extract(frame(spark, rows))) == {i: TEXT % (i, i, i) for i in range(8)}


def test_odd_rows(spark):
    long = "<article>" + "<p>" + "word " * 50_000 + "</article>"
    rows = [
        (1, None, "<article><p>x</p></article>"), (2, "https://a.example/", None), (3, "nonsense", ""), (None, "https://a.example/1", "plain text"),
        (4, "https://a.example/4", long), (4, "https://a.example/4", long), (5, "https://a.example/5", "<p>a<p>b<div><span>c</div>d<"),
        (6, "https://a.example/6", "</div></p><b>x" + "<div>" * 3000 + "deep"), (7, "https://a.example/7", "a < b & c &lt; d <script>never closed <p>no"),
    ]
    from pyspark.sql import functions as F

    pages = frame(spark, rows).withColumns({c: F.lit(1) for c in ("host", "token", "path", "texts", "roots", "total")})
    found = extract.extract(pages)
    assert found.columns == ["page_id", "url", "text"]
    got = sorted(((r.page_id, r.text) for r in found.collect()), key=repr)
    want = [(1, "x"), (2, ""), (3, ""), (None, "plain text"), (4, "word " * 49_999 + "word"), (4, "word " * 49_999 + "word"), (5, "a\nb\nc\nd<"), (6, "x\ndeep"), (7, "a < b & c < d")]
    assert got == sorted(want, key=repr)
    assert extract.extract(frame(spark, [])).count() == 0


@pytest.mark.parametrize("depth", [10, 59, 60, 61, 200, 3000])
def test_end_tags_of_deep_elements_close_those(depth):
    page = "<body><div class=wrap><article><p>one</p>" + "<div>" * depth + "<p>deep</p><div class=ad><div>Buy</div>now</div><aside>Side</aside><p>down</p>"
    page += "</div>" * depth + "<p>two</p></article></div><p>after</p></body>"
    assert extract.page_text(extract.Parser(), page, set(), set()) == "one\ndeep\ndown\ntwo"


def test_an_article_below_many_elements():
    page = "<body>" + "<div>" * 100 + "<p>menu</p><article><p>text <a href=x>link</a> on</p></article><p>after</p>" + "</div>" * 100
    assert extract.page_text(extract.Parser(), page, set(), set()) == "text link on"


def test_noise_words_of_headings_and_inline_elements_within_content():
    page = '<article><h2 id="discussion">Discussion</h2><p>code <span class="hljs-comment">note</span></p><div id="comments">Nice</div></article>'
    assert extract.page_text(extract.Parser(), page, set(), set()) == "Discussion\ncode note"


WRAPPERS = [
    '<div class="layout with-sidebar"><article>%s</article></div>', '<form id="aspnetForm"><div><article>%s</article></div></form>',
    '<div class="menu-open"><main>%s</main></div>', '<div class="elementor-widget"><div class="elementor-widget-container"><article>%s</article></div></div>',
]


@pytest.mark.parametrize("pages", [1, 8])
@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_an_article_in_a_wrapper_with_a_noise_word(spark, wrapper, pages):
    """A layout's class word does not make the article below it noise; what lies in the article still can be."""
    own = [f"<h1>Title {i}</h1><p>Sentence {i} of this page alone, number {i * 7}.</p>" for i in range(pages)]
    around = '<body><nav>Home</nav><div class="top">Hello</div>%s<div class="sidebar"><p>Side</p></div><footer>us</footer></body>'
    inside = '<div class="widget">Buy</div><section class="comments"><article>Nice</article></section>'
    rows = [(i, f"https://w.example/{i}", around % (wrapper % (x + inside))) for i, x in enumerate(own)]
    want = {i: f"Title {i}\nSentence {i} of this page alone, number {i * 7}." for i in range(pages)}
    assert texts(extract.extract(frame(spark, rows))) == want


@pytest.mark.parametrize("pages", [1, 8])
@pytest.mark.parametrize("word", ["comments", "related", "sidebar"])
def test_articles_in_noise_beside_the_text_stay_noise(spark, word, pages):
    """Neither beside marked content nor beside plain text that is longer."""
    for text in ('<div class="post-body">%s</div>', "<div>%s</div>"):
        own = [f"<p>Sentence {i} of this page alone, with some more words in it.</p>" for i in range(pages)]
        rows = [(i, f"https://n.example/{i}", f'<body>{text % x}<div class="{word}"><article>Card {i}</article></div></body>') for i, x in enumerate(own)]
        want = {i: f"Sentence {i} of this page alone, with some more words in it." for i in range(pages)}
        assert texts(extract.extract(frame(spark, rows))) == want


def test_comments_and_menus_hold_no_article():
    for wrapper in ('<div class="comments">%s</div>', "<aside>%s</aside>", '<div role="navigation">%s</div>'):
        page = "<body><p>x</p>" + wrapper % "<article>a longer text than the page has</article>" + "</body>"
        assert extract.page_text(extract.Parser(), page, set(), set()) == "x"
