import re
import time
from html import unescape

import pytest

from skein.llm import html_extract as H


def text(html):
    return " ".join(t for _, main, t in H.main_blocks(H.parse(html)) if main)


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">menu</a></li></ul></nav><div class="ad">buy</div><!-- note <p>x</p> -->
<div id="content"><article><h1>Title &amp; more</h1><p>First   para
graph<br>goes <b>on. <p>Second&nbsp;one.<ul><li>a<li>b</ul><form><p>mail</form><aside>side</aside>
<section class="comments"><p>I think this is a much longer comment than the article itself, really much longer, and longer.</p></section></article></div>
<div class="cookie-notice">cookies</div><footer>foot</footer></body></html>"""


def test_a_page_with_everything():
    assert text(PAGE) == "Title & more First para graph goes on. Second one. a b"


@pytest.mark.parametrize("html, expected", [(None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a b"), ("<body><p>cut off <b", "cut off <b"), ("<script>x", ""), ("<p title='a>b'>c</p>", "c"), ('<p title="open>d</p>', "d"), ("<div><p>1 &lt; 2</p></div>", "1 < 2"), ("</div></p>x", "x")])
def test_fragments(html, expected):
    assert text(html) == expected


def test_hosts_agree(spark):
    body = lambda main, side: f'<div class="main7"><p>{main}</p></div><div class="box"><p>{side}</p></div>'
    rows = [(i, f"http://h/{i}", body("long text " * 9, "short")) for i in range(3)] + [(3, "http://H/3", body("tiny", "a box that is much longer here")), (4, None, "<p>alone</p>"), (5, "http://h/5", None), (5, "http://h/5", None), (6, "http://h/6", "<article>other</article>")]
    df = spark.createDataFrame([(*r, "c", "d", 1) for r in rows], "page_id long, url string, html string, host string, path string, salt int")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in H.extract(df).collect()]
    assert sorted(got)[3:] == [(3, "tiny", 4), (4, "alone", 5), (5, "", 0), (5, "", 0), (6, "other", 5)]
    assert H.extract(df.limit(0)).count() == 0


def test_driver_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {}
    for r in pages.collect():
        m = re.search(r"<article>(.*?)(</article>|<footer|$)", r["html"], re.S)
        parts = re.sub(r"</?(p|h1|br|div)\b[^>]*>", " ", m[1])
        want[r["page_id"]] = " ".join(unescape(re.sub(r"<[^>]+>", "", parts)).split())
    assert {r["page_id"]: r["text"] for r in H.extract(pages).collect()} == want


LONG = "A sentence of the article that goes on for a while. " * 4


@pytest.mark.parametrize(
    "html, expected",
    [
        (f'<div class="content has-sidebar"><p>{LONG}</p></div>', LONG),
        (f'<body class="single"><div class="site-content comments-open"><p>{LONG}</p></div><div class="sidebar"><p>{LONG}</p></div><div class="post-comments"><p>{LONG * 3}</p></div>', LONG),
        (f'<article><p>{LONG}</p><div class="related-work"><p>others did</p></div><div class="related-posts"><a href="/">more</a></div></article>', LONG + " others did"),
        (f'<div id="page"><div class="intro"><p>{LONG}</p></div><section class="deep"><p>{LONG * 2}</p></section><div class="box"><p>buy</p></div></div>', LONG * 3),
        (f'<form id="aspnet"><div class="menu-wrapper"><div id="main"><h1>T</h1><p>{LONG}</p></div></div></form>', "T " + LONG),
        (f'<main><header><h1>T</h1></header><p>{LONG}</p></main><section id="comments"><article class="comment"><p>{LONG * 5}</p></article></section>', "T " + LONG),
        (f'<aside><article><p>{LONG}</p></article></aside>', LONG),
        ('<div class="ad">only this</div>', "only this"),
        (f'<div class="entry-header"><h1>T</h1></div><div class="entry"><p>{LONG}</p></div>', "T " + LONG),
    ],
)
def test_names_alone_drop_no_article(html, expected):
    assert text(html) == " ".join(expected.split())


@pytest.mark.parametrize("tags", ["<div>" * 100_000, "<b><blink>" * 50_000 + "</section>" * 50_000 + "<h1>", "<p><blink>" * 50_000, "<header>" * 30_000, "<div class='a1 b'>" * 50_000 + "</p>" * 50_000, "<" * 200_000, "<a " * 50_000, "<!--" * 50_000, '<p x="' * 30_000])
def test_hostile_pages(tags):
    import time
    import tracemalloc

    began = time.process_time()
    tracemalloc.start()
    H.main_blocks(H.parse(tags + "<p>x"))
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    assert time.process_time() - began < 30


def test_hosts_by_join_with_salts(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").union(spark.createDataFrame([(10**6 + i, "http://hot/", "" if i % 2 else f"<article>a{i}") for i in range(200)], "page_id long, url string, html string"))
    by = [sorted(map(tuple, H.extract(pages, broadcast_rows=n).collect())) for n in (20_000, 0)]
    assert by[0] == by[1] and len(by[0]) == pages.count()


@pytest.mark.parametrize("name", ["promotion", "header", "banner", "search", "form", "related"])
def test_an_article_in_a_part_with_a_doubtful_name(name):
    page = f'<article><h1>Promotion rules</h1><div class="{name}"><p>{LONG}</p></div></article>'
    assert text(page) == "Promotion rules " + LONG.strip()
    page = f'<div><article><h1>T</h1><p>{LONG}</p><div class="{name}"><p>buy this</p></div></article><div class="{name}"><p>{LONG * 3}</p></div></div>'
    assert text(page) == "T " + LONG.strip()


@pytest.mark.parametrize(
    "start, again, end",
    [("", "<script ", ""), ("", "<a", ""), ("", "<a '>'", ""), ("", "<a \"x>", "'>"), ("", "<!-", ">"), ("", "</script", ""), ("<script>", "</script ", ""), ("", "<!--x-->", "<!--"), ("<li><ul>" + "<x>" * 100_000, "<li>a</li>", ""), ("", "<p><table><td>", ""), ("", "<div><li>", "</li>" * 1000), ("", "<p '", ">")],
)
def test_time_grows_with_the_page(start, again, end):
    began = time.process_time()
    H.main_blocks(H.parse(start + again * (1_000_000 // len(again)) + end))
    assert time.process_time() - began < 10


def test_markup_that_isnt_ended():
    assert text("<p>a<b") == "a<b" and text("<p>a < b > c") == "a < b > c"
    assert text("<p>a<!-- b") == "a" and text("<p>a <b <!-- x") == "a <b"
    assert text('<p>x</p><div title="a>b<p>y</p>') == "x b y"
    assert text("<title-bar>t</title-bar><title>no</title><p>x") == "t x"
    assert text("<SCRIPT>x</Script ><p>y") == "y"


def test_many_generated_classes_on_one_host(spark, monkeypatch):
    """Each page has paths of its own beside the shared ones; joins give what the broadcast gives."""
    page = "concat('<div class=\"main\"><p>', repeat('long text ', 9), '</p></div><div class=\"q', translate(id, '0123456789', 'abcdefghij'), '\"><p>side</p></div>')"
    pages = spark.range(3000).selectExpr("id AS page_id", "concat('http://h/', id) AS url", f"{page} AS html")
    small, large = (sorted(map(tuple, H.extract(pages, n).collect())) for n in (20_000, 0))
    assert small == large and small[0][2] == ("long text " * 9).strip()
