"""Main text of pages: known articles, odd markup, the tree smoothing against all pairs, and pages of any length in linear time."""

import html
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from phyloquarry.llm import html_extraction as extraction

SF = "/root/testdata/sf0.001"
CASES = [
    ("<main><h1>T &amp; U</h1><p>Body<b>bold</b>text.</p><form><label>Name</label></form><aside>Side.</aside><section class='reader-comments'><p>I think so.</p></section></main><footer>foo</footer>", "T & U Bodyboldtext."),
    ("<p>Only text &nbsp; here", "Only text here"),
    ("plain words, no markup.", "plain words, no markup."),
    ("a < b and c <3", "a < b and c <3"),
    ("<!-- never closed", ""),
    ("<article><p>One<script>var a = '<p>x</p>';</script> two</p></article>", "One two"),
    ("<article><header><h1>Head</h1></header><p>a<br>b</p><pre>x  y</pre><table><tr><td>c<td>d</table></article>", "Head a b x y c d"),
    ("<article><p>One <span class='ad'>buy now</span> two.</p><div class='adSlot'>x</div><p hidden>no</p></article>", "One two."),
    ("<article class='post has-sidebar'><p>Kept.</p></article><article class='comment'><p>Gone.</p></article>", "Kept."),
    ("<header>Site</header><article><p>Kept &eacute;&#233;&#xe9;.</p></article><div id=cookie-notice>We use cookies.</div>", "Kept ééé."),
    ("<div class='post'><p>Hello there, this is the text.</p></div><div class='comments'><p>Nice one, a very long comment, longer than the article.</p></div>", "Hello there, this is the text."),
    ("<p>a</p><style>p {}", "a"),
    ("<p title='a > b'>Quoted.</p>", "Quoted."),
    ("<svg><text>drawn</text></svg><p>Words.</p><noscript>Enable it.</noscript><button>Go</button>", "Words."),
]
UNNAMED = """<body><div><div><a href=x>Home</a> <a href=y>About</a></div><div class="c1"><h2>A title</h2>
<p>First long sentence, with commas, and more words than others have. Then another one follows it.</p><p>Short.</p>
<ul><li>One item here.</li><li>Two <a href=z>linked</a> items.</li></ul></div>
<div class=x9><ul><li><a href=1>Other story</a></li><li><a href=2>More story</a></li></ul></div><div>Made by us 2020</div></div>"""


@pytest.mark.parametrize(("page", "text"), CASES)
def test_pages(page, text):
    assert extraction.main_text(page) == text


def test_ratios_decide_where_nothing_is_named():
    want = "A title First long sentence, with commas, and more words than others have. Then another one follows it. Short. One item here. Two linked items."
    assert extraction.main_text(UNNAMED) == want


def test_smoothing_against_all_pairs():
    draw = random.Random(2)
    parent = [-1] + [draw.randrange(i) for i in range(1, 60)]
    own = [draw.random() for _ in parent]
    above = lambda i: [i, *above(parent[i])] if i >= 0 else []
    paths = [above(i) for i in range(60)]

    def steps(i, j):
        shared = len(set(paths[i]) & set(paths[j]))
        return len(paths[i]) + len(paths[j]) - 2 * shared

    want = [sum(own[j] * extraction.NEAR ** steps(i, j) for j in range(60)) for i in range(60)]
    assert extraction.smoothed(parent, own) == pytest.approx(want)


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "x", '<a "' * 100_000, "<p" * 100_000, "<b>" * 50_000 + "</i>" * 50_000, "<!--" * 50_000, "</p " * 50_000, "<ul><li>a" * 10_000, "<p>" + "word " * 200_000, "&" * 100_000, "<script>" * 20_000])
def test_time_grows_with_length(page):
    began = time.time()
    extraction.main_text(page)
    assert time.time() - began < 10


def test_whole_articles_of_the_table(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet")
    found = {r.page_id: r for r in extraction.op12_html_extraction(spark, SF).collect()}
    assert len(found) == rows.count()
    for r in rows.collect():
        article = r.html.split("<article>")[1].split("</article>")[0]
        spaced = re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)\b[^>]*>", " ", article))
        text = " ".join(html.unescape(spaced).split())
        assert (found[r.page_id].text, found[r.page_id].n_chars, found[r.page_id].url) == (text, len(text), r.url)


def test_odd_rows(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, ""), (2, "v", "<article>é😀</article>"), (3, "w", "<article>" + "<p>long, text.</p>" * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("mine")).withColumn("_page", F.lit(1))
    found = sorted(((r.page_id or 0, r.text, r.n_chars) for r in extraction.extracted(pages, keep=["page_id", "url", "text"]).collect()))
    assert found[:4] == [(0, "", 0), (1, "", 0), (1, "", 0), (2, "é😀", 2)]
    assert found[4][2] == len("long, text.") * 50_000 + 49_999
    assert extraction.extracted(pages).columns == ["page_id", "url", "_page", "text", "n_chars"]
    assert extraction.extracted(pages.where("false")).count() == 0
