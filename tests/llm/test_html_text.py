from __future__ import annotations

import random
import time

import pytest

from tests.llm.frames import clashing
from tidemark.llm import html_text
from tidemark.llm.html_text import common_lines, parse

PAGES = "page_id long, url string, html string"


def main_text(source):
    page = parse(source)
    return [x for x, k, m in zip(page.lines, page.kept, page.main) if k and m]


def test_article_alone_is_kept():
    source = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head>
    <body class="has-sidebar"><header>Top</header><nav><ul><li><a href="/">Home</a></ul></nav><!-- ad <p>x</p> -->
    <div class="ad">Buy</div><main><article><h1>A &amp; B</h1><p>One<br>two  <b>three<p>Four &lt;tag&gt; &#8364;</p>
    <div class='share-buttons'>Share</div><form><input><button>Go</button></form><aside>Side</aside>
    <ul><li>item 1<li>item 2</ul><section id=comments><p>Reader says</section></article></main>
    <div role="complementary">R</div><footer>&copy; x</footer></body></html>"""
    assert main_text(source) == ["A & B", "One two three", "Four <tag> €", "item 1", "item 2"]


@pytest.mark.parametrize("wrapper", [
    "class='layout has-sidebar'", "id='no-ads'", "class='page-overlay'", "id=sidebar class='ad'",
])
def test_a_wrapper_keeps_its_article(wrapper):
    source = (f"<body><div class='ad'>Buy</div><div {wrapper}><div class='widget'><nav>Menu</nav><article><p>Story</p>"
              "<div class='ad'>Buy more</div></article></div></div><nav class='ad'><article>No</article></nav></body>")
    assert main_text(source) == ["Story"]
    teaser = "<main>Story</main><div class='related'><article>Teaser</article></div>"
    assert main_text(teaser) == ["Story"]


@pytest.mark.parametrize("source", [
    "", "<", "<p", "plain text", "<p class='a>b", "<<<>>>", "</p></div>", "<script>never ends", "<!-- never ends",
    "<b>" * 5000 + "x" + "</b>" * 5000, "<div>" * 3000, "&#xD800; &bogus; &#99999999;", '<a title=">">y</a>',
])
def test_broken_markup_does_not_crash(source):
    parse(source)


@pytest.mark.parametrize("bits", [500_000_000, 6])
def test_alignment_is_longest(monkeypatch, bits):
    monkeypatch.setattr(html_text, "LCS_BITS", bits)
    random.seed(1)
    for _ in range(800):
        a, b = ([random.randrange(5) for _ in range(random.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        found = common_lines(a, b)
        rest = iter(b)
        assert len(found) == table[-1][-1] and all(a[i] in rest for i in found) and found == sorted(set(found))


def page(i, body):
    return f"<html><body><div>Site</div><div>Menu of it</div><p>{body}</p><p>Own line {i}</p><div>End</div></body></html>"


def test_template_lines_are_deleted(spark, monkeypatch):
    monkeypatch.setattr(html_text, "RANGE_PAGES", 3)  # neighbours across ranges too
    rows = [(i, f"http://h.net/news/{i:03}", page(i, f"Story number {i} with its own words")) for i in range(20)]
    rows += [(90, "http://alone.net/", page(90, "Nobody near")), (91, None, page(91, "No url")), (92, "http://h.net/x", None)]
    docs = clashing(spark.createDataFrame(rows, PAGES).repartition(4), "text", "n_chars", "lines")
    out = html_text.extract_text(docs)
    assert out.columns == ["page_id", "url", "lines", "text", "n_chars"]
    by_id = {r.page_id: r for r in out.collect()}
    for i in range(20):
        assert by_id[i].text == f"Story number {i} with its own words\nOwn line {i}"
        assert by_id[i].n_chars == len(by_id[i].text)
    assert by_id[90].text.startswith("Site\nMenu of it\nNobody near") and by_id[92].text == ""


@pytest.mark.parametrize("pages", [2000, 3])
def test_template_lines_inside_articles_are_deleted(spark, monkeypatch, pages):
    """Lines along the whole run of a host go; passages that some articles share stay."""
    monkeypatch.setattr(html_text, "RANGE_PAGES", pages)
    article = lambda i, more="": (
        f"<body><nav>Menu</nav><main><div>Home &gt; News</div><p>Story number {i} with its own words</p>{more}"
        f"<p>Another long line that only page {i} has</p><p>Get our letter</p></main></body>")
    rows = [(i, f"http://h.net/news/{i:03}", article(i, "<p>A licence</p>" if i % 10 < 4 else "")) for i in range(30)]
    rows += [(100 + i, f"http://few.net/{i}", article(i)) for i in range(6)]
    out = {r.page_id: r for r in html_text.extract_text(spark.createDataFrame(rows, PAGES).repartition(4)).collect()}
    for i in range(30):
        licence = ["A licence"] if i % 10 < 4 else []
        want = [f"Story number {i} with its own words", *licence, f"Another long line that only page {i} has"]
        assert out[i].text == "\n".join(want) and out[i].n_chars == len(out[i].text)
    for i in range(6):
        assert out[100 + i].text.startswith("Home > News\nStory") and out[100 + i].text.endswith("Get our letter")


def test_copies_do_not_delete_each_other(spark):
    same = page(1, "The same story")
    rows = [(1, "http://h.net/a", same), (2, "http://h.net/b", same), (3, "http://h.net/b", same)]
    out = html_text.extract_text(spark.createDataFrame(rows, PAGES)).collect()
    assert all("The same story" in r.text for r in out) and len(out) == 3


def test_empty_table(spark):
    assert html_text.extract_text(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize("unit", ["<a ", '<p x="', "<p x='", "<svg>", "<a<", "<!", "<!-", "</", "<p '>", '<p ">" ', "<b>x",
                                  "<div><p>", "<script>", "&#", "<p \"'>"])
def test_broken_markup_takes_linear_time(unit):
    begin = time.perf_counter()
    parse(unit * (1_000_000 // len(unit)))
    assert time.perf_counter() - begin < 4


@pytest.mark.parametrize("opening, closing", [
    ('<article class="post-1 comments-open">', "</article>"), ('<div class="post-content share-enabled">', "</div>"),
    ('<section class="related-work">', "</section>"), ("<div role='main'>", "</div>"), ("<div ROLE=main id=a>", "</div>"),
    ('<main class="has-comments">', "</main>"), ('<div class="search-results-2024">', "</div>"),
])
def test_a_word_in_a_name_does_not_drop_the_text(opening, closing):
    page = parse(f"<body><nav>Menu</nav>{opening}<p>The story</p><div class='share-buttons'>Share</div>{closing}</body>")
    assert [x for x, k in zip(page.lines, page.kept) if k] == ["The story"]
    assert main_text(f"<main>{opening}<p>The story</p>{closing}</main>") == ["The story"]


@pytest.mark.parametrize("attribute", [
    "class='comments'", "class='post-comments'", "id='cookie-banner'", "class='ad ad-top'", "class='x sidebar_right'",
    "role=navigation", "id=\"comment-list\"", "class='widget-2'",
])
def test_whole_names_still_drop(attribute):
    assert main_text(f"<main><p>Story</p><div {attribute}>Other</div></main>") == ["Story"]
