"""HTML extraction: places, selection by scores, odd pages, and a plain reading of the given pages."""

import time
from html.parser import HTMLParser

import pytest

from sparkcols.llm import html_text

LINE = "Long enough sentence, with some punctuation. "


def text(page):
    return html_text.main_text(page)


def test_all_chosen_siblings_are_kept():
    page = f"<body><div class=intro><p>In {LINE}</p></div><div class=rest><p>{LINE * 6}</p><p>Out {LINE}</p></div></body>"
    assert text(page) == " ".join(f"In {LINE}{LINE * 6}Out {LINE}".split())


def test_heading_beside_the_text_and_short_paragraphs_are_kept():
    page = f"<body><h1>Title</h1><div class='text'><p>{LINE * 3}</p><p>Short.</p></div><div>copyright</div></body>"
    assert text(page) == "Title " + (LINE * 3) + "Short."
    page = f"<body><div id=page><div>Site</div><div><h2>T</h2><p>Few.</p><div><p>{LINE}</p></div><ul><li>one</ul></div><div>x</div></div>"
    assert text(page) == f"T Few. {LINE}one"


def test_modifiers_cut_nothing_and_names_do():
    page = f"""<article><div class='has-sidebar'><p>A {LINE}</p></div><div class='no-comments'><p>B {LINE}</p></div>
    <p class='promo-code-explained'>C {LINE}</p><div class='left sidebar-left'>{LINE * 8}</div>
    <section id=comments><article class='comment-body'><p>{LINE * 9}</p></article></section></article>
    <div class="cookie-banner">{LINE * 4}</div><div role="complementary">{LINE * 4}</div>"""
    assert text(page) == " ".join(f"A {LINE}B {LINE}C {LINE}".split())
    assert text(f"<div class=page-widget><main><p>{LINE}</p></main></div>") == LINE.strip()


@pytest.mark.parametrize(
    "name, place",
    [("site-footer", True), ("comment-list", True), ("adBox", True), ("ad-300x250", True), ("nav--main", True),
     ("site-header", True), ("entry-header", False), ("has-sidebar", False), ("layout--with-sidebar", False),
     ("promo-code-explained", False), ("shadow", False), ("", False), ("list", False)],
)
def test_names_of_places(name, place):
    assert html_text.names_place(name) == place


def test_menus_without_names_and_pages_of_links():
    links = "<a href=a>Home</a> <a href=b>About</a> <a href=c>News</a>"
    assert text(f"<body><div>{links}</div><div><p>{LINE}</p><p>{LINE}</p></div></body>") == (LINE * 2).strip()
    assert text(f"<body><ul><li>{links}</li></ul></body>") == ""
    assert text(f"<article><p>{LINE}</p><div>{links}</div></article>") == f"{LINE}Home About News"


@pytest.mark.parametrize("piece", ['<a "', '<a x="', "<div>x", "</div>", "<div>x</p>", "<p>", "<script>", "<!--", "<", "<svg>"])
def test_time_is_linear_in_odd_pages(piece):
    start = time.time()
    text(piece * 60000)
    assert time.time() - start < 20


class Plain(HTMLParser):
    """All text inside article elements; the given pages have no other places in them."""

    def __init__(self):
        super().__init__()
        self.depth, self.found = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.found += [] if tag in html_text.INLINE else [" "]

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.found += [] if tag in html_text.INLINE else [" "]

    def handle_data(self, data):
        self.found += [data] if self.depth > 0 else []


def test_given_pages_equal_a_plain_reading(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {}
    for row in pages.collect():
        plain = Plain()
        plain.feed(row.html or "")
        plain.close()
        want[row.page_id] = " ".join("".join(plain.found).split())
    got = html_text.extract(pages).collect()
    assert {r.page_id: r.text for r in got} == want and len(got) == len(want)
    assert all(r.n_chars == len(r.text) for r in got)


def test_odd_rows(spark):
    rows = [(1, "u", f"<p>{LINE}</p>", "x")] * 2 + [(None, None, None, None), (2, "", "", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in html_text.extract(df).collect())
    assert got == [(0, "", 0)] + [(1, LINE.strip(), len(LINE) - 1)] * 2 + [(2, "", 0)]
    assert html_text.extract(df.limit(0)).count() == 0
