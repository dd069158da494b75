"""Block rules on whole pages: an independent reading of marked articles, and pages whose containers say nothing."""

import re
from collections import Counter
from html.parser import HTMLParser
from pathlib import Path

import pytest

from quilt.llm import html_text

PAGES = Path("/root/testdata/sf0.01/pages.parquet")
BLOCKS = {"p", "h1", "h2", "h3", "li", "ul", "ol", "div", "blockquote", "section", "article", "table", "tr", "td", "pre", "figure", "figcaption"}
OUT = {"nav", "aside", "footer", "form", "script", "style", "header", "title"}


class Reader(HTMLParser):
    """Text of the blocks of every article, by the parser of the standard library."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside = self.out = 0
        self.lines, self.now = [], []

    def cut(self):
        line = re.sub(r"\s+", " ", "".join(self.now)).strip()
        if line:
            self.lines.append(line)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.cut()
        if tag == "br":
            self.now.append(" ")
        self.inside += tag == "article"
        self.out += tag in OUT

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.cut()
        self.inside -= tag == "article"
        self.out -= tag in OUT

    def handle_data(self, data):
        if self.inside and not self.out:
            self.now.append(data)


@pytest.fixture(scope="module")
def pages():
    if not PAGES.exists():
        pytest.skip("no table of pages here")
    import pyarrow.parquet as pq

    return [x or "" for x in pq.read_table(PAGES).column("html").to_pylist()]


def plain(page):
    return not re.search(r"<(section|div)\b", page[page.find("<article") : page.rfind("</article>")])


def test_marked_articles_are_read_as_an_independent_parser_reads_them(pages):
    compared = 0
    for page in filter(plain, pages):
        reader = Reader()
        reader.feed(page)
        reader.close()
        reader.cut()
        assert html_text.main_text(page) == "\n".join(reader.lines)
        compared += 1
    assert compared >= 0.8 * len(pages)


def test_stop_words_and_neighbours_decide_most_blocks_of_articles(pages):
    rules = Counter(b.rule for page in pages for b in html_text.judged(page) if b.main)
    assert rules["stop-word density"] > 0.3 * rules.total()
    assert rules["stop-word density"] + rules["neighbours"] > 0.85 * rules.total()


def test_pages_whose_article_is_not_marked_give_nearly_the_same_text(pages):
    kept = wanted = 0
    for page in pages:
        bare = Counter(html_text.main_text(page.replace("<article", "<div").replace("</article>", "</div>")).split("\n"))
        whole = Counter(html_text.main_text(page).split("\n"))
        assert bare.total() == 0 or not bare - whole - Counter([""])
        kept += sum(len(x) * k for x, k in (bare & whole).items())
        wanted += sum(len(x) * k for x, k in whole.items())
    assert kept >= 0.95 * wanted


def test_a_very_long_page_is_read_whole():
    prose = "This is what it was like for all of them, and it is not what they had been told at the time. "
    page = "<nav><a href=/>Home</a></nav>" + "".join(f"<p>{prose * 3}{i}</p><p>No.</p>" for i in range(20_000))
    lines = html_text.main_text(page).split("\n")
    assert len(lines) == 40_000 and lines[-2].endswith("19999") and lines[-1] == "No."
