"""Web pages: the element tables against a tree built by the standard parser, and cases by hand."""

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from strataloom.operators.html_tree import REMOVED, VOID, absolute, elements, main_parts
from strataloom.operators.web import prepared_pages

SCHEMA = "page_id long, url string, html string"


class Tree(HTMLParser):
    """Nested lists [tag, attributes, children]; paragraphs end where another one begins."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.top = ["#", {}, []]
        self.open = [self.top]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "div", "article", "h1", "h2", "h3", "ul", "ol", "table", "footer", "section", "aside", "nav", "form") and "p" in [x[0] for x in self.open]:
            while self.open[-1][0] != "p":
                self.open.pop()
            self.open.pop()
        node = [tag, dict(attrs), []]
        self.open[-1][2].append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        if tag in [x[0] for x in self.open[1:]]:
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.open[-1][2].append(data)


def walk(node):
    yield node
    for x in node[2]:
        if not isinstance(x, str) and x[0] not in REMOVED and "hidden" not in x[1] and x[1].get("aria-hidden") != "true":
            yield from walk(x)


def text_of(node):
    return "".join(x if isinstance(x, str) else text_of(x) for x in node[2] if isinstance(x, str) or next(iter(walk([0, {}, [x]])), 0) and len(list(walk(["#", {}, [x]]))) > 1)


def tidy(x):
    return re.sub("\n{4,}", "\n\n\n", re.sub("[  ]{2,}", " ", x.replace("\r\n", "\n").replace("\t", " "))).strip()


def brute(page, url):
    nodes = list(walk(Tree(page).top))
    root = next((n for test in (lambda n: n[0] == "article", lambda n: n[0] == "main", lambda n: n[1].get("role") == "main", lambda n: n[0] == "body") for n in nodes if test(n)), None)
    below = list(walk(root))[1:] if root else []
    title = next((text_of(n) for n in nodes if n[0] == "title"), "") or next((text_of(n) for n in nodes if n[0] == "h1"), "") or "Untitled page"
    blocks = []
    for tag, _, _ in (own := [n for n in below if n[0] in ("h1", "h2", "h3", "p", "li", "blockquote", "td", "th")]):
        text = tidy(text_of(own[len(blocks)]))
        blocks.append(None if len(text) < 3 else f"\n{'#' * int(tag[1])} {text}" if tag[0] == "h" else f"- {text}" if tag == "li" else text)
    links = [(tidy(text_of(n)), urljoin(url, n[1]["href"])) for n in below if n[0] == "a" and n[1].get("href") is not None]
    return tidy(title), tidy("\n".join(x for x in blocks if x)), [x for x in links if x[0]]


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    raw = {r.page_id: r for r in pages.collect()}
    got = main_parts(elements(pages)).collect()
    assert len(got) == len(raw) > 20 and sum(len(r.text) > 200 for r in got) > 20
    for r in got:
        title, text, links = brute(raw[r.key].html or "", raw[r.key].url or "")
        assert (r.title, r.text) == (title, text), r.key
        assert [(x.text, x.url) for x in r.links] == list(dict.fromkeys(links))[:30]


CASES = [
    ("<nav>Menu</nav><main><p>Body text</p></main><footer><p>Foot</p></footer>", "Body text"),
    ("<body><p>before</p><article><h2>Head</h2><p>one<p>two<ul><li>first<li>second <b>bold</b></ul></article><article><p>another</p></article>", "## Head\none\ntwo\n- first\n- second bold"),
    ("<div role=main><p>by role</p></div><p>outside</p>", "by role"),
    ("<p>no body tag</p>stray<p hidden>gone</p><div aria-hidden='true'><p>gone too</p></div><p>last one</p>", "no body tag\nlast one"),
    ("<main><table><tr><td>cell one<td>cell two<tr><th>head cell</table></main>", "cell one\ncell two\nhead cell"),
    ("<main><p>a &lt;b&gt; &amp; c&nbsp;&nbsp; d</p><p>x</p><blockquote>said <p>inside</p></blockquote></main>", "a <b> & c d\nsaid inside\ninside"),
    ("<head><title>T</title><script>if (a < b) document.write('<p>no</p>')</script></head><body><svg><p>gone</p></svg><p>kept text</p></body></html><p>after</p>", "kept text\nafter"),
    ("<main><p>one <header>gone</header> rest</p><form><p>gone</p></form><p>two words</p></main>", "one\ntwo words"),
    ("<main><li>a list <ul><li>within</ul></main>", "- a list within\n- within"),
    ("<main><p>unclosed <b>bold <i>both<p>next one</main>", "unclosed bold both\nnext one"),
    ("<!-- <p>comment</p> --><main><p title='a > b'>quoted</p><p>tail", "quoted\ntail"),
    ("plain words only", ""), ("", ""), (None, ""), ("<p", ""), ("<main></main>", ""), ("<article hidden><p>gone</p></article><main><p>the main</p></main>", "the main"),
]


def test_cases(spark):
    rows = spark.createDataFrame([(i, "https://x.org/a/", page) for i, (page, _) in enumerate(CASES)], SCHEMA)
    got = {r.key: r.text for r in main_parts(elements(rows.withColumn("nodes", F.lit(1)))).collect()}
    assert [got[i] for i in range(len(CASES))] == [want for _, want in CASES]


def test_prepared_page(spark):
    page = """<html><head><title> A  title </title><meta name="description" content="About  it"><link rel=canonical href="/c"></head><body><nav><a href=/n>nav</a></nav><main>
    <h1>Head &amp; more</h1><p>Costs 120 $</p><p>plain words</p><a href="b?q=1#x">Link</a><a href="//y.org">Other</a><a href="b?q=1#x">link</a><a>none</a><a href="http://[bad">bad</a></main></body></html>"""
    r = prepared_pages(spark.createDataFrame([(7, "https://x.org/a/p", page)], SCHEMA), purpose="reading").first()
    assert (r.page_id, r.title, r.description, r.canonical, r.headings, r.facts) == (7, "A title", "About it", "https://x.org/c", ["Head & more"], ["Costs 120 $"])
    assert [tuple(x) for x in r.links] == [("Link", "https://x.org/a/b?q=1#x"), ("Other", "https://y.org/")]
    assert r.text == "# Head & more\nCosts 120 $\nplain words" and r.warnings == ["low_text_extraction_volume"] and r.uncertainty == 0.05
    assert r.markdown == (
        "# A title\n\nSource: https://x.org/a/p\n\nPurpose: reading\n\nDescription: About it\n\nHeadings:\n- Head & more\n\nKey facts:\n- Costs 120 $\n\n"
        "Main content:\n# Head & more\nCosts 120 $\nplain words\n\nKey links:\n- [Link](https://x.org/a/b?q=1#x)\n- [Other](https://y.org/)"
    )


def test_deep_and_long_pages(spark):
    deep = "<div>" * 5000 + "<p>deep inside</p>"
    long = "<main>" + "<p>some words of a paragraph</p>" * 20000 + "</main>"
    rows = spark.createDataFrame([(1, "u", deep), (2, None, long), (None, "u", None)], SCHEMA)
    got = {r.page_id: r for r in prepared_pages(rows).collect()}
    assert got[1].text == "deep inside" and got[2].text.count("\n") == 19999 and got[None].title == "Untitled page"
    assert prepared_pages(rows.limit(0)).count() == 0


@pytest.mark.parametrize("href, want", [("/b", "http://x.org/b"), ("HTTP://Y.org:80", "http://y.org/"), ("mailto:a@b", "mailto:a@b"), ("a b", "http://x.org/a%20b"), (None, None)])
def test_absolute(href, want):
    assert absolute(href, "http://x.org/a") == want
