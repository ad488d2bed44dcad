import re
import time
from html.parser import HTMLParser

import pytest

from faultweave.llm.catalog import op8_visible_text
from faultweave.llm.common import table
from faultweave.llm.html import page_text, visible_text
from tests.llm.cases import dicts


class Words(HTMLParser):
    """All words outside head, script, style and the like: a plain reading of a page."""

    unseen = {"head", "script", "style", "title", "noscript", "template"}

    def __init__(self):
        super().__init__()
        self.depth, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        if self.depth or tag in self.unseen and tag not in ("meta", "link"):
            self.depth += tag not in ("meta", "link", "br", "img")

    def handle_endtag(self, tag):
        self.depth -= bool(self.depth)

    def handle_data(self, data):
        if not self.depth:
            self.words += data.split()


CASES = [
    ("<p>One<p>Two &amp; <b>three</b>", "One\n\nTwo & three"),
    ("a<br>b<div>c</div>d", "a\nb\nc\nd"),
    ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>", "- a\n- b\n  3. x\n  4. y\n- c"),
    ("<table><tr><th>Name<th>N<tr><td>Al B<td>10<td>z<tr><td>x</table>", "Name  N\nAl B  10  z\nx"),
    ("<table><tr><td>a<br>b<td>c</table>after", "a  c\nb\n\nafter"),
    ("x<script>var t='</p>'</script><style>p{}</style><!-- no > -->y", "xy"),
    ("<div hidden>no</div><p style='display: none'>no<p>yes", "yes"),
    # hidden from assistive technology only
    ('Price <span aria-hidden="true">$12</span>', "Price $12"),
    ("a <select><option>one<option selected>two</select> b", "a two b"),
    ("<select><option>first<option>second</select>", "first"),
    ("<select multiple><option>one<option>two</select>", "one\ntwo"),
    ("<textarea>\n a &lt; b\n  c</textarea>", " a < b\n  c"),
    ("<xmp><b>&amp;</b></xmp>x", "<b>&amp;</b>\nx"),
    ("<p title=it's>Visible one</p><p>It doesn't show</p><p>third</p>", "Visible one\n\nIt doesn't show\n\nthird"),
    ("<ul><li>a" + "<span>" * 70 + "<li>b</ul>", "- a\n- b"),
    ("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div>", "yes"),
    ("<p style='text-decoration-display: none'>a<p style='/* display:none */ color: red'>b", "a\n\nb"),
    ("<p style='display:none; display:block'>a<p style='DISPLAY : NONE !important'>b", "a"),
    ("<table><tr><th colspan=2>Both<th>C<tr><td>a<td>b<td>c</table>", "Both  C\na  b  c"),
    ("<table><tr><td rowspan=2>A<td>b<td>c<tr><td>d<td>e</table>", "A  b  c\n   d  e"),
    ("<table><tr><td colspan=3>wide title here<tr><td>1<td>2<td>3</table>", "wide title here\n1  2  3"),
    ("<table><tr><td rowspan=0>x<td>1<tr><td>2<tr><td>3</table>", "x  1\n   2\n   3"),
    ("a</>b</ x>c<!doctype y>d<?z?>e", "abcde"),
    ("a < b <3 <", "a < b <3 <"),
    ("<pre>  a\n   b\n\nc</pre>", "  a\n   b\n\nc"),
    ("<title>t</title><body>1 < 2 &lt; 3", "1 < 2 < 3"),
    ("<dl><dt>t<dd>d<dt>u</dl>", "t\n  d\nu"),
    ("<h1>H</h1>text<blockquote>q</blockquote>", "H\n\ntext\n\n  q"),
    ("", ""),
    ("   \n ", ""),
    ("<a href='x>y'>in</a> <b", "in <b"),
    ("<p>a</p></div></td></li>b", "a\n\nb"),
    ("<table><tr><td><table><tr><td>i<td>j</table><td>k</table>", "i  j  k"),
    ("Ünïcödé&nbsp;😀 &#x41;", "Ünïcödé\xa0😀 A"),
]


@pytest.mark.parametrize(("html", "text"), CASES)
def test_layout(html, text):
    assert visible_text(html) == text


def test_deep_and_broken_pages_end():
    assert visible_text("<div>" * 20_000 + "x") == "x"
    assert visible_text("<ul><li>" * 2_000 + "x").strip(" -") == "x"
    assert visible_text("<p>" * 20_000 + "x") == "x"
    assert visible_text('<b "' * 2_000) is not None
    assert len(visible_text("<td>a" * 5_000)) >= 5_000


@pytest.mark.parametrize(
    "page",
    ["<a " * 350_000, "<i>" * 60_000 + "</p>" * 60_000 + "</b>" * 60_000, "<!--" * 250_000, "<a href=\"x" * 100_000]
    + ["<ul><li>x" * 20_000, "<p><table><tr><td>" + "<i>" * 40_000 + "<div></div>" * 40_000, "x<b>y</b>" * 100_000]
    + ["<table>" + "<tr><td>a<td>b" * 20_000 + "<tr><td>" + "long " * 50_000 + "</table>", "<title>" * 100_000]
    + ["<table><tr>" + "<td rowspan=9999 colspan=999>x" * 300 + "<tr><td>y" * 300, "</" * 400_000, "<a b=c " * 100_000],
)
def test_hostile_pages_take_linear_time(page):
    started = time.process_time()
    text = visible_text(page)
    assert time.process_time() - started < 5
    assert len(text) < 8 * len(page) + 4_000_000


def test_whole_table(spark, sf_dir):
    pages = {r.page_id: r for r in table(spark, sf_dir, "pages").collect()}
    rows = dicts(op8_visible_text(spark, sf_dir))
    assert sorted(r["page_id"] for r in rows) == sorted(pages)
    for row in rows:
        plain = Words()
        plain.feed(pages[row["page_id"]].html)
        plain.close()
        text = re.sub(r"(?m)^ *(- |\d+\. )", "", row["text"])
        assert "".join(text.split()) == "".join(plain.words)


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "<p>x")], "page_id long, html string")
    assert [r[0] for r in df.select(page_text(df["html"])).collect()] == [None, None, "", "x"]
    assert df.limit(0).select(page_text(df["html"])).count() == 0
