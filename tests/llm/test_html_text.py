"""Rendering of pages: layout by example, words against the standard library's parser."""

from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from perigee.llm.html_text import render, visible_text
from perigee.llm.queries import op9_visible_text

SF = "/root/testdata/sf0.001"
CASES = {
    "<p>a  b\n c<p>d": "a b c\n\nd",
    "<div>a</div><div>b<br>c</div>": "a\nb\nc",
    "x<ul><li>one<li>two<ul><li>deep</ul><li>three</ul>y": "x\n\n  * one\n  * two\n      * deep\n  * three\n\ny",
    "<ol start=3><li>a<li value=9>b<li>c</ol>": "  3. a\n  9. b\n  10. c",
    "<table><tr><th>name<th>n<tr><td>longer name<td>1</table>": "name         n\nlonger name  1",
    "<table><tr><td colspan=2>wide one<td>z<tr><td>a<td>b<td>c</table>": "wide one  z\na  b      c",
    "<table><tr><td rowspan=2>r<td>1<tr><td>2</table>": "r  1\n   2",
    "<table><caption>cap</caption><tr><td>v</table>after": "cap\nv\nafter",
    "<pre>  a\n   b</pre>c": "  a\n   b\n\nc",
    "a<script>var x='</p>';</script><style>p{}</style><!-- c > d -->b": "ab",
    "<p hidden>no<p style='color:red; display : none'>no<p>yes": "yes",
    "<head><title>t</title></head><body>b": "b",
    "<title>t</title>b": "b",
    "<details><summary>s</summary>no</details><details open><summary>s</summary>yes</details>": "s\ns\nyes",
    "a &amp; b &lt;c&gt; &nbsp;d": "a & b <c>  d",
    "1 < 2 and <3": "1 < 2 and <3",
    "<b>bold <i>both</b> tail</i> end": "bold both tail end",
    "<a href='x>y'>link</a>": "link",
    "": "",
    "<div": "",
    "<td>cell": "cell",
    "</p>x</div></ul>": "x",
    "<select><option>a<option>b</select>": "a\nb",
}


@pytest.mark.parametrize("page", CASES)
def test_layout(page):
    assert render(page) == CASES[page]


@pytest.mark.parametrize("page, text", [
    ("<p title=don't>Visible one</p><p>it's here</p>", "Visible one\n\nit's here"),
    ("<p don't>one</p><p>it's</p>", "one\n\nit's"),
    ('<p a"b=1>one</p><p>say "x"</p>', 'one\n\nsay "x"'),
    ('<p title=5">one</p><p>"x"</p>', 'one\n\n"x"'),
    ("<a title = 'x>y'class=\"a>b\">link</a>", "link"),
    ("<a href=/x/y/>link</a>", "link"),
    ("<p a=>one<p hidden =''>no", "one"),
    ('<p title="x>one', "one"),
])
def test_quotes_inside_tags(page, text):
    assert render(page) == text


@pytest.mark.parametrize("page, text", [
    ("so <math><msup><mi>x</mi><mn>2</mn></msup><mo>=</mo><mn>4</mn></math> holds", "so x2=4 holds"),
    ("<math><semantics><mi>x</mi><annotation encoding=t>\\\\x</annotation></semantics></math>y", "xy"),
    ("a<svg><title>t</title><desc>d<b>e</b></desc><defs><text>no</text></defs><style>p{}</style>"
     "<path d='M0'/><text x=1>One</text><text>Two <tspan>more</tspan></text></svg>b", "a\nOne\nTwo more\nb"),
    ("<svg><title/><defs/><style /><metadata a=b /><text>shown</text></svg>after", "shown\nafter"),
    ("<p>a <svg><text>in</text></svg> b</p>c", "a\nin\nb\n\nc"),
    ("<svg><foreignObject><p>one<p>two</foreignObject></svg>three", "one\n\ntwo\n\nthree"),
    ("<svg><defs><p>out", "out"),
    ("<p>cut <svg><g>", "cut"),
    ("<desc>d</desc><text>e</text>", "de"),
    ("<svg hidden><text>no</text></svg>yes", "yes"),
])
def test_formulas_and_drawings(page, text):
    assert render(page) == text


def test_depth_and_length_are_no_trouble():
    assert render("<b>" * 20_000 + "x") == "x"
    assert render("<table><tr><td>" * 300 + "x").strip() == "x"
    assert render("<p>" + "word " * 200_000).count("word") == 200_000


class Words(HTMLParser):
    def __init__(self):
        super().__init__()
        self.skip, self.found = 0, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title")

    def handle_data(self, data):
        if not self.skip:
            self.found += data.split()


def test_words_of_the_given_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op9_visible_text(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        parser = Words()
        parser.feed(pages[r.page_id])
        assert [w for w in r.text.split() if w != "*"] == parser.found


def test_null_and_empty(spark):
    pages = spark.createDataFrame([(1, None), (2, "")], "page_id long, html string")
    assert [r.t for r in pages.orderBy("page_id").select(visible_text(F.col("html")).alias("t")).collect()] == [None, ""]
    assert pages.limit(0).select(visible_text(F.col("html"))).count() == 0


def test_visibility_by_declarations():
    from perigee.llm.html_text import render

    shown = ["backface-visibility:hidden", "-webkit-backface-visibility: hidden", "display:none;display:block", "display:none;DISPLAY : Inline",
             "display:block!important;display:none", "/* display:none */color:red", "content-visibility: hidden", "x:display;none", "display", ""]
    for style in shown:
        assert render(f'<p>a</p><p style="{style}">b</p>') == "a\n\nb", style
    for style in ["display:none", "color:red; Display: NONE ;", "display:none ! important; display:block", "display:block;display:none", "visibility:hidden",
                  "visibility: collapse", "visibility:visible;visibility:hidden"]:
        assert render(f'<p>a</p><p style="{style}">b</p>') == "a", style


def test_visible_children_of_invisible_elements():
    from perigee.llm.html_text import render

    page = '<div style="visibility:hidden">x<p style="visibility:visible">a<b>b</b></p><p>y<span style="visibility:hidden">z</span></p></div><p>c</p>'
    assert render(page) == "ab\n\nc"
    assert render('<div style="display:none"><p style="display:block;visibility:visible">a</p></div>b') == "b"
    listed = '<ol><li>a</li><li style="visibility:hidden">b</li><li>c</li></ol>'
    assert [line.strip() for line in render(listed).split("\n") if line.strip()] == ["1. a", "3. c"]
