"""HTML extraction on hand-made pages, against a plain strip of tags, and on broken markup."""

import re
from html import unescape

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from offramp.llm.html_extract import extract_text, html_text

CASES = [
    ("", ""),
    ("plain &amp; simple", "plain & simple"),
    ("<p>one<p>two</p>three", "one\n\ntwo\n\nthree"),
    ("<div>a</div><div>b <b>bold</b>\n c</div>", "a\nb bold c"),
    ("a<br>b<br/>c", "a\nb\nc"),
    ("<ul><li>x<li>y<ul><li>deep</ul><li>z</ul>", "- x\n- y\n  - deep\n- z"),
    ("<ol start=3><li>x</li><li><p>y</p><p>more</p></li></ol>", "3. x\n\n4. y\n\n   more"),
    ("<table><caption>T</caption><tr><th>name<th>n<tr><td>longer name<td>5</table>", "T\nname         n\nlonger name  5"),
    ("<table><tr><td>a</td><td></td><td>c</td></tr><tr><td colspan=2>wide</td><td>d</td></tr></table>", "a       c\nwide    d"),
    ("x<script>var a='<p>';</script><style>p{}</style><!-- no --><noscript>n</noscript>y", "xy"),
    ("<head><title>t</title></head><body>seen<p hidden>no</p><p style='display: none'>no</p><p aria-hidden=true>no</p>", "seen"),
    ("<pre>  a\n    b</pre>after", "  a\n    b\n\nafter"),
    ("<p>in<div>block</div>after</p>x", "in\n\nblock\nafter\n\nx"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\nd\nu\ne"),
    ("<img alt='a cat'> and <a href='x>y'>link</a>", "a cat and link"),
    ("<td>loose</td> <li>item", "loose\nitem"),
    ("<table><tr><td>a<table><tr><td>b<td>c</table>d<td>e</table>f", "a     e\nb  c\nd\n\nf"),
]


@pytest.mark.parametrize("html,text", CASES)
def test_layout(html, text):
    assert html_text(html) == text


def words(html):
    """Words outside of what is never shown, with every tag a break."""
    html = re.sub(r"(?s)<!--.*?-->|<(script|style|title|head)\b.*?</\1>", " ", html)
    return unescape(re.sub(r"<[^>]*>", " ", html)).split()


def test_pages_keep_every_visible_word(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    rows = extract_text(pages).join(pages.select("page_id", "html"), "page_id").collect()
    assert len(rows) == pages.count()
    for row in rows:
        assert "".join(re.sub(r"(?m)^ *(- |\d+\. )", "", row.text).split()) == "".join(words(row.html))
        assert not re.search(r"</?(p|div|td|li|b)>", row.text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<table>", "<tr>", "<td>", "</td>", "</table>", "<ul>", "<li>", "</ul>", "w1 ", "<b", "<!--", "-->",
                                 "<div>", "</div>", "x", "&lt;", "<script>", "</script>", "<pre>", "\n", "'", '"', ">", "<br>", "</li>"]), max_size=40))
def test_any_markup_is_rendered(parts):
    text = html_text("".join(parts))
    assert isinstance(text, str) and not text.startswith("\n")


def test_edge_cases(spark):
    rows = [(1, None, "u"), (1, "", None), (None, "<p>x", "u"), (2, "<div>" * 50_000 + "deep", "u"), (3, "<td>" + "w " * 200_000, "u")]
    pages = spark.createDataFrame(rows, "page_id bigint, html string, url string").selectExpr("*", "1 as text", "2 as _key")
    out = extract_text(pages).collect()
    assert sorted(((r.page_id, r.text if r.text is None else r.text[:4], r.n_lines) for r in out), key=repr) == sorted(
        [(1, None, None), (1, "", 0), (None, "x", 1), (2, "deep", 1), (3, "w w ", 1)], key=repr)
    assert extract_text(spark.createDataFrame([], "page_id bigint, html string")).count() == 0
