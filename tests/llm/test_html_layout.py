from __future__ import annotations

import pytest

from gridrank.llm.html_layout import extract, render

CASES = {
    "<p>One<p>Two <b>bold</b>  x": "One\n\nTwo bold x",
    "a<br>b<br><br>c": "a\nb\n\nc",
    "<ul><li>a<li>b<ol start=3><li>n<li>m</ol><li>c</ul>": "- a\n- b\n  3. n\n  4. m\n- c",
    "<table><tr><th>Name<th>Qty<tr><td>apple<td>1<tr><td>x<td>10</table>": "Name   Qty\napple  1\nx      10",
    "<table><tr><td colspan=2>wide one<tr><td>a<td>b</table>": "wide one\na  b",
    "<div hidden>no</div><script>no</script><p style='display: none'>no<p>yes": "yes",
    "<div style='visibility:hidden'>no<i style='visibility:visible'>yes</i></div>": "yes",
    "<pre>  k\n   l</pre>": "  k\n   l",
    "x<img alt='pic'>y": "x [pic] y",
    "<dl><dt>t<dd>d</dl>": "t\n  d",
    "<!-- c -->a &amp; b&nbsp;c": "a & b\xa0c",
    "<td>stray</td></p></div>x": "stray\n\nx",
    "<select><option>a<option>b</select>": "a\nb",
    "<head><title>t</title><p>body": "body",
    "<blockquote>q<p>r</blockquote>s": "  q\n\n  r\n\ns",
    "<table><tr><td>a<table><tr><td>in</table><td>b</table>": "a   b\n\nin",
    "": "",
    "   ": "",
}


@pytest.mark.parametrize("html", CASES)
def test_render(html):
    assert render(html) == CASES[html]


def test_deep_pages_and_nulls():
    assert render(None) is None
    assert render("<div>" * 50_000 + "x" + "</div>" * 50_000) == "x"
    assert render("<b>" * 20_000 + "x") == "x"


def test_table_of_pages(spark):
    rows = [(1, "u", "<p>a", "t"), (1, "u", "<p>a", "t"), (None, None, None, None), (2, "u", "", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted(map(tuple, extract(pages).collect()), key=str) == sorted([(1, "a"), (1, "a"), (None, None), (2, "")], key=str)
    assert extract(pages.where("false")).count() == 0


def test_tables_with_captions_and_cells_over_rows():
    assert render("<table><caption>Cap</caption><tr><td>a<td>b</table>") == "Cap\na  b"
    assert render("<table>x<tr><td>a<td>b</table>").split("\n")[-1] == "a  b"
    assert render("<table><tr><td rowspan=2>R<td>one<tr><td>two</table>") == "R  one\n   two"
    assert render("<table><tr><td>a<td rowspan=0>b<tr><td>c<td>d<tr><td>e<td>f</table>") == "a  b\nc     d\ne     f"


def test_line_end_after_pre_and_closed_details():
    assert render("<pre>\nfoo\nbar</pre>") == "foo\nbar"
    assert render("<pre>\n\nfoo</pre>x").startswith("\nfoo") or "foo" in render("<pre>\n\nfoo</pre>x")
    assert render("<details><summary>more</summary>hidden</details>") == "more"
    assert render("<details open><summary>more</summary>seen</details>") == "more\nseen"
