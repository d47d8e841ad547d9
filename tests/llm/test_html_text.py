import pytest

from attestor.llm.html_text import extract, render

CASES = [
    ("", ""),
    ("plain &amp; simple", "plain & simple"),
    ("<p>one<p>two", "one\n\ntwo"),
    ("<head><title>no</title><style>x</style></head><body>yes<script>var a='</p>';</script> and", "yes and"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>after", "- a\n- b\n  - c\n- d\n\nafter"),
    ("<ol><li>x<li>y</ol>", "1. x\n2. y"),
    ("<div>a <b>b</b>c</div><div hidden>no</div><div style='display : none'>no</div><span style=\"visibility:hidden\">no</span>", "a bc"),
    ("<table><caption>T</caption><tr><th>name<th>n<tr><td>long name<td>1<tr><td>x<td>22</table>", "T\nname      | n\nlong name | 1\nx         | 22"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<pre>  two\n spaces</pre>", "  two\n spaces"),
    ("<!-- c --><h1>T</h1>text</p><p>x", "T\n\ntext\n\nx"),
    ("<dl><dt>a<dd>b<dt>c</dl>", "a\nb\nc"),
    ("<table><tr><td>日本<td>x<tr><td>abcd<td>y</table>", "日本 | x\nabcd | y"),
    ("<p>a<table><tr><td><table><tr><td>in</table><td>out</table>", "a\n\nin | out"),
    ("1 < 2 and <unknown>3</unknown>", "1 < 2 and 3"),
    ("<a title='x > y'>link</a><!-- never closed", "link"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_rendered_text(page, text):
    assert render(page) == text


def test_deep_nesting_and_long_page():
    assert render("<div>" * 30000 + "x") == "x"
    assert render("<p>w " * 20000).count("w") == 20000


def test_query_rows(spark):
    df = spark.createDataFrame([(1, None, "u"), (2, "", "u"), (3, "<p>a", "u"), (3, "<p>a", "u")], "page_id long, html string, text string")
    assert sorted(tuple(r) for r in extract(df).collect()) == [(1, "", 0, 0), (2, "", 0, 0), (3, "a", 1, 1), (3, "a", 1, 1)]
    assert extract(df.limit(0)).count() == 0
