import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.operators.htmlmd import Options, convert

LITERAL = Options(compat="literal")


@pytest.mark.parametrize(
    "html,md",
    [
        ("<h1>T</h1><p>a <b>b</b> <i>c</i><p>d<br>e", "# T\n\na **b** *c*\n\nd  \ne\n"),
        ("<ol><li>a<li>b<ul><li>c</ul></ol>", "1. a\n2. b\n   - c\n"),
        ("<table><tr><td>x<td>y|z<tr><td><td>2</table>", "| x | y\\|z |\n| --- | --- |\n|  | 2 |\n"),
        ('<a href="a b">t</a> <a href="javascript:x">u</a> <a href="v">v</a>', "[t](a%20b) u <v>\n"),
        ('<pre><code class="language-py">x\n  y</code></pre>', "```py\nx\n  y\n```\n"),
        ("<p>1*2_3 [x] $a_1*b$</p>", "1\\*2\\_3 \\[x\\] $a_1*b$\n"),
        ("<script>a</p></script><style>b</style><p>c", "c\n"),
        ("<blockquote><p>a</p><p>b</p></blockquote>", "> a\n>\n> b\n"),
        ("<p>&lt;x&gt; &amp; &eacute;</p>", "<x> & é\n"),
        ("", "\n"),
    ],
)
def test_default(html, md):
    assert convert(html) == md


def test_literal_and_options():
    assert convert("<ol><li>a<li>b</ol>", LITERAL) == "- a\n- b\n"
    assert convert("<table><tr><td>Name<td>1</table>", LITERAL) == "|Name | 1 |\n| --- | --- |\n"
    assert convert("<table><tr><td>x<td>1</table>", LITERAL) == "|x | 1 |\n"
    assert convert("<h2>$x$</h2>", LITERAL) == "$x$\n" and convert("<h2>$x$</h2>") == "## $x$\n"
    assert convert("<h1>Ab</h1>", Options(heading_style="setext")) == "Ab\n==\n"
    assert convert("<table><tr><td>a<td>b</table>", Options(preserve_tables=False)).split() == ["a", "b"]
    assert convert(None) is None


def test_any_depth():
    deep = 3000
    inside = "<ol><li>a<li><b>b</b></ol><table><tr><td>x<td>y</table>"
    for tag in ("div", "span", "section"):
        assert convert(f"<{tag}>" * deep + inside + f"</{tag}>" * deep + "<p>c") == convert(f"<{tag}>{inside}</{tag}><p>c"), tag
    lists = convert("<ul><li>x" * 500).split("\n")
    assert lists[:-1] == ["  " * k + "- x" for k in range(500)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>/abpliotdrh1 =\"'\n&;$*_", max_size=80))
def test_ends_in_one_newline(html):
    md = convert(html)
    assert md.endswith("\n") and not md[:-1].endswith("\n")


def test_column(spark):
    from docloom.operators.htmlmd import html_to_markdown

    df = spark.createDataFrame([(1, "<p>a", "e"), (2, None, None), (3, "", "")], "id long, html string, error string")
    got = {r.id: r.markdown for r in html_to_markdown(df, "id", "html").collect()}
    assert got == {1: "a\n", 2: None, 3: "\n"}
