import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm.markup import clean_lines, clean_markup, clean_text, line_blocks, residue_kinds

PLAIN = [
    "See <https://a.invalid/x> or <me@b.invalid>.",
    "Rooms <-> halls: keep n <= 3, never <3 or >9, R&D & stock; a <b and c> d",
    "C:\\temp\\new\\list.txt and D:\\section\\emph\\l.txt end with \\r\\n",
    "Prices run from $5 to $69 per crate, {a, b} included.",
    "`<b>` and ``{{x}} ` y`` and `\\textbf{x}`",
    "```html\n<i>x</i>\n\n{{y}}\n\\emph{z}\n```",
    "~~~~\n~~~\n[[a]]\n~~~~",
    "$\\frac{a}{b}$ and\n$$\n\\begin{pmatrix} a \\\\ b \\end{pmatrix}\n$$",
    "# h\n\n- [x] a\n- [ ] b\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n**b** _i_ [t](u) ![i](p.png)\n\n---\nT\n===\n\n\\# no head \\[x\\]",
    "grid = [1, 2]\r\nx == y and y == z",
]


@pytest.mark.parametrize("text", PLAIN)
def test_no_residue(text):
    assert clean_text(text) == (text, [0, 0, 0])


@pytest.mark.parametrize(
    "text,kind,clean",
    [
        ("a <b>b</b><br/>c", 0, "a **b**\nc"),
        ("<ul><li>x<li>y</ul>", 0, "- x\n- y"),
        ("<TABLE BORDER=1><TR><TD>a<TD>4</TABLE>", 0, "| a | 4 |\n|---|---|"),
        ("a &lt; b &#8211; c&nbsp;d", 0, "a < b – c d"),
        ("x <!-- y\nz --> w", 0, "x  w"),
        ("<font\n  size=\"2\"\n>t</font>", 0, "t"),
        ("costs from $5 <b>net</b> to $7", 0, "costs from $5 **net** to $7"),
        ("[[A b|the c]] and [[d]]s", 1, "the c and ds"),
        ("== Head ==\ntext", 1, "## Head\ntext"),
        ("'''b''' and ''i''", 1, "**b** and *i*"),
        ("a {{t|{{u}}}} b {{{1|x}}}", 1, "a  b"),
        ("{| class=x\n! a !! b\n|-\n| 1 || 2\n|}", 1, "| a | b |\n|---|---|\n| 1 | 2 |"),
        ("__NOTOC__\ntext", 1, "text"),
        ("see [https://a.invalid x y]", 1, "see [x y](https://a.invalid)"),
        ("\\section{A}\ntext \\emph{b}\\footnote{c}", 2, "## A\ntext *b* (c)"),
        ("5\\,\\mathrm{kg}", 2, "5 kg"),
        ("The {\\bf urgent} x\\\\\nnext", 2, "The urgent x\nnext"),
        ("\\begin{tabular}{ll}\na & 1 \\\\\nb & 2\n\\end{tabular}", 2, "| a | 1 |\n|---|---|\n| b | 2 |"),
        ("in~\\cite{x}, done", 2, "in, done"),
    ],
)
def test_residue(text, kind, clean):
    got, n = clean_text(text)
    assert got == clean and [x > 0 for x in n] == [i == kind for i in range(3)]
    assert clean_text(got)[1] == [0, 0, 0]


def test_kinds_do_not_hide_each_other():
    assert [x > 0 for x in clean_text("{{a|b}} \\emph{c} {\\bf d} <b>e</b> {{#if:1|x|y}}")[1]] == [True, True, True]
    assert clean_text("x\\,\\mathrm{kg}\n\n{{notice|b}}") == ("x kg", [0, 1, 2])


def test_code_is_kept():
    t = "<p>a</p>\n\n```\n<p>{{x}}</p>\n```\n\n$x<b$ and `<i>`"
    got, n = clean_text(t)
    assert "```\n<p>{{x}}</p>\n```" in got and "$x<b$" in got and "`<i>`" in got and n == [2, 0, 0]


def test_line_blocks():
    w = [0, 0, 0, 4, 40, 9, 0, 0, 0, 0, 5, 3, 4, 60]
    assert line_blocks(w, window=3, surge=20) == [False] * 3 + [True] * 3 + [False] * 5 + [True] * 3
    assert line_blocks(w, window=3, surge=70) == [False] * 14  # another surge
    assert line_blocks(w, window=6, surge=20) == [True] * 14  # another window
    assert line_blocks([], []) == [] and line_blocks([0, 0, 0]) == [True] * 3
    assert line_blocks([30, 0, 0, 0, 0], [False, True, True, False, True]) == [True, True, True, False, False]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 7, 25]), max_size=30), st.integers(1, 6), st.integers(1, 40))
def test_line_blocks_against_windows(w, window, surge):
    n = len(w)
    got = line_blocks(w, None, window, surge)
    if n <= window:
        assert got == [True] * n
        return
    for i in range(n):
        full = any(sum(w[j : j + window]) >= surge for j in range(max(0, i - window + 1), min(i, n - window) + 1))
        a, b = i, i
        while a > 0 and not w[a - 1]:
            a -= 1
        while b < n and not w[b]:
            b += 1
        assert got[i] == (full and not (w[i] == 0 and b - a >= window))


MENU = "".join(f'<div><a href="/{x}">{x}</a> | [[{x}|{x} page]]</div>\n' for x in ("home", "news", "shop", "help", "login"))
ARTICLE = "<h2>Pumps</h2>\n<p>The <b>pump</b> in hall three was checked twice last week.</p>\n<ul><li>x<li>y<li>z</ul>\n<p>n</p>\n\n```\n<a>\n```\n\n$x<y$\n\n<p>It was sealed again.</p>\n"


def test_menus_go_and_the_article_stays():
    got, n, dropped = clean_lines(MENU + ARTICLE + MENU)
    assert "home" not in got and "login" not in got and dropped >= 10
    for part in ("## Pumps", "The **pump** in hall", "- x\n- y\n- z", "```\n<a>\n```", "$x<y$", "It was sealed again.", "\nn\n"):
        assert part in got
    assert n[0] == clean_text(MENU)[1][0] * 2 + clean_text(ARTICLE)[1][0] and n[1] == 10  # counted in dropped lines too
    assert clean_text(MENU)[0] == "" and clean_text(MENU, window=9)[0] != ""
    assert clean_text(MENU + ARTICLE + MENU, surge=1)[0] == got  # rows of links weigh nothing
    notes = "".join(f"<p>{x}</p>\n" for x in "abcdefgh")
    assert clean_text(notes)[0] == "" and clean_text(notes, surge=2)[0].split() == list("abcdefgh")


@pytest.mark.parametrize("unit", ["<!-- a\n", "<ref>x\n", "~~~\n", "{|\n| a\n", "<script>", "[[a\n", "{{a\n", "```` x\n", "<!DOCTYPE ", "\\emph{", "\\[", "$$ ", "<b"])
def test_unclosed_marks_take_linear_time(unit):
    import time

    def took(n):
        best = 9.0
        for _ in range(3):
            t = time.perf_counter()
            clean_text("-->|}\n</ref>\n" + unit * n)
            best = min(best, time.perf_counter() - t)
        return best

    took(500)
    assert took(8000) <= 2.6 * took(4000) + 0.05


def test_private_characters_stay():
    t = "".join(map(chr, range(0xF0000, 0xF0008))) + " <b>x</b> `\U000f0001` \U000f00001\U000f0000"
    assert clean_text(t)[0] == t.replace("<b>", "**").replace("</b>", "**")


@pytest.mark.parametrize(
    "text,clean",
    [
        ("so\n\\[\na^{2}\n= b\n\\]\nend", "so\n$$a^{2}\n= b$$\nend"),
        ("\\(" + "a + " * 300 + "b = c\\)", "$" + "a + " * 300 + "b = c$"),
        ("so \\(a\n= b\\) ends", "so $a = b$ ends"),
        ("\\[\\frac{a}{b}\\]", "$$\\frac{a}{b}$$"),
        ("\\emph{x} {" + "long " * 60 + "group}", "*x* " + "long " * 60 + "group"),
    ],
)
def test_latex_of_any_length(text, clean):
    got, n = clean_text(text)
    assert got == clean and n == [0, 0, 1] and clean_text(got)[1] == [0, 0, 0]


@pytest.mark.parametrize("text", ["\\[a = b\n\nc\\]", "\\[x\\] a_b \\(y\\)", "\\[a = b\\)", "\\(" * 50_000 + "\\)"])
def test_no_formula(text):
    assert clean_text(text) == (text, [0, 0, 0])


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab <>/&;{}[]|'=$`~\\\n_#\r", max_size=60))
def test_total(text):
    got, n = clean_text(text)
    assert isinstance(got, str) and all(x >= 0 for x in n) and (any(n) or got == text)


def test_column(spark):
    long = "<b>x</b> word " * 20_000
    df = spark.createDataFrame([(1, "<b>a</b> \\emph{x}", "k"), (1, "<b>a</b> \\emph{x}", "k"), (2, None, "k"), (3, "", None), (4, long, "")], "conv_id long, markdown string, kind string")
    assert {tuple(r) for r in residue_kinds(df).collect()} == {(1, "html"), (1, "latex"), (4, "html")}
    got = {r.conv_id: r for r in clean_markup(df).collect()}
    assert got[2].clean_text is None and got[3].clean_text == "" and got[4].n_html == 40_000
    assert residue_kinds(df.limit(0)).count() == 0
