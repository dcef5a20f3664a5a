from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import splitting
from docloom.llm.fences import closers, lines_of
from docloom.llm.splitting import blocks, cut_places, oversized, split_rows, split_text


def test_blocks():
    t = "a\nb\n\n \n```\nx\n\ny\n```\n\nc\n```\nopen\n\nd"
    assert [t[a:b] for a, b in blocks(t)] == ["a\nb", "```\nx\n\ny\n```", "c\n```\nopen", "d"]
    assert blocks("") == [] and blocks("\n\n") == []
    assert [("~~~\na\n\n~~~~\nb")[a:b] for a, b in blocks("~~~\na\n\n~~~~\nb")] == ["~~~\na\n\n~~~~\nb"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab.\n `", max_size=400), st.integers(10, 60), st.integers(0, 9))
def test_round_trip(text, limit, overlap):
    cuts, _ = split_text(text, limit, overlap)
    pieces = [text[max(0, c - overlap) if i else 0 : d] for i, (c, d) in enumerate(zip(cuts, cuts[1:]))]
    assert all(len(p) <= limit for p in pieces)
    if len(text) > limit:
        assert all(len(p) > 0 for p in pieces) and "".join(text[c:d] for c, d in zip(cuts, cuts[1:])) == text
        assert all(b.startswith(a_end) for a_end, b in zip([text[max(0, c - overlap) : c] for c in cuts[1:-1]], pieces[1:]))


def test_natural_cuts():
    para = "word " * 100
    text = "\n\n".join([para.strip()] * 9)
    cuts, spans = split_text(text, 1200, 100)
    assert all(c in {a for a, _ in spans} for c in cuts[1:-1])


def test_column(spark):
    rows = [(1, "x" * 3001, "z"), (1, "x" * 3001, "z"), (2, "x" * 3000, ""), (3, None, None), (4, ("y" * 1400 + "\n\n") * 3, "q"), (5, "é" * 3001, "")]
    df = spark.createDataFrame(rows, "conv_id long, markdown string, piece string")
    assert {tuple(r) for r in oversized(df).collect()} == {(1, "inside_block"), (4, "between_blocks"), (5, "inside_block")}
    p = split_rows(df).where("conv_id = 4").orderBy("piece_no").collect()
    assert p[1].piece.startswith(p[0].piece[-200:]) and p[1].start == len(p[0].piece) - 200 and max(r.length for r in p) <= 3000
    assert oversized(df.limit(0)).count() == 0


def test_cuts_between_blocks_are_even():
    text = "\n\n".join("x" * k for k in (24, 40, 8, 17, 12, 28, 16, 38, 54, 19, 18))
    cuts, spans = split_text(text, 100, 10)
    assert cuts[-1] == len(text) and all(c in {a for a, _ in spans} for c in cuts[1:-1])
    assert len(cuts) == 6 and max(b - a for a, b in zip(cuts, cuts[1:])) == 73  # by brute force; filled one by one the longest has 97


def test_cut_kind_describes_the_cuts(spark):
    text = "\n\n".join("x" * 2900 for _ in range(3))  # blocks within the limit that do not fit behind the overlap
    df = spark.createDataFrame([(1, text)], "conv_id long, markdown string")
    rows = split_rows(df).orderBy("piece_no").collect()
    spans = blocks(text)
    inside = [any(a < r.start + 200 < b for a, b in spans) for r in rows[1:]]
    assert any(inside) and {r.cut_kind for r in rows} == {"inside_block"} and rows[0].longest_block == 2900
    assert [r.cut_block > 0 for r in rows[1:]] == inside and [r.cut_at == "block" for r in rows[1:]] == [not x for x in inside]
    assert [r.cut_kind for r in oversized(df).collect()] == ["between_blocks"]  # no block is longer than the limit


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab.\n `", max_size=400), st.integers(10, 60), st.integers(0, 9))
def test_cut_places(text, limit, overlap):
    cuts, spans = split_text(text, limit, overlap)
    places = cut_places(text, cuts, spans)
    assert [n for _, n in places] == [sum((b - a) * (a < c < b) for a, b in spans) for c in cuts[1:-1]]
    longest = max((b - a for a, b in spans), default=0)
    assert (max([n for _, n in places], default=0) > limit) == (longest > limit and len(text) > limit)


def test_found_comes_from_the_cuts(spark, monkeypatch):
    df = spark.createDataFrame([(1, "x" * 3001)], "conv_id long, markdown string")
    monkeypatch.setattr(splitting, "cut_places", lambda *a: [("block", 0)])
    assert [r.cut_kind for r in oversized(df).collect()] == ["between_blocks"]


def naive_closers(text):
    import re

    marks = [(k, m[1][0], len(m[1]), m[2].strip()) for k, s in enumerate(text.split("\n")) if (m := re.match(r"[ \t]*(`{3,}|~{3,})(.*)", s))]
    out, i = {}, 0
    while i < len(marks):
        k, c, n, info = marks[i]
        if not (c == "`" and "`" in info):
            j = next((j for j in range(i + 1, len(marks)) if marks[j][1] == c and marks[j][2] >= n and not marks[j][3]), None)
            if j:
                out[k], i = marks[j][0], j
        i += 1
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["```", "````", "~~~", "~~~~~", "```py", "~~~ x", "``` `", "text", ""]), max_size=25))
def test_closers(lines):
    text = "\n".join(lines)
    assert closers(text, lines_of(text)) == naive_closers(text)


def test_unclosed_fences_take_linear_time():
    import time

    def took(n):
        text = "".join("`" * (3 + k % 50) + "a\n" for k in range(n))
        t = time.perf_counter()
        blocks(text)
        return time.perf_counter() - t

    took(1000)
    assert took(40_000) <= 3 * took(20_000) + 0.05
