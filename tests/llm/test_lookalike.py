import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import lookalike
from docloom.llm.lookalike import LOOKALIKES, Transducer, canonical, lookalike_pairs, lookalike_report, rules, transducer


def reference(t):
    s = {ord(k): v for k, v in rules().items()}
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", t.translate(s)).translate(s))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aeAoñé ̧́̀̈ΟоеЕйёＡｂ１\u200b\u00ad\u00a0\u202f\ufeff仓한ᄒ\u1161", max_size=12))
def test_equals_reference_and_is_final(t):
    assert canonical(t) == reference(t) and canonical(canonical(t)) == canonical(t)


def test_kept():
    for t in ("Case case", "a  b", "naïve façade", "План", "1\n2\t3", "", "ß ø æ"):
        if t != "План":
            assert canonical(t) == t
    assert canonical(None) is None and all(canonical(k) == v for k, v in LOOKALIKES.items())


def test_conflicts():
    with pytest.raises(ValueError):
        Transducer([("a", "b"), ("a", "c")])
    with pytest.raises(ValueError):
        Transducer([("a", "b"), ("b", "c")])


def test_pairs(spark):
    rows = [(1, "Ab", "x"), (2, "Аb", "x"), (3, "A\u200bb", None), (4, "ab", ""), (5, "Ab", "y"), (2, "Аb", "x"), (6, None, "é"), (7, "", "e\u0301")]
    df = spark.createDataFrame(rows, "conv_id long, title string, markdown string").selectExpr("*", "'f' AS field_name", "1 AS raw")
    got = {tuple(r) for r in lookalike_pairs(df).collect()}
    assert got == {(1, 2, "title"), (1, 3, "title"), (2, 3, "title"), (2, 5, "title"), (3, 5, "title"), (6, 7, "markdown")}
    assert lookalike_pairs(df.limit(0)).count() == 0
    assert {(r.field_name, r.n_variants, r.n_rows) for r in lookalike_report(df).collect()} == {("title", 3, 4), ("markdown", 2, 2)}


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aeAoO\u0300\u0301\u0323\u0327\u0345\u0308é\u1ec7\u212b\u0410\u0439\u1100\u1161\u11a8\uac00\u200b\u00ad\uff21 ", max_size=12))
def test_composition_is_the_standard_one(text):
    t = transducer()
    single = {ord(k): v for k, v in rules().items()}
    want = unicodedata.normalize("NFC", unicodedata.normalize("NFD", text.translate(single)).translate(single))
    assert t._cluster(text) == want and t(text) == want


def test_every_composed_letter():
    t = transducer()
    for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x10000)]):
        d = unicodedata.normalize("NFD", c)
        if d != c and all(x not in rules() for x in d):
            assert t._cluster(c) == t._cluster(d) == unicodedata.normalize("NFC", c)


def test_hot_form(spark, monkeypatch):
    # one title in a third of all rows and one row of another spelling: as many pairs as rows
    monkeypatch.setattr(lookalike, "CLASS_ROWS", 700)
    n = 6000
    df = spark.range(n).selectExpr("id AS conv_id", "CASE WHEN id = 5 THEN 'hot\u00a0title' WHEN id % 3 = 0 THEN 'hot title' WHEN id = 7 THEN 'hot title\u200b' ELSE 't' || id END AS title", "null AS markdown")
    df = df.selectExpr("conv_id", "title", "cast(markdown AS string) AS markdown")
    got = {(r.conv_id_a, r.conv_id_b) for r in lookalike_pairs(df.union(df)).collect()}
    third = [i for i in range(n) if i % 3 == 0]
    assert got == {tuple(sorted((i, j))) for i in third for j in (5, 7)} | {(5, 7)}
