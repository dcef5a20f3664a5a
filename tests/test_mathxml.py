import pytest

from docloom.functions.mathxml import fragment_to_latex, omml_to_latex

CASES = [
    ("<m:f><m:num><m:f><m:num>a</m:num><m:den>b</m:den></m:f></m:num><m:den>c</m:den></m:f>", r"\frac{\frac{a}{b}}{c}", None),
    ("<m:rad><m:deg>n</m:deg><m:e>x</m:e></m:rad>", r"\sqrt[n]{x}", r"\sqrt{x}"),
    ("<m:rad><m:radPr>p</m:radPr><m:deg/><m:e><m:r><m:t>x</m:t></m:r></m:e></m:rad>", r"\sqrt{x}", None),
    ('<m:r><m:t xml:space="preserve"> ratio:b  c</m:t></m:r>', "ratio:b c", "b c"),
    ("<m:sSubSup><m:e>x</m:e><m:sub>i</m:sub><m:sup>2</m:sup></m:sSubSup>", "x_{i}^{2}", None),
    ("<sSup><e>α</e><sup>2</sup></sSup>\n  <r><t>≤ 5 &lt; y</t></r>", r"\alpha^{2}\leq 5 < y", r"\alpha^{2}\leq 5 &lt; y"),
    ("plain", "plain", None),
    ("</m:r><m:f><m:num>1</m:num><m:den>2", r"\frac{1}{2}", None),
    ("", "", None),
    (None, None, None),
    ("<a>" * 3000 + "x" + "</a>" * 3000, "x", None),
]


@pytest.mark.parametrize("xml,want,literal", CASES)
def test_fragments(xml, want, literal):
    assert fragment_to_latex(xml) == want and fragment_to_latex(xml, True) == (want if literal is None else literal)


def test_column(spark):
    df = spark.createDataFrame([(i, x[0]) for i, x in enumerate(CASES)], "i int, xml string")
    got = {r.i: r.l for r in df.select("i", omml_to_latex(df.xml).alias("l")).collect()}
    assert got == {i: x[1] for i, x in enumerate(CASES)}
    assert df.limit(0).select(omml_to_latex(df.xml)).count() == 0
