import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.functions import detect, errors, imageplan
from docloom.operators import metrics, pipeline, schemas
from docloom.sources import docx, files

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math" xmlns:r="http://r"'


def make_docx(body: str, notes: str | None = None) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/numbering.xml", f'<w:numbering {W}><w:abstractNum w:abstractNumId="0"><w:lvl><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="5"><w:abstractNumId w:val="0"/></w:num></w:numbering>')
        z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="r1" Target="https://a.invalid"/></Relationships>')
        if notes:
            z.writestr("word/footnotes.xml", notes)
    return out.getvalue()


def p(text: str, pr: str = "") -> str:
    return f"<w:p>{'<w:pPr>' + pr + '</w:pPr>' if pr else ''}{text}</w:p>"


def run(text: str, pr: str = "") -> str:
    return f"<w:r>{'<w:rPr>' + pr + '</w:rPr>' if pr else ''}<w:t>{text}</w:t></w:r>"


BODY = (
    p(run("Title"), '<w:pStyle w:val="Heading1"/>')
    + p(run("plain ") + run("bold", "<w:b/>") + '<w:hyperlink r:id="r1">' + run("link") + "</w:hyperlink>")
    + p(run("one"), '<w:numPr><w:ilvl w:val="0"/><w:numId w:val="5"/></w:numPr>')
    + p(run("two"), '<w:numPr><w:ilvl w:val="0"/><w:numId w:val="5"/></w:numPr>')
    + "<w:tbl><w:tr><w:tc>" + p(run("a")) + "</w:tc><w:tc>" + p(run("b")) + "</w:tc></w:tr></w:tbl>"
    + p("<m:oMath><m:f><m:num><m:rad><m:deg><m:r><m:t>3</m:t></m:r></m:deg><m:e><m:r><m:t>α</m:t></m:r></m:e></m:rad></m:num><m:den><m:r><m:t>b</m:t></m:r></m:den></m:f></m:oMath>")
)


def test_docx_html():
    h = docx.docx_html(make_docx(BODY, f'<w:footnotes {W}><w:footnote w:id="1">{p(run("note"))}</w:footnote></w:footnotes>'))
    assert h.startswith("<h1>Title</h1><p>plain <strong>bold</strong>") and "<ol><li>one</li><li>two</li></ol>" in h
    assert "<td><p>a</p></td>" in h and "\\frac{\\sqrt[3]{\\alpha}}{b}" in h and "[1] note" in h
    assert docx.docx_html(make_docx(BODY), {"Heading 1": "h4"}).startswith("<h4>")


def test_convert(spark):
    rows = [
        ("d/a.docx", make_docx(BODY)),
        ("d/noext", b"PK\x03\x04broken"),
        ("d/bad.docx", b"nothing"),
        ("d/page.html", b"<h1>H</h1><p>x"),
        ("d/t.md", b"# m"),
        ("d/x.xls", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"),
        ("d/empty.txt", b""),
    ]
    df = spark.createDataFrame(rows, "path string, content binary").withColumn("error", F.lit("clash"))
    got = {r.path: r for r in pipeline.convert(df).collect()}
    assert len(got) == len(rows)
    a = got["d/a.docx"]
    assert a.title == "Title" and a.error is None and "1. one" in a.markdown and "| a | b |" in a.markdown and "$\\frac" in a.markdown
    assert got["d/bad.docx"].error.code == "FILE_CORRUPTED" and got["d/bad.docx"].markdown == ""
    assert got["d/x.xls"].error.code == "UNSUPPORTED_FORMAT" and got["d/noext"].error.code == "UNSUPPORTED_FORMAT"
    assert got["d/page.html"].title == "H" and got["d/t.md"].markdown == "# m" and got["d/t.md"].title == "t"
    assert pipeline.convert(df.limit(0)).count() == 0


def test_file_info(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(bytes.fromhex("89504E470D0A1A0A0000000D49484452000009B000000DB4"))
    (tmp_path / "b.docx").write_bytes(make_docx(BODY))
    df = files.read_files(spark, str(tmp_path))
    got = {r.path.rpartition("/")[2]: r for r in detect.file_info(df.withColumn("mimetype", F.lit(""))).collect()}
    assert got["a.png"].detected.mimetype == "image/png" and not got["a.png"].supported
    assert got["b.docx"].detected.extension == ".docx" and got["b.docx"].convertible
    s = df.where("path like '%png'").select(imageplan.png_size(F.col("content")).alias("s")).first().s
    assert (s.width, s.height) == (2480, 3508)


def test_plan_a4(spark):
    df = spark.createDataFrame([(2480, 3508)], "w int, h int")
    plan = df.select(imageplan.plan_image(F.col("w"), F.col("h"), F.lit(80), F.lit("mistral-small"), F.lit(True), F.lit(90)).alias("p")).first().p
    assert (plan.width, plan.height) == (1089, 1540) and plan.tags == ["crop-80%", "resize-1089x1540-pixels", "contrast", "jpeg-q90"]


class Echo:
    def generate(self, images, prompt, model):
        if images[0] == b"fail":
            raise TimeoutError("timeout")
        return "```json\n" + json.dumps({"merchant_name": "m", "total_amount": len(images), "items": [{"name": "x", "extra": 1}]}) + "\n```"


def test_extract(spark):
    rows = [(1, 2, b"b"), (1, 1, b"a"), (2, 1, b"fail"), (3, 1, b"c")]
    df = spark.createDataFrame(rows, "doc_id long, page_no int, image binary")
    got = {r.doc_id: r for r in pipeline.extract_receipts(df, Echo(), model="m1", retries=0).collect()}
    assert got[1].success and got[1].page_count == 2 and json.loads(got[1].data)["items"] == [{"name": "x"}]
    assert not got[2].success and got[2].attempts == 3 and "timeout" in got[2].errors[0].message and got[2].page_count == 0
    spec = schemas.from_json('{"type": "object", "properties": {"total_amount": {"type": "integer"}, "gone": {"type": "string"}}}')
    bad = pipeline.extract(df.where("doc_id = 3"), Echo(), spec).first()
    assert [e.path for e in bad.errors] == ["gone"]
    with pytest.raises(Exception, match="required"):
        pipeline.extract(df.where("doc_id = 3"), Echo(), spec, mode="FAILFAST").collect()


class Hang:
    def generate(self, images, prompt, model):
        import time

        if images[0] == b"hang":
            time.sleep(30)
        if images[0] == b"wrong":
            raise ValueError("bad schema")
        return json.dumps({"merchant_name": images[0].decode(), "total_amount": 1})


def test_calls_time_out_and_back_off(monkeypatch):
    waits = []
    monkeypatch.setattr(pipeline.time, "sleep", waits.append)

    def fail(what):
        def f():
            raise what

        return f

    calls = pipeline.Calls(timeout=5, retries=3, most=3)
    assert calls.run(fail(RuntimeError("Rate limit hit")))[1:] == ("RuntimeError: Rate limit hit", 4) and waits == [1, 2, 3]
    assert calls.run(fail(ValueError("no")))[1:] == ("ValueError: no", 1) and len(waits) == 3  # not worth repeating
    assert calls.run(lambda: "x") == ("x", None, 1)


def test_a_hanging_model_leaves_a_row(spark):
    df = spark.createDataFrame([(1, 1, b"hang"), (2, 1, b"ok"), (3, 1, b"wrong")], "doc_id long, page_no int, image binary")
    got = {r.doc_id: r for r in pipeline.extract_receipts(df, Hang(), calls=pipeline.Calls(timeout=0.3, retries=1, base=0.01)).collect()}
    assert got[1].attempts == 2 and "timeout" in got[1].errors[0].message and got[3].attempts == 1 and got[2].attempts == 1


def test_pages_by_reference_and_one_by_one(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "wrong")], "doc_id long, page_no int, path string")
    load = lambda p: p.encode()
    whole = {r.doc_id: r for r in pipeline.extract_receipts(df, Echo(), load=load).collect()}
    assert whole[1].page_count == 2 and json.loads(whole[1].data)["total_amount"] == 2
    by = {r.doc_id: r for r in pipeline.extract_by_page(df, Hang(), document_type="receipt", load=load).collect()}
    assert [(x.page, json.loads(x.data)["merchant_name"]) for x in by[1].results] == [(1, "a"), (2, "b")]
    assert by[1].page_count == 2 and by[2].n_failed == 1 and "bad schema" in by[2].results[0].errors[0].message


def test_gate_follows_convertible(spark, tmp_path):
    data = docx_bytes() if "docx_bytes" in globals() else b"PK\x03\x04 word/ document.xml"
    rows = [("a.bin", bytearray(data), "application/zip"), ("b.md", bytearray(b"# x"), "application/octet-stream"), ("c.bin", bytearray(b"\x01"), "application/octet-stream"), ("d.HTML", bytearray(b"<h1>t</h1>"), "application/x")]
    df = spark.createDataFrame(rows, "path string, content binary, mimetype string")
    takes = {r.path: r.convertible for r in detect.file_info(df).collect()}
    got = {r.path: r.error for r in pipeline.convert(df).collect()}
    assert takes == {"a.bin": True, "b.md": True, "c.bin": False, "d.HTML": True}
    assert {p: bool(e and e.code == "UNSUPPORTED_FORMAT") for p, e in got.items()} == {p: not t for p, t in takes.items()}


def test_windows_by_days(spark):
    import random
    from datetime import datetime, timedelta

    r = random.Random(2)
    rows = [(i, r.choice(["a", "a", "b", None]), datetime(2024, 1, 1) + timedelta(hours=r.randrange(0, 300)), r.choice([None, 1, 2, 5])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, at timestamp, v int")
    run = {x.id: (x.place, x.total) for x in metrics.running_in_group(df, ["g"], "at", "id", "v").collect()}
    prev = {x.id: x.previous for x in metrics.previous_in_group(df.where("g is not null"), ["g"], "at", "id").collect()}
    for g in ("a", "b", None):
        own = sorted((x for x in rows if x[1] == g), key=lambda x: (x[2], x[0]))
        for k, x in enumerate(own):
            last = [y[3] for y in own[max(0, k - 2) : k + 1] if y[3] is not None]
            assert run[x[0]] == (k + 1, sum(last) if last else None)
            assert g is None or prev[x[0]] == (own[k - 1][0] if k else None)


def test_provider_config():
    with pytest.raises(ValueError):
        pipeline.ProviderConfig("scaleway").resolve({})
    c = pipeline.ProviderConfig("mistral", api_key="k").resolve({"MISTRAL_MODEL": "m"})
    assert c.model == "m" and pipeline.ProviderConfig("ollama").resolve({}).model == "llava:13b"


def test_json_schema():
    f = schemas.from_json
    assert f("[1]").kind == "any"
    with pytest.raises(ValueError):
        f("{")
    t = f('{"type": "object", "properties": {"a": {"type": ["object", "null"], "properties": {"b": {"type": "string"}}}, "n": {"type": "integer"}, "l": {"type": "array", "items": {"type": "number"}}, "s": {"type": "str or null"}}}')
    e = []
    assert t.check({"a": None, "n": 2.0, "l": [1], "s": None, "z": 9}, "", e) == {"a": None, "n": 2.0, "l": [1], "s": None} and not e
    t.check({"n": 1.5, "l": ["x"], "s": 1}, "", e)
    assert [p for p, _ in e] == ["a", "n", "l[0]", "s"]


def test_pdf_pages_and_errors(spark):
    df = spark.createDataFrame([("a", b"%PDF-1"), ("b", b"x"), ("c", b"%PDF-2")], "path string, content binary")

    def pages(content):
        if content.endswith(b"2"):
            raise RuntimeError("damaged")
        yield from (b"1", b"2")

    got = files.pdf_pages(df, pages).orderBy("path", "page_no").collect()
    assert [(r.path, r.page_no) for r in got] == [("a", 1), ("a", 2), ("b", None), ("c", None)]
    r = spark.range(1).select(errors.error_code(F.lit("Invalid ZIP")).alias("a"), errors.retry_delay_ms(F.lit(3)).alias("b"), errors.error_code(F.lit(None).cast("string")).alias("c")).first()
    assert (r.a, r.b, r.c) == ("FILE_CORRUPTED", 8000, None)


def test_custom_converter(spark):
    pipeline.register_converter("rtf", lambda c, m, e: e == ".rtf", lambda d: d.select("path", F.lit("<h1>R</h1>").alias("html"), F.lit(None).cast("string").alias("error")))
    try:
        r = pipeline.convert(spark.createDataFrame([("a.rtf", b"{\\rtf")], "path string, content binary")).first()
        assert r.title == "R" and r.error is None
    finally:
        pipeline._CONVERTERS.clear()


def test_rewrite_math(spark):
    xml = '<w:p><m:oMathPara><m:oMath><m:sSup><m:e><m:r><m:t xml:space="preserve">x &lt; y</m:t></m:r></m:e><m:sup><m:r><m:t>2</m:t></m:r></m:sup></m:sSup></m:oMath></m:oMathPara><m:oMath><m:r><m:t>a</m:t></m:r></m:oMath><m:oMath><m:r>bad</m:oMath></w:p>'
    got = docx.rewrite_math(xml)
    assert got == "<w:p><w:p><w:r><w:t>$$x &lt; y^{2}$$</w:t></w:r></w:p><w:r><w:t>$a$</w:t></w:r><w:r><w:t>$bad$</w:t></w:r></w:p>"
    df = spark.createDataFrame([("f", make_docx(BODY)), ("g", b"no")], "path string, content binary")
    parts = docx.math_parts(docx.docx_parts(df)).collect()
    assert len(parts) == 1 and "$\\frac{\\sqrt[3]{\\alpha}}{b}$" in parts[0].xml


def test_facade(spark):
    from docloom import api

    df = spark.createDataFrame([("a.html", b"<p>x"), ("b.bin", b"\x00")], "path string, content binary")
    assert [r.markdown for r in api.to_markdown(df).orderBy("path").collect()] == ["x\n", ""]
    assert {r.path: r.supported for r in api.is_supported(df).collect()} == {"a.html": True, "b.bin": False}
    listed = {(r.kind, r.value) for r in api.supported_types(spark).collect()}
    assert {v for k, v in listed if k == "extension"} == {".docx"} and len(listed) == 10  # the word-processor converter alone
    assert api.providers["mistral"]["default"] == "pixtral-12b-latest"
