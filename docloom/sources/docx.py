"""Word-processor files: zip parts -> HTML, with equations as LaTeX.

Uses only the standard library inside one Arrow pass. Covered: paragraphs,
heading styles, bold and italics, lists, tables, links, line breaks, images by
their description, footnotes, equations, a style map from names to tags.
A damaged file gives null and an error.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from html import escape

from pyspark.sql import DataFrame

from docloom.functions.arrow import map_columns
from docloom.functions.mathxml import child as _kid
from docloom.functions.mathxml import latex as math_latex
from docloom.functions.mathxml import local_name as _local

PARTS = ("word/document.xml", "word/footnotes.xml", "word/endnotes.xml")
_HEADING = re.compile(r"heading\s*([1-6])$", re.I)


def _attr(e: ET.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if _local(k) == name), None)


class _Html:
    def __init__(self, rels: dict[str, str], styles: dict[str, str], ordered: set[str], style_map: dict[str, str], math: bool) -> None:
        self.rels, self.styles, self.ordered, self.map, self.math = rels, styles, ordered, style_map, math

    def run(self, r: ET.Element) -> str:
        out = ""
        for k in r:
            t = _local(k.tag)
            if t == "t":
                out += escape(k.text or "", quote=False)
            elif t == "tab":
                out += "\t"
            elif t == "br":
                out += "<br>"
            elif t in ("drawing", "pict"):
                alt = next((_attr(x, "descr") for x in k.iter() if _attr(x, "descr")), "")
                src = next((self.rels.get(_attr(x, "embed") or "", "") for x in k.iter() if _attr(x, "embed")), "")
                out += f'<img alt="{escape(alt)}" src="{escape(src)}">'
            elif t == "footnoteReference":
                out += f"<sup>[{_attr(k, 'id')}]</sup>"
        p = _kid(r, "rPr")
        on = lambda n: (b := _kid(p, n)) is not None and (_attr(b, "val") or "1") not in ("0", "false", "none")
        if out.strip() and on("i"):
            out = f"<em>{out}</em>"
        if out.strip() and on("b"):
            out = f"<strong>{out}</strong>"
        return out

    def inline(self, e: ET.Element) -> str:
        out = ""
        for k in e:
            t = _local(k.tag)
            if t == "r":
                out += self.run(k)
            elif t == "hyperlink":
                href = self.rels.get(_attr(k, "id") or "") or (f"#{a}" if (a := _attr(k, "anchor")) else "")
                out += f'<a href="{escape(href)}">{self.inline(k)}</a>' if href else self.inline(k)
            elif t == "oMathPara":
                out += "".join(f"$${math_latex(m).strip()}$$" if self.math else escape("".join(x.text or "" for x in m.iter() if _local(x.tag) == "t")) for m in k if _local(m.tag) == "oMath")
            elif t == "oMath":
                out += f"${math_latex(k).strip()}$" if self.math else escape("".join(x.text or "" for x in k.iter() if _local(x.tag) == "t"))
            elif t in ("ins", "smartTag", "sdt", "sdtContent", "fldSimple"):
                out += self.inline(k)
        return out

    def blocks(self, body: ET.Element) -> str:
        out, depth = "", []
        for k in body:
            t = _local(k.tag)
            if t == "p":
                style = self.styles.get(_attr(_kid(k, "pPr", "pStyle"), "val") or "", "") if _kid(k, "pPr", "pStyle") is not None else ""
                num, text = _kid(k, "pPr", "numPr"), self.inline(k)
                if num is not None and text:
                    lvl = int(_attr(_kid(num, "ilvl"), "val") or 0) if _kid(num, "ilvl") is not None else 0
                    tag = "ol" if _kid(num, "numId") is not None and _attr(_kid(num, "numId"), "val") in self.ordered else "ul"
                    while len(depth) > lvl + 1:
                        out += f"</li></{depth.pop()}>"
                    if len(depth) == lvl + 1:
                        out += "</li><li>"
                    while len(depth) < lvl + 1:
                        depth.append(tag)
                        out += f"<{tag}><li>"
                    out += text
                    continue
                while depth:
                    out += f"</li></{depth.pop()}>"
                h = _HEADING.match(style)
                tag = self.map.get(style) or (f"h{h[1]}" if h else "h1" if style.lower() == "title" else "p")
                out += f"<{tag}>{text}</{tag}>" if text else ""
            elif t == "tbl":
                while depth:
                    out += f"</li></{depth.pop()}>"
                rows = "".join("<tr>" + "".join(f"<td>{self.blocks(c)}</td>" for c in r if _local(c.tag) == "tc") + "</tr>" for r in k if _local(r.tag) == "tr")
                out += f"<table>{rows}</table>"
            elif t in ("sdt", "sdtContent", "body", "ins"):
                out += self.blocks(k)
        while depth:
            out += f"</li></{depth.pop()}>"
        return out


def docx_html(content: bytes, style_map: dict[str, str] | None = None, math: bool = True) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        xml = lambda n: ET.fromstring(z.read(n)) if n in names else None
        doc = xml("word/document.xml")
        if doc is None:
            raise ValueError("corrupted: word/document.xml is missing")
        rel = xml("word/_rels/document.xml.rels")
        rels = {_attr(r, "Id"): _attr(r, "Target") or "" for r in rel} if rel is not None else {}
        sty = xml("word/styles.xml")
        styles = {_attr(s, "styleId"): _attr(_kid(s, "name"), "val") or "" for s in sty if _kid(s, "name") is not None} if sty is not None else {}
        num = xml("word/numbering.xml")
        ordered: set[str] = set()
        if num is not None:
            kinds = {_attr(a, "abstractNumId"): next((_attr(f, "val") for f in a.iter() if _local(f.tag) == "numFmt"), "bullet") for a in num if _local(a.tag) == "abstractNum"}
            ordered = {_attr(n, "numId") for n in num if _local(n.tag) == "num" and kinds.get(_attr(_kid(n, "abstractNumId"), "val"), "bullet") != "bullet"}
        ids = {_attr(x, "val") for x in doc.iter() if _local(x.tag) == "pStyle"}
        for i in ids:
            if i and i not in styles:
                styles[i] = re.sub(r"(?<=[a-z])(?=\d)", " ", i)
        w = _Html(rels, styles, ordered, style_map or {}, math)
        out = w.blocks(doc)
        for part in PARTS[1:]:
            try:
                notes = xml(part)
            except ET.ParseError:
                continue  # a damaged part is left out, the rest stands
            for n in notes if notes is not None else ():
                if (_attr(n, "id") or "0") not in ("-1", "0"):
                    out += f"<p>[{_attr(n, 'id')}] {re.sub('</?p>', ' ', w.blocks(n)).strip()}</p>"
        return out


def docx_to_html(df: DataFrame, id_col: str = "path", content_col: str = "content", style_map: dict[str, str] | None = None, math: bool = True) -> DataFrame:
    """(id, html, error): a row for each file."""

    def one(c):
        try:
            return (docx_html(c, style_map, math), None) if c is not None else (None, "corrupted: no content")
        except (zipfile.BadZipFile, ET.ParseError, ValueError, KeyError, RuntimeError) as e:
            return None, f"invalid zip or document: {e}"

    def fn(ids, contents):
        got = [one(c) for c in contents]
        return {id_col: ids, "html": [g[0] for g in got], "error": [g[1] for g in got]}

    kind = df.schema[id_col].dataType.simpleString()
    return map_columns(df.select(id_col, content_col), fn, f"{id_col} {kind}, html string, error string")


def docx_parts(df: DataFrame, id_col: str = "path", content_col: str = "content") -> DataFrame:
    """(id, part, xml) of the text parts; a damaged file gives no row."""

    def fn(ids, contents):
        rows = []
        for i, c in zip(ids, contents):
            try:
                with zipfile.ZipFile(io.BytesIO(c or b"")) as z:
                    rows += [(i, p, z.read(p).decode("utf-8", "replace")) for p in PARTS if p in z.namelist()]
            except zipfile.BadZipFile:
                pass
        return dict(zip((id_col, "part", "xml"), map(list, zip(*rows) if rows else [()] * 3)))

    kind = df.schema[id_col].dataType.simpleString()
    return map_columns(df.select(id_col, content_col), fn, f"{id_col} {kind}, part string, xml string")


_PARA = re.compile(r"<(?:m:)?oMathPara[^>]*>(.*?)</(?:m:)?oMathPara>", re.S | re.I)
_ONE = re.compile(r"<(?:m:)?oMath(?:\s[^>]*)?>.*?</(?:m:)?oMath>", re.S | re.I)
_NS = re.compile(r"(</?)[A-Za-z]+:|\s[A-Za-z]+:[\w.-]+=(?:\"[^\"]*\"|'[^']*')")


def fragment_latex(xml: str) -> str:
    """LaTeX of one equation's XML; what cannot be parsed gives its plain text."""
    try:
        return re.sub(r"\s+", " ", math_latex(ET.fromstring(_NS.sub(lambda m: m[1] or "", xml)))).strip()
    except ET.ParseError:
        return re.sub(r"\s+", " ", re.sub(r"<[^>]*>", " ", xml)).strip()


def rewrite_math(xml: str) -> str:
    """A text part with every equation as a run of LaTeX: block equations
    between double dollars in a paragraph of their own, others between single ones."""
    run = lambda m, d: f"<w:r><w:t>{d}{escape(fragment_latex(m), quote=False)}{d}</w:t></w:r>"

    def block(m: re.Match) -> str:
        inner = _ONE.findall(m[1])
        return f"<w:p>{''.join(run(x, '$$') for x in inner)}</w:p>" if inner else m[0]

    return _ONE.sub(lambda m: run(m[0], "$"), _PARA.sub(block, xml))


def math_parts(parts: DataFrame, id_col: str = "path") -> DataFrame:
    """(id, part, xml) -> the same with equations rewritten; a part that fails stays as it was."""

    def fn(ids, names, xmls):
        return {id_col: ids, "part": names, "xml": [rewrite_math(x) if x else x for x in xmls]}

    kind = parts.schema[id_col].dataType.simpleString()
    return map_columns(parts.select(id_col, "part", "xml"), fn, f"{id_col} {kind}, part string, xml string")
