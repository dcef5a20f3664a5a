"""Office math to LaTeX by the structure of its XML.

Fragments are read leniently: prefixes need no declaration, an end tag without a
start is passed over, elements left open end with the text. Each element is then
rendered from its parts, so fractions, scripts and roots nest to any depth.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.textrules import LATEX

#: end mark, name without prefix, sign of an empty element, text
_PIECE = re.compile(r"<(/?)(?:[A-Za-z_][\w.-]*:)?([A-Za-z_][\w.-]*)(?:\s[^<>]*?)?(/?)>|<[!?][^<>]*>|([^<]+|<)")
_WORD_PREFIX = re.compile(r"[a-zA-Z]+:")
Part = tuple[str, str]  # an element's name and LaTeX; text has no name


def local_name(tag: str) -> str:
    return tag.rpartition("}")[2]


def child(e: ET.Element | None, *path: str) -> ET.Element | None:
    for p in path:
        e = next((k for k in e if local_name(k.tag) == p), None) if e is not None else None
    return e


def _text(name: str, text: str) -> str:
    """Text inside an element; blanks between elements are none."""
    if name != "t" and not text.strip():
        return ""
    return text if text.isascii() else "".join(f"{LATEX[c]} " if c in LATEX else c for c in text)


def _part(parts: list[Part], name: str) -> str:
    return next((x.strip() for n, x in parts if n == name), "")


def _render(name: str, parts: list[Part], degrees: bool) -> str:
    """An element as LaTeX from its rendered parts. Without ``degrees`` every root is a square root."""
    if name == "f":
        return f"\\frac{{{_part(parts, 'num')}}}{{{_part(parts, 'den')}}}"
    if name in ("sSup", "sSub", "sSubSup"):
        low = f"_{{{_part(parts, 'sub')}}}" if name != "sSup" else ""
        return _part(parts, "e") + low + (f"^{{{_part(parts, 'sup')}}}" if name != "sSub" else "")
    if name == "rad":
        degree = _part(parts, "deg") if degrees else ""
        return "\\sqrt" + (f"[{degree}]" if degree else "") + f"{{{_part(parts, 'e')}}}"
    if name.endswith("Pr"):
        return ""  # properties are no content
    return "".join([x for _, x in parts])


def latex(root: ET.Element) -> str:
    """An element of a parsed file as LaTeX; parts come before the whole, so depth is no limit."""
    done: dict[ET.Element, str] = {}
    todo = [(root, False)]
    while todo:
        e, ready = todo.pop()
        if not ready:
            todo.append((e, True))
            todo += [(k, False) for k in e]
            continue
        name = local_name(e.tag)
        parts = [("", _text(name, e.text))] if e.text else []
        for k in e:
            parts.append((local_name(k.tag), done.pop(k)))
            if k.tail:
                parts.append(("", _text(name, k.tail)))
        done[e] = _render(name, parts, True)
    return done[root]


def fragment_to_latex(xml: str | None, literal: bool = False) -> str | None:
    """A fragment of XML as LaTeX, rendered while it is read."""
    if xml is None:
        return None
    names, levels = [""], [[]]
    for end, name, void, text in _PIECE.findall(xml):
        if text:
            text = _WORD_PREFIX.sub("", text) if literal else unescape(text) if "&" in text else text
            levels[-1].append(("", _text(names[-1], text)))
        elif end:
            if name in names:
                while True:
                    last, parts = names.pop(), levels.pop()
                    levels[-1].append((last, _render(last, parts, not literal)))
                    if last == name:
                        break
        elif void:
            levels[-1].append((name, _render(name, [], not literal)))
        elif name:
            names.append(name)
            levels.append([])
    while len(names) > 1:
        last, parts = names.pop(), levels.pop()
        levels[-1].append((last, _render(last, parts, not literal)))
    return " ".join("".join([x for _, x in levels[0]]).split())


def omml_to_latex(xml: Column, compat: str = "default") -> Column:
    """Office math to LaTeX: fractions, scripts, roots, runs, symbols; null gives null.

    ``literal`` keeps two observed quirks: words before a colon go in text too, and
    roots lose their degree. Nesting is right in both.
    """
    literal = compat == "literal"

    @F.pandas_udf("string")
    def convert(s: pd.Series) -> pd.Series:
        return s.map(lambda x: fragment_to_latex(x, literal), na_action="ignore")

    return convert(xml)
