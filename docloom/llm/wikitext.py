"""Wiki pages as a reader sees them, and their prose and list lines."""

from __future__ import annotations

import html
import re

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_NOWIKI = re.compile(r"</?nowiki\s*/?>", re.I)
_INNER = re.compile(r"\{\{[^{}]*\}\}|\{\{\{[^{}]*\}\}\}")
_TABLE = re.compile(r"^[ \t:]*\{\|.*?^[ \t]*\|\}", re.M | re.S)
_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9:]*(?:\s[^<>]*)?/?>")
_LINK = re.compile(r"\[\[([^\[\]|\n]*)(?:\|([^\[\]]*))?\]\]")
_EXTERNAL = re.compile(r"\[(?:https?|ftp)://[^\s\]]+[ \t]*([^\]\n]*)\]|\[mailto:[^\s\]]+[ \t]*([^\]\n]*)\]")
_QUOTES = re.compile(r"'{2,5}")
# fixed values: link prefixes whose target is no text of the page
_SILENT = re.compile(r"\s*(?:category|kategorie|catégorie|file|image|datei|bild|fichier)\s*:", re.I)


def _label(m: re.Match) -> str:
    target, label = m[1], m[2]
    if label is not None:
        last = label.rsplit("|", 1)[-1]
        return last if last.strip() else target
    return "" if _SILENT.match(target) else target


def visible(text: str) -> str:
    """Tags, templates, comments and marks of bold or italics dropped, links as
    their labels, entities decoded. Table and heading marks are punctuation and stay."""
    if "<" in text:
        text = _TAG.sub("", _NOWIKI.sub("", _COMMENT.sub("", text)))
    while "{{" in text:
        text, n = _INNER.subn("", text)
        if not n:
            break
    if "[" in text:
        while "[[" in text:
            text, n = _LINK.subn(_label, text)
            if not n:
                break
        if "://" in text or "mailto:" in text:
            text = _EXTERNAL.sub(lambda m: m[1] or m[2] or "", text)
    if "''" in text:
        text = _QUOTES.sub("", text)
    return html.unescape(text) if "&" in text else text


def running_lines(text: str) -> list[str]:
    """The prose and list lines: no tables, headings, templates, switches or media lines."""
    text = _COMMENT.sub("", text) if "<!--" in text else text
    if "{|" in text and "|}" in text:
        text = _TABLE.sub("", text)
    return [s for s in map(str.strip, visible(text).split("\n")) if s and s[0] not in "=|!{" and not s.startswith("__")]
