"""Problem 1: markup residue -> clean Markdown, structure kept.

Code and formulas are taken out first and put back last. The remaining HTML,
wiki and LaTeX markup is rewritten to Markdown (headings, lists, tables, links,
emphasis) or stripped; each piece leaves a mark of its kind at its place, and a
link's label is marked as such. A line-block distribution over the stripped
lines follows. A line weighs its text length; labels of links weigh nothing, and
lines without any mark, code, formulas, list items and table rows with text of
their own weigh at least ``surge``. The weights of each ``window`` of lines are
summed: a window that reaches ``surge`` is a surge, windows below it a dive, and
the text between them stays, but for runs of a window or more without any weight.
List items and table rows that follow a span belong to it. So menus, rows of
links and stray remains go where they form runs of their own; short lines beside
text stay. A text of at most one window is one span. The marks are counted line by
line in the same pass, over kept and dropped lines; ``p1_found`` reads these
counts.

Defined results: null text gives null and no counts; empty text stays empty;
text without residue comes back as it is, line ends included; texts of any
length are processed whole, in linear time but for templates and links nested in
each other; an unclosed fence is no code block.
"""

from __future__ import annotations

import html as _html
import re
from html.entities import html5

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.arrow import map_columns
from docloom.llm.fences import closers, lines_of

KINDS = ("html", "wiki", "latex")

WINDOW, SURGE = 3, 20
#: private characters: around the number of a held span; residue of each kind; the start of a link's label
HOLD, *MARKS, LABEL = map(chr, range(0xF0000, 0xF0005))
_ANY = re.compile(f"[{HOLD}-{LABEL}]")
_M = f"[{MARKS[0]}-{LABEL}]"  # marks are no text: patterns pass over them
_PROTECT = re.compile(
    r"(?P<b>(?<!\\)(?<!`)(?P<run>`+)(?!`)(?:(?!\n[ \t]*\n).)+?(?<!`)(?P=run)(?!`))"
    r"|(?P<d>(?<!\\)\$\$(?:(?!\$\$).)+?\$\$)"
    r"|(?P<s>(?<![\\$])\$(?=[^\s$])[^$\n]*?(?<=[^\s\\])\$(?![\d$]))",
    re.M | re.S,
)
#: every residue holds one of these; plain substring search is much faster than a pattern
_SIGNS = ("<", "&", "\\", "[[", "[h", "[f", "[m", "{", "''", "__", "=", "#R", "#r")

# fixed values: HTML element names, their roles, and attributes that stand without a value
_BLOCK = frozenset("address article aside blockquote body center dd div dl dt fieldset figcaption figure footer form header hr html main nav noscript p section summary details".split())
_ELEMENTS = _BLOCK | frozenset(
    "a abbr acronym area audio b base big br button canvas caption cite code col colgroup data datalist del dfn em embed font frame frameset h1 h2 h3 h4 h5 h6 head i iframe img input ins kbd label legend li link map mark menu meta meter object ol optgroup option output picture pre progress q rp rt ruby s samp script select slot small source span strike strong style sub sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr ref references nowiki gallery syntaxhighlight math poem includeonly noinclude onlyinclude marquee nobr blink".split()
)
_BARE = "allowfullscreen|async|autofocus|checked|compact|controls|defer|disabled|hidden|ismap|loop|multiple|muted|nohref|noresize|noshade|novalidate|nowrap|open|readonly|required|reversed|selected"
_TAG = re.compile(
    rf"""<(?P<close>/?)(?P<name>[A-Za-z][A-Za-z0-9]*(?::[A-Za-z][\w.-]*)?)(?P<attrs>(?:\s+(?:[A-Za-z_@:][\w.:-]*\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'=<>`]+)|(?:{_BARE})\b))*)\s*/?>""",
    re.I,
)
_DECLARED = re.compile(r"<!DOCTYPE[^<>]*>|<\?xml[^<>]*\?>|<!\[CDATA\[|\]\]>(?=\s*$)", re.S | re.I)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_ATTR = re.compile(r"""([A-Za-z_@:][\w.:-]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+))""")
_COMMENT, _COMMENT_END = re.compile("<!--"), re.compile("-->")
_DROP_BODY = {n: (re.compile(rf"<{n}\b[^<>]*(?<!/)>", re.I), re.compile(rf"</{n}\s*>", re.I)) for n in ("script", "style", "ref")}

# fixed values: wiki behaviour switches
_SWITCH = re.compile(r"__(?:NOTOC|TOC|FORCETOC|NOEDITSECTION|NEWSECTIONLINK|NONEWSECTIONLINK|NOGALLERY|HIDDENCAT|INDEX|NOINDEX|STATICREDIRECT|NOTITLECONVERT|NOCONTENTCONVERT|NOTC|NOCC|DISAMBIG|EXPECTUNUSEDCATEGORY)__")
_PARAM = re.compile(r"\{\{\{[^{}]*\}\}\}")
_TEMPLATE = re.compile(r"\{\{[^{}]*\}\}")
_LINK = re.compile(r"\[\[(?P<t>[^\[\]{}|<>\n]+)(?:\|(?P<l>[^\[\]]*))?\]\]")
_EXTERNAL = re.compile(r"\[(?P<u>(?:https?|ftp)://[^\s\]]+|mailto:[^\s\]]+)(?:[ \t]+(?P<l>[^\]\n]+))?\](?![(\[:])")
_TABLE_OPEN, _TABLE_END = (re.compile(rf"^(?:[ \t]|{_M})*{q}", re.M) for q in (r"\{\|", r"\|\}"))
_TABLE_LINE = re.compile(rf"^(?:[ \t]|{_M})*\{{\|[^\n]*$", re.M)
_WIKI_HEAD = re.compile(rf"^(?:[ \t]|{_M})*(?P<m>={{1,6}})[ \t]*(?P<t>[^=\s](?:[^\n]*?[^=\s])?)[ \t]*(?P=m)(?:[ \t]|{_M})*$", re.M)
_REDIRECT = re.compile(rf"^(?:[ \t]|{_M})*#redirect\b:?[ \t]*", re.M | re.I)
_BOLD5, _BOLD, _ITALIC = (re.compile(rf"(?<![\w']){q}(?=[^\s'])(.+?)(?<=[^\s']){q}(?!')") for q in ("'''''", "'''", "''"))
_MEDIA = re.compile(r"^:?(?:file|image|datei|fichier|category|kategorie|catégorie)\s*:", re.I)

# fixed values: LaTeX commands that stand without braces
_LATEX_BARE = "maketitle|tableofcontents|noindent|indent|centering|raggedright|raggedleft|item|par|newline|linebreak|newpage|clearpage|cleardoublepage|pagebreak|hline|toprule|midrule|bottomrule|appendix|bigskip|medskip|smallskip|vfill|hfill|quad|qquad|ldots|dots|cdots|LaTeX|TeX|bf|it|em|rm|sf|tt|sc|sl|bfseries|itshape|ttfamily|tiny|scriptsize|footnotesize|small|normalsize|large|Large|LARGE|huge|Huge|today|textbackslash|textasciitilde|alpha|beta|gamma|delta|epsilon|theta|lambda|mu|pi|sigma|phi|omega|Delta|Omega|Sigma|times|cdot|pm|leq|geq|neq|approx|infty|sum|int|prod|to|rightarrow|leftarrow|partial|nabla|degree|copyright|pounds|S|P|dag|ss|ae|oe|aa|o|l|left|right|nobreakspace"
_PATH = re.compile(r"(?<![A-Za-z])[A-Za-z]:\\[^\s\"'<>|*?]*|(?<![\w\\])\\\\[A-Za-z][\w.$-]*\\[^\s\"'<>|*?]*|(?<=\w)\\[\w.-]+\.\w{1,5}\b")
_LATEX = re.compile(
    r"\\(?P<env>begin|end)\s*\{(?P<name>[A-Za-z]+\*?)\}(?:\s*[\[{][^\]}\n]*[\]}])*"
    r"|\\(?P<cmd>[A-Za-z]{2,}\*?|[cvHukdb](?=\{))(?:\[[^\]\n]*\])?\{"
    rf"|(?<![A-Za-z0-9])\\(?P<bare>(?:{_LATEX_BARE})(?![A-Za-z])\*?)"
    r"|(?P<br>\\\\(?:\[[^\]\n]*\])?(?=[ \t]*(?:$|\\(?:hline|end|midrule|bottomrule))))"
    r"|(?P<sp>(?<=[\w.)])\\[,;:!](?=\s|\\|\w)|(?<=\d)\\%|(?<=\\,)\\%)",
    re.M | re.S,
)
_OPEN, _MATH_SIGN, _BLANK = re.compile(r"\\[(\[]"), re.compile(r"\\[A-Za-z]|[\^_=]"), re.compile(r"\n[ \t]*\n")
_LATEX_ACCENT = re.compile(r"\\[\"'`^~]\{[A-Za-z]\}")
_HEAD_CMD = {"part": 1, "chapter": 1, "title": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5, "subparagraph": 6}
_DROP_CMD = frozenset("label ref eqref pageref autoref cref cite citep citet citeauthor citeyear nocite bibliography bibliographystyle usepackage documentclass author date vspace hspace includegraphics pagestyle thispagestyle setlength input include index".split())
_WRAP = {"emph": "*", "textit": "*", "it": "*", "textsl": "*", "textbf": "**", "mathbf": "**", "texttt": "`", "verb": "`"}
_MATH_ENVS = frozenset("equation align gather multline displaymath eqnarray math".split())
_STRUCTURE = re.compile(r"[ \t]*(?:[-*+] |\d+[.)] |\|)")
_MD_LINK = re.compile(r"!?\[[^\[\]\n]*\]\([^()\n]*\)|<(?:https?|ftp|mailto):[^<>\n]*>")
_LABELLED = re.compile(f"{LABEL}[^{LABEL}{MARKS[1]}\n]*{MARKS[1]}")
_RULE = re.compile(r"[\s|*#`·•»›>/:_-]+")


def _hold_code(text: str, held: list[str]) -> str:
    """Fenced blocks, inline code and formulas become numbered tokens."""
    if "```" in text or "~~~" in text:
        lines = lines_of(text)
        out, pos = [], 0
        for k, end in closers(text, lines).items():  # in order
            a, b = lines[k][0], lines[end][1]
            while b > a and text[b - 1] in "\r\n":
                b -= 1
            out += [text[pos:a], _token(text[a:b], held)]
            pos = b
        text = "".join(out) + text[pos:]
    if "`" in text or "$" in text:
        text = _PROTECT.sub(lambda m: _token(m[0], held), text)
    return text


def _token(what: str, held: list[str]) -> str:
    held.append(what)
    return f"{HOLD}{len(held) - 1}{HOLD}"


def _restore(text: str, held: list[str]) -> str:
    if HOLD not in text:
        return text
    return _HELD.sub(lambda m: _restore(held[int(m[1])], held), text)


_ANY_MARK = re.compile(_M)
_HELD = re.compile(f"{HOLD}(\\d+){HOLD}")


def _marks(text: str, kind: int | None = None) -> str:
    """The marks of a text that goes, so that they are counted where it stood."""
    return "".join(c for c in text if c in MARKS) + (MARKS[kind] if kind is not None else "")


def _cut(opening: re.Pattern, closing: re.Pattern, text: str, new) -> str:
    """Replace each span from an opening to the next closing mark; both are searched once."""
    out, pos = [], 0
    while m := opening.search(text, pos):
        end = closing.search(text, m.end())
        if not end:
            break
        out += [text[pos : m.start()], new(text[m.start() : end.end()])]
        pos = end.end()
    return "".join(out) + text[pos:]


def _cells(row: list[str]) -> str:
    return "| " + " | ".join(_ANY_MARK.sub("", c).strip().replace("\n", " ").replace("|", "\\|") + _marks(c) for c in row) + " |"


def _grid(rows: list[list[str]]) -> str:
    rows = [r for r in rows if r]
    if not rows:
        return ""
    n = max(map(len, rows))
    rows = [r + [""] * (n - len(r)) for r in rows]
    return "\n".join([_cells(rows[0]), "|" + "---|" * n, *map(_cells, rows[1:])])


def _html_to_md(text: str) -> str:
    html = MARKS[0]

    def known(m: re.Match) -> bool:
        n = m["name"].lower()
        return n in _ELEMENTS or (":" in n and n.split(":")[0] not in ("http", "https", "ftp", "mailto", "tel", "urn", "file", "data")) or "=" in m["attrs"]

    if "<!--" in text:
        text = _cut(_COMMENT, _COMMENT_END, text, lambda x: html)
    text = _DECLARED.sub(html, text)
    if "</" in text:
        for opening, closing in _DROP_BODY.values():
            text = _cut(opening, closing, text, lambda x: _marks(x) + html * 2)
    if "<" in text:
        out: list[str] = []
        pos, lists, hrefs, rows, cell_at, cell_pipes = 0, [], [], None, None, False

        def end_cell() -> None:
            nonlocal cell_at
            if cell_at is not None:
                body = "".join(out[cell_at:])
                del out[cell_at:]
                if rows is not None:
                    (rows or rows.append([]))
                    rows[-1].append(body)
                cell_at = None

        for m in _TAG.finditer(text):
            if not known(m):
                continue
            out += [text[pos : m.start()], html]
            pos, name, close = m.end(), m["name"].lower(), bool(m["close"])
            attrs = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTR.findall(m["attrs"])} if name in ("a", "img") else {}
            inside = cell_at is not None
            if name == "br":
                out.append(" " if inside or text[text.rfind("\n", 0, m.start()) + 1 : m.start()].lstrip()[:1] == "|" else "\n")
            elif name in ("h1", "h2", "h3", "h4", "h5", "h6"):
                out.append("\n\n" if close else "\n\n" + "#" * int(name[1]) + " ")
            elif name in ("ul", "ol", "menu"):
                if close:
                    del lists[-1:]
                else:
                    lists.append([name, 0])
                out.append("\n")
            elif name == "li" and not close:
                if lists:
                    lists[-1][1] += 1
                out.append("\n" + "  " * max(0, len(lists) - 1) + (f"{lists[-1][1]}. " if lists and lists[-1][0] == "ol" else "- "))
            elif name == "table":
                end_cell()
                if close:
                    out.append("\n\n" + _grid(rows or []) + "\n\n")
                    rows = None
                elif rows is None:
                    rows = []
            elif name == "tr":
                end_cell()
                if rows is not None and not close:
                    rows.append([])
            elif name in ("td", "th"):
                end_cell()
                if not close and rows is not None:
                    cell_at = len(out)
            elif name in ("b", "strong", "i", "em"):
                out.append("**" if name in ("b", "strong") else "*")
            elif name in ("code", "kbd", "samp", "tt"):
                out.append("`")
            elif name == "pre":
                out.append("\n```\n")
            elif name == "hr":
                out.append("\n\n---\n\n")
            elif name == "a":
                if close:
                    href = hrefs.pop() if hrefs else None
                    out.append(f"]({href})" if href else "")
                else:
                    hrefs.append(attrs.get("href"))
                    out.append("[" if attrs.get("href") else "")
            elif name == "img":
                out.append(f"![{attrs.get('alt') or ''}]({attrs.get('src') or ''})")
            elif name in _BLOCK and not inside:
                out.append("\n\n")
        out.append(text[pos:])
        end_cell()
        if rows:
            out.append("\n\n" + _grid(rows) + "\n\n")
        text = "".join(out)
    if "&" in text:

        def entity(m: re.Match) -> str:
            if m[0][1] != "#" and m[0][1:] not in html5:
                return m[0]
            got = _html.unescape(m[0])
            return html + (" " if got in "\u00a0\u2007\u202f\u00ad\u200b" else got)

        text = _ENTITY.sub(entity, text)
    return text


def _wiki_table(text: str) -> str:
    rows: list[list[str]] = [[]]
    for line in text.split("\n")[1:-1]:
        s = _ANY_MARK.sub("", line).strip()
        if s.startswith("|-"):
            rows.append([])
        elif s.startswith("|+"):
            continue
        elif s[:1] in ("|", "!"):
            parts = re.split(r"\|\||!!" if s[0] == "!" else r"\|\|", s[1:])
            rows[-1] += [p.split("|")[-1] if re.match(r"\s*\w+\s*=", p) and "|" in p else p for p in parts]
        elif s and rows[-1]:
            rows[-1][-1] += " " + s
    return _marks(text, 1) + "\n" + _grid(rows) + "\n"


def _wiki_to_md(text: str) -> str:
    wiki = MARKS[1]
    gone = lambda m: _marks(m[0], 1)
    if "{{" in text:
        n = 1
        while n:
            text, n = _PARAM.subn(gone, text)
            text, k = _TEMPLATE.subn(gone, text)
            n += k
    if "[[" in text:

        def link(m: re.Match) -> str:
            got = target_or_label(m)
            lost = _marks(m[0])[len(_marks(got)) :]
            return lost + (LABEL + got.replace(wiki, "").replace(LABEL, "") + wiki + wiki * got.count(wiki) if got else wiki)

        def target_or_label(m: re.Match) -> str:
            label = m["l"]
            if _MEDIA.match(m["t"].strip()):
                keep = label.split("|")[-1].strip() if label and not re.match(r"\s*:?(?:cat|kat)", m["t"], re.I) else ""
                return "" if keep in ("thumb", "frame", "left", "right", "center", "none") or re.fullmatch(r"\d+px", keep) else keep
            return label.split("|")[-1] if label else m["t"].lstrip(":")

        n = 1
        while n:
            text, n = _LINK.subn(link, text)
    if "[" in text:
        text = _EXTERNAL.sub(lambda m: (f"[{m['l']}]({m['u']})" if m["l"] else f"<{m['u']}>") + wiki, text)
    if "{|" in text:
        text = _cut(_TABLE_OPEN, _TABLE_END, text, _wiki_table)
        text = _TABLE_LINE.sub(gone, text)
    if "''" in text:
        for rx, sign in ((_BOLD5, "***"), (_BOLD, "**"), (_ITALIC, "*")):
            text = rx.sub(lambda m, s=sign: f"{s}{m[1]}{s}{wiki}", text)
    if "=" in text:
        text = _WIKI_HEAD.sub(lambda m: "#" * len(m["m"]) + " " + m["t"] + wiki + _marks(m[0])[len(_marks(m["t"])) :], text)
    if "__" in text:
        text = _SWITCH.sub(gone, text)
    return _REDIRECT.sub(gone, text)


def _closing(text: str, i: int) -> int:
    """Index after the brace that closes the one before ``i``, or of the end."""
    depth = 1
    while i < len(text) and depth:
        depth += {"{": 1, "}": -1}.get(text[i], 0) * (text[i - 1] != "\\")
        i += 1
    return i


def _hold_math(text: str, held: list[str]) -> str:
    """LaTeX's own formula marks become dollar signs, and the formulas are held out.

    A formula ends at the closing mark of its kind before the next blank line and
    holds a sign of mathematics. Each next place is searched once: linear time.
    """
    out, pos, ahead = [], 0, {}
    paths, p = [m.span() for m in _PATH.finditer(text)], 0

    def following(what: str, i: int) -> int:
        if ahead.get(what, -1) < i:
            m = {"sign": _MATH_SIGN, "blank": _BLANK}[what].search(text, i) if what in ("sign", "blank") else None
            at = m.start() if m else text.find(what, i) if what[0] == "\\" else -1
            ahead[what] = at if at >= 0 else len(text)
        return ahead[what]

    for m in _OPEN.finditer(text):
        if m.start() < pos:
            continue
        while p < len(paths) and paths[p][1] <= m.start():
            p += 1
        a, end = m.end(), following("\\)" if m[0] == "\\(" else "\\]", m.end())
        if end == len(text) or following("blank", a) < end or following("sign", a) >= end or p < len(paths) and paths[p][0] <= m.start():
            continue
        body = _ANY_MARK.sub("", _restore(text[a:end].strip(), held))
        token = _token("$" + re.sub(r"\s*\n\s*", " ", body) + "$" if m[0] == "\\(" else f"$${body}$$", held)
        out += [text[pos : m.start()], token, _marks(text[a:end], 2)]
        pos = end + 2
    return "".join(out) + text[pos:]


def _latex_to_md(text: str, depth: int = 0) -> str:
    latex, found = MARKS[2], False
    out, pos, envs, paths = [], 0, [], [m.span() for m in _PATH.finditer(text)] if "\\" in text else []
    p = 0
    while m := _LATEX.search(text, pos):
        while p < len(paths) and paths[p][1] <= m.start():
            p += 1
        if p < len(paths) and paths[p][0] <= m.start() < paths[p][1]:
            out.append(text[pos : paths[p][1]])
            pos = paths[p][1]
            continue
        out.append(text[pos : m.start()])
        pos = m.end()
        if m["cmd"] and (m.start() and text[m.start() - 1].isalnum() and _PATH.match(text, m.start())):
            out.append(m[0])
            continue
        found = True
        if m["env"]:
            name = m["name"].rstrip("*")
            if m["env"] == "begin" and name in ("tabular", "array", "tabularx", "longtable"):
                end = re.compile(rf"\\end\s*\{{{name}\*?\}}").search(text, pos)
                body = text[pos : end.start() if end else len(text)]
                pos = end.end() if end else len(text)
                rows = [re.split(r"(?<!\\)&", re.sub(r"\\(?:hline|toprule|midrule|bottomrule)\b", "", r)) for r in re.split(r"\\\\(?:\[[^\]]*\])?", body)]
                out.append("\n" + _grid([[_latex_to_md(c, depth + 1) if depth < 20 else c for c in r] for r in rows if "".join(r).strip()]) + "\n")
            elif name in _MATH_ENVS:
                out.append("$$")
            else:
                if m["env"] == "begin":
                    envs.append([name, 0])
                elif envs:
                    envs.pop()
                if name in ("verbatim", "lstlisting"):
                    out.append("```")
        elif m["cmd"]:
            name, end = m["cmd"].rstrip("*"), _closing(text, pos)
            body = text[pos : end - 1 if text[end - 1 : end] == "}" else end]
            pos = end
            if name in _DROP_CMD:
                out[-1] = out[-1].rstrip("~") + _marks(body)
            else:
                body = _latex_to_md(body, depth + 1) if depth < 20 and "\\" in body else body
                if name in ("href", "textcolor", "colorbox") and text[pos : pos + 1] == "{":
                    end = _closing(text, pos + 1)
                    label = text[pos + 1 : end - 1]
                    pos = end
                    out.append(f"[{label}]({_ANY_MARK.sub('', body)})" + _marks(body) if name == "href" else label + _marks(body))
                elif name in _HEAD_CMD:
                    out.append("\n" * (not _at_line(out)) + "#" * _HEAD_CMD[name] + " " + body + "\n" * (text[pos : pos + 1] not in ("\n", "")))
                elif name == "footnote":
                    out.append(f" ({body})")
                else:
                    w = _WRAP.get(name, "") if body.strip() else ""
                    out.append(w + body + w)
        elif m["bare"]:
            b = m["bare"]
            if b == "item":
                if envs:
                    envs[-1][1] += 1
                out.append(f"{envs[-1][1]}." if envs and envs[-1][0] == "enumerate" else "-")
            elif b in ("ldots", "dots", "cdots"):
                out.append("…")
            elif b in ("LaTeX", "TeX"):
                out.append(b)
            elif text[pos : pos + 1] == " " and (_last(out).endswith("{") or _at_line(out)):
                pos += 1
        elif m["br"]:
            out.append("\n" if text[pos : pos + 1] not in ("\n", "") else "")
        else:
            out.append("%" if m["sp"][1] == "%" else " ")
        out.append(latex)
    out.append(text[pos:])
    text = "".join(out)
    if found or depth == 0 and latex in text:
        text = re.sub(r"(?<![\\${])\{([^{}\n\\]+)\}(?!\})", r"\1", text) if "{" in text else text
        text = re.sub(r"(?<=\w)~(?=[\w(])", " ", text)
    return text


def _at_line(out: list[str]) -> bool:
    last = _last(out)
    return not last or last.endswith("\n")


def _last(out: list[str]) -> str:
    """The last part with any text, without the marks at its end."""
    for part in reversed(out):
        if part := part.rstrip(_MARK_CHARS):
            return part
    return ""


_MARK_CHARS = "".join(MARKS) + LABEL


def line_blocks(weights: list[int], follows: list[bool] | None = None, window: int = WINDOW, surge: int = SURGE) -> list[bool]:
    """Line-block distribution: which lines lie between a surge and a dive point.

    A span is a run of windows whose sums reach ``surge``; a window's length or more
    of lines without weight are no part of it, but lines that may follow
    (``follows``) directly after a span belong to it. A text of at most one window
    is one span.
    """
    n = len(weights)
    if n <= window:
        return [True] * n
    keep, run, inside = [False] * n, sum(weights[:window]), 0
    for i in range(n - window + 1):
        if i:
            run += weights[i + window - 1] - weights[i - 1]
        if run >= surge:
            for j in range(max(i, inside), i + window):
                keep[j] = True
            inside = i + window
    # surge and dive points: runs of lines without weight at the edges of a span are no part of it
    i = 0
    while i < n:
        j = i
        while j < n and not weights[j]:
            j += 1
        if j - i >= window:
            after = i > 0 and keep[i - 1]
            for k in range(i, j):
                if not (after and follows and follows[k]):
                    after = False
                keep[k] = after
        i = max(j, i + 1)
    for i in range(1, n):
        if follows and follows[i] and keep[i - 1]:
            keep[i] = True
    return keep


def _weigh(line: str, touched: bool, surge: int) -> int:
    """Text length of a stripped line outside the labels of links."""
    if not touched:
        return max(len(line), surge)
    text = _ANY_MARK.sub("", _MD_LINK.sub("", _LABELLED.sub("", line)))
    n = len(_RULE.sub("", text))
    return max(n, surge) if n and (HOLD in text or _STRUCTURE.match(text)) else n


def clean_text(text: str | None, window: int = WINDOW, surge: int = SURGE) -> tuple[str | None, list[int]]:
    """Clean Markdown and the residue found: [html, wiki, latex]."""
    got, count, _ = clean_lines(text, window, surge)
    return got, count


def clean_lines(text: str | None, window: int = WINDOW, surge: int = SURGE) -> tuple[str | None, list[int], int]:
    """Clean Markdown, the residue found by kind, and the number of lines that were dropped."""
    count = [0, 0, 0]
    if not text or not any(x in text for x in _SIGNS):
        return text, count, 0
    work = text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text
    held: list[str] = []
    if _ANY.search(work):
        work = _ANY.sub(lambda m: _token(m[0], held), work)
    work = before = _hold_code(work, held)
    work = _html_to_md(work)
    if "\\(" in work or "\\[" in work:
        work = _hold_math(work, held)
    work = _wiki_to_md(_latex_to_md(work) if "\\" in work else work)
    if not _ANY_MARK.search(work):
        return text, count, 0
    own = {s.strip() for s in before.split("\n")}
    lines, weights, follows, places, dropped = [], [], [], [], 0
    for s in work.split("\n"):
        bare = _ANY_MARK.sub("", s) if (touched := bool(_ANY_MARK.search(s))) else s
        if touched:
            for k, c in enumerate(MARKS):
                count[k] += s.count(c)
        if not bare.strip(" \t*`#|-") and bare.strip() not in own and not bare.startswith("|---"):
            dropped += bool(touched)
            continue  # nothing but markup
        if bare.strip():
            places.append(len(lines))
            weights.append(_weigh(s, touched, surge))
            follows.append(bool(_STRUCTURE.match(bare)))
        lines.append(bare.rstrip())
    for i, keep in zip(places, line_blocks(weights, follows, window, surge)):
        if not keep:
            lines[i] = None
            dropped += 1
    work = re.sub(r"\n{3,}", "\n\n", "\n".join(s for s in lines if s is not None)).strip("\n")
    return _restore(work, held), count, dropped


def clean_markup(df: DataFrame, id_col: str = "conv_id", text_col: str = "markdown", window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """(id, clean_text, n_html, n_wiki, n_latex, n_dropped), a row for each input row.

    One narrow pass: no shuffle, nothing collected. Rows of a redelivered key
    give equal rows; the caller dedupes what it keeps.
    """

    def fn(ids, texts):
        got = [clean_lines(t, window, surge) for t in texts]
        return {id_col: ids, "clean_text": [g[0] for g in got], **{f"n_{k}": [g[1][i] for g in got] for i, k in enumerate(KINDS)}, "n_dropped": [g[2] for g in got]}

    kind = df.schema[id_col].dataType.simpleString()
    return map_columns(df.select(id_col, text_col), fn, f"{id_col} {kind}, clean_text string, n_html int, n_wiki int, n_latex int, n_dropped int")


def residue_kinds(df: DataFrame, id_col: str = "conv_id", text_col: str = "markdown") -> DataFrame:
    """(id, kind): one row for each id and kind of markup the cleaner counted in its lines."""
    found = clean_markup(df, id_col, text_col).where("n_html + n_wiki + n_latex > 0")
    kinds = F.array(*[F.when(F.col(f"n_{k}") > 0, F.lit(k)) for k in KINDS])
    return found.select(id_col, F.explode(F.array_compact(kinds)).alias("kind")).distinct()
