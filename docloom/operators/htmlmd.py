"""HTML to Markdown by a tree walk inside one Arrow pass.

Headings, paragraphs, lists (numbered where ordered), tables, links, images,
emphasis, code, quotes, rules and breaks; formulas between dollar signs are
kept as they stand. ``literal`` reproduces documented quirks: ATX headings
only, bullets for every list, a table separator only under a row that looks
like a header. Null gives null; broken HTML never fails, open tags close where
HTML says so. Elements may be nested to any depth: the writer's steps are
generators that yield the step they wait for, and ``_run`` keeps them on a stack.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Generator
from dataclasses import dataclass
from html.parser import HTMLParser

from pyspark.sql import DataFrame

from docloom.functions.arrow import map_columns
from docloom.functions.textrules import HEADER_WORDS

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SKIP = frozenset("script style head title noscript template".split())
# fixed values: which open elements an opening tag closes
_CLOSES = {"li": ("li", ("ul", "ol")), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "tr": ("tr td th", ("table",)), "p": ("p", ("td", "th", "li", "div", "blockquote", "body")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "option": ("option", ("select",))}
_P_ENDERS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
_BLOCKS = _P_ENDERS | {"body", "html", "dt", "dd", "figure", "figcaption", "caption"}
_HEADER = re.compile(rf"\*\*.*\*\*|(?<![0-9A-Za-z_])(?:{HEADER_WORDS})(?![0-9A-Za-z_])", re.I | re.A)
_ESCAPE = re.compile(r"([\\`*_\[\]])|^(\s*)([-+>#=~]|\d+\.)(?=\s)", re.M)
_MATH = re.compile(r"\$\$.+?\$\$|\$(?=\S)[^$\n]+?(?<=\S)\$(?!\d)", re.S)


@dataclass(frozen=True)
class Options:
    preserve_tables: bool = True
    heading_style: str = "atx"
    compat: str = "default"


class _Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict | None = None) -> None:
        self.tag, self.attrs, self.kids = tag, attrs or {}, []


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("#root")
        self.open = [self.root]
        self.n_open: Counter = Counter()  # a tag that is not open is not looked for

    def _cut(self, i: int) -> None:
        for n in self.open[i:]:
            self.n_open[n.tag] -= 1
        del self.open[i:]

    def _close(self, names: tuple[str, ...], limits: tuple[str, ...]) -> None:
        if not any(self.n_open[n] for n in names):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in limits:
                return
            if self.open[i].tag in names:
                return self._cut(i)

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in _P_ENDERS:
            self._close(("p",), ("td", "th", "li", "div", "blockquote"))
        if tag in _CLOSES:
            names, limits = _CLOSES[tag]
            for n in reversed(names.split()):
                self._close((n,), limits)
        node = _Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].kids.append(node)
        if tag not in _VOID:
            self.open.append(node)
            self.n_open[tag] += 1

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and self.open[-1].tag == tag:
            self._cut(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if not self.n_open[tag]:
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                return self._cut(i)

    def handle_data(self, data: str) -> None:
        self.open[-1].kids.append(data)


def _escape(text: str) -> str:
    """Markdown's own marks are escaped outside formulas."""
    out, pos = [], 0
    fix = lambda s: _ESCAPE.sub(lambda m: "\\" + m[1] if m[1] else f"{m[2]}{m[3][:-1]}\\{m[3][-1]}", s)
    for m in _MATH.finditer(text):
        out += [fix(text[pos : m.start()]), m[0]]
        pos = m.end()
    return "".join(out) + fix(text[pos:])


def link(text: str, href: str | None, title: str | None) -> str:
    if not href or href.startswith(("javascript:", "vbscript:")):
        return text
    mark = ' "' + title.replace('"', '\\"') + '"' if title else ""
    safe = href.replace(" ", "%20")
    return f"<{safe}>" if text == href and not mark else f"[{text}]({safe}{mark})"


def image(alt: str | None, src: str | None, title: str | None) -> str:
    if not src:
        return ""
    if src.startswith("data:") and len(src) > 100:
        return f"![{alt or 'Image'}](data:{re.match(r'data:([^;,]*)', src)[1]}...)"
    if len(src) > 500:
        return f"![{alt or 'Image'}]"
    mark = ' "' + title.replace('"', '\\"') + '"' if title else ""
    return f"![{alt or ''}]({src}{mark})"


def _cell(s: str) -> str:
    return s.strip().replace("|", "\\|").replace("\n", " ")


def _run(step: Generator):
    """The result of a step; the steps it waits for are kept on a stack."""
    stack, value = [step], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value


class _Writer:
    def __init__(self, o: Options) -> None:
        self.o, self.literal = o, o.compat == "literal"

    def inner(self, n: _Node, parent: str = "") -> Generator:
        out = ""
        for k in n.kids:
            s = self.text(k, n) if isinstance(k, str) else (yield self.node(k, n))
            if out.endswith("\n"):
                s = s.lstrip(" ") if isinstance(k, str) else s.lstrip("\n") if out.endswith("\n\n") else s
            elif not out and isinstance(k, str) and n.tag in _BLOCKS | {"#root", "li", "td", "th"}:
                s = s.lstrip(" ")
            out += s
        return out

    def text(self, s: str, parent: _Node) -> str:
        if parent.tag in ("pre", "code"):
            return s
        s = re.sub(r"[ \t\r\n]+", " ", s)
        if s == " " and parent.tag in ("ul", "ol", "table", "tr", "tbody", "thead", "tfoot"):
            return ""
        return _escape(s)

    def raw(self, n: _Node) -> str:
        out, todo = [], [n]
        while todo:
            k = todo.pop()
            if isinstance(k, str):
                out.append(k)
            elif k is not n and k.tag == "br":
                out.append("\n")
            else:
                todo.extend(reversed(k.kids))
        return "".join(out)

    def node(self, n: _Node, parent: _Node) -> Generator:
        t = n.tag
        if t in _SKIP:
            return ""
        if t == "br":
            return "  \n" if parent.tag in ("p", "li") else "\n"
        if t == "hr":
            return "\n\n---\n\n"
        if t == "img":
            return image(n.attrs.get("alt"), n.attrs.get("src"), n.attrs.get("title"))
        if t == "pre":
            code = next((k for k in n.kids if isinstance(k, _Node) and k.tag == "code"), n)
            lang = (code.attrs.get("class") or "").replace("language-", "", 1)
            body = self.raw(n).strip("\n")
            return f"\n\n```{lang}\n{body}\n```\n\n"
        if t == "table" and self.o.preserve_tables:
            return (yield self.table(n))
        if self.literal and t in ("h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "p", "b", "strong", "em", "i", "span"):
            whole = self.raw(n).strip()
            if re.fullmatch(r"\$\$[^$]+\$\$", whole):
                return f"\n\n{whole}\n\n"
            if re.fullmatch(r"\$[^$]+\$", whole):
                return whole
        if t in ("ul", "ol"):
            return (yield self.items(n, parent))
        s = yield self.inner(n)
        if t[0] == "h" and len(t) == 2 and t[1] in "123456":
            s = re.sub(r"\s*\n\s*", " ", s).strip()
            if not s:
                return ""
            if self.o.heading_style == "setext" and not self.literal and t in ("h1", "h2"):
                return f"\n\n{s}\n{('=' if t == 'h1' else '-') * len(s)}\n\n"
            return f"\n\n{'#' * int(t[1])} {s}\n\n"
        if t == "p":
            s = s.strip()
            return ("" if self.literal else "\n\n") + s + "\n\n" if s else ""
        if t in ("b", "strong", "i", "em"):
            m = "**" if t in ("b", "strong") else "*"
            core = s.strip()
            lead, tail = s[: len(s) - len(s.lstrip())], s[len(s.rstrip()) :] if core else ""
            return f"{lead}{m}{core}{m}{tail}" if core else s
        if t in ("code", "kbd", "samp", "tt"):
            raw = self.raw(n)
            fence = "`" * (1 + max((len(x) for x in re.findall(r"`+", raw)), default=0))
            pad = " " if raw.startswith("`") or raw.endswith("`") else ""
            return f"{fence}{pad}{raw}{pad}{fence}" if raw else ""
        if t == "a":
            return link(s.strip() or s, n.attrs.get("href"), n.attrs.get("title"))
        if t == "blockquote":
            s = s.strip()
            return "\n\n" + "\n".join("> " + x if x else ">" for x in s.split("\n")) + "\n\n" if s else ""
        if t in ("td", "th"):
            return s.strip() + " "
        if t in _BLOCKS or t == "tr":
            s = s.strip("\n")
            return f"\n\n{s}\n\n" if s.strip() else ""
        return s

    def items(self, n: _Node, parent: _Node) -> Generator:
        out, k = [], int(n.attrs["start"]) if re.fullmatch(r"\d{1,9}", n.attrs.get("start", "")) else 1
        for li in n.kids:
            if not isinstance(li, _Node):
                continue
            s = (yield self.inner(li) if li.tag == "li" else self.node(li, n)).strip()
            if not s:
                continue
            mark = f"{k}. " if n.tag == "ol" and not self.literal else "- "
            k += 1
            pad = "\n" + " " * (2 if mark == "- " else len(mark))
            out.append(mark + re.sub(r"\n{2,}", "\n\n", s).replace("\n", pad).replace(pad + "\n", "\n\n"))
        body = "\n".join(out)
        return ("\n" + body + "\n" if parent.tag == "li" else "\n\n" + body + "\n\n") if body else ""

    def rows(self, n: _Node) -> Generator:
        out = []
        for k in n.kids:
            if isinstance(k, str):
                continue
            if k.tag == "tr":
                cells = [c for c in k.kids if isinstance(c, _Node) and c.tag in ("td", "th")]
                texts = []
                for c in cells:
                    texts.append(_cell((yield self.inner(c))))
                out.append((texts, bool(cells) and all(c.tag == "th" for c in cells)))
            elif k.tag != "table":
                out += yield self.rows(k)
        return out

    def table(self, n: _Node) -> Generator:
        rows = [r for r in (yield self.rows(n)) if r[0]]
        if not rows:
            return ""
        if self.literal:
            lines = ["|" + "".join(f" {c} |" for c in r).lstrip(" ") if any(r) else "" for r, _ in rows]
            lines = [x for x in lines if x.strip()]
            if lines and _HEADER.search(lines[0]):
                lines.insert(1, "|" + " --- |" * (lines[0].count("|") - 1))
        else:
            width = max(len(r) for r, _ in rows)
            lines = ["|" + "".join(f" {c} |" for c in [*r, *[""] * (width - len(r))]) for r, _ in rows]
            lines.insert(1, "|" + " --- |" * width)
        return "\n\n" + "\n".join(lines) + "\n\n"


_PRE = re.compile(r"<(?:script|style)[^>]*>.*?</(?:script|style)>", re.S | re.I)
_HELD = re.compile(r"^```.*?^```", re.M | re.S)


def convert(html: str | None, o: Options = Options()) -> str | None:
    if html is None:
        return None
    h = _PRE.sub("", html)
    h = re.sub(r"</?w:[^>]*>", "", re.sub(r"\n\s*\n\s*\n", "\n\n", h))
    tree = _Tree()
    tree.feed(h)
    tree.close()
    md = _run(_Writer(o).inner(tree.root))
    if o.compat == "literal":
        md = re.sub(r"\n{4,}", "\n\n\n", md)
        md = re.sub(r"\n(#{1,6} .+)\n", r"\n\1\n\n", md)
        md = re.sub(r"\|\s*\|\s*\|", "| |", md)
    else:
        held: list[str] = []
        md = _HELD.sub(lambda m: held.append(m[0]) or f"\0{len(held) - 1}\0", md)
        md = re.sub(r"\n{3,}", "\n\n", md)
        md = re.sub(r"\0(\d+)\0", lambda m: held[int(m[1])], md)
    md = "\n".join(s if s.endswith("  ") else s.rstrip() for s in md.split("\n"))
    return md.strip("\n").rstrip() + "\n" if o.compat != "literal" else md.lstrip("\n").rstrip() + "\n"


def html_to_markdown(df: DataFrame, id_col: str, html_col: str, options: Options = Options()) -> DataFrame:
    """(id, markdown, error): a row for each input row; a failure fills ``error``."""

    def one(h):
        try:
            return convert(h, options), None
        except Exception as e:  # noqa: BLE001 - the row keeps its place
            return None, f"{type(e).__name__}: {e}"

    def fn(ids, htmls):
        got = [one(h) for h in htmls]
        return {id_col: ids, "markdown": [g[0] for g in got], "error": [g[1] for g in got]}

    kind = df.schema[id_col].dataType.simpleString()
    return map_columns(df.select(id_col, html_col), fn, f"{id_col} {kind}, markdown string, error string")
