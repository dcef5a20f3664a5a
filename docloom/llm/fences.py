"""Fenced code blocks of a text, in one pass over its lines."""

from __future__ import annotations

import bisect
import re

_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|\Z)")
_FENCE = re.compile(r"[ \t]*(`{3,}|~{3,})([^\r\n]*)")


def lines_of(text: str) -> list[tuple[int, int]]:
    """(start, end) of each line, its line end included."""
    return [m.span() for m in _LINE.finditer(text) if m.end() > m.start()]


def closers(text: str, lines: list[tuple[int, int]]) -> dict[int, int]:
    """Line of each opening fence -> line of its closing fence; unclosed fences have none.

    The nearest later bare fence of the same sign that is long enough: found from
    the right with a stack in which a nearer and longer fence hides those behind it,
    so texts full of unclosed fences take n log n steps.
    """
    marks = []
    for k, (a, b) in enumerate(lines):
        m = _FENCE.match(text, a, b)
        if m:
            marks.append((k, m[1][0], len(m[1]), m[2].strip()))
    nearest: dict[int, int] = {}
    stacks: dict[str, tuple[list[int], list[int]]] = {"`": ([], []), "~": ([], [])}  # minus lengths (rising), places
    for i in range(len(marks) - 1, -1, -1):
        _, c, n, info = marks[i]
        short, at = stacks[c]
        if not (c == "`" and "`" in info):
            j = bisect.bisect_right(short, -n) - 1  # the nearest that is at least as long
            if j >= 0:
                nearest[i] = at[j]
        if not info:
            while short and short[-1] >= -n:
                short.pop()
                at.pop()
            short.append(-n)
            at.append(i)
    out, i = {}, 0
    while i < len(marks):
        if i in nearest:
            out[marks[i][0]] = marks[nearest[i]][0]
            i = nearest[i]
        i += 1
    return out
