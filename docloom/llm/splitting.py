"""Problem 2: oversized texts -> ordered pieces cut at natural boundaries.

Balanced targets: the least number of pieces gives equal-length targets; each
target is snapped to the strongest boundary near it (between blocks, then
lines, sentences, words, characters); where a piece would pass the limit, one
piece more is tried. Where all cuts can stand between blocks they do, in the
least number of such pieces; if snapping misses such cuts, the ones with the
shortest longest piece are searched and each set near its target. Every piece after the first starts with the last
``overlap`` characters of the piece before it, within the limit.

A block ends at an empty or blank line; a fenced code block is one block,
blank lines included. Defined results: null and texts within the limit give no
piece (they need no cut); repeated rows of a key give its pieces once; lengths
are code points as stored; a text without any boundary is cut at characters.
"""

from __future__ import annotations

import bisect
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.arrow import map_columns
from docloom.llm.fences import closers, lines_of

LIMIT, OVERLAP = 3000, 200
_SENTENCE = re.compile(r"[.!?。！？…][\"')\]»”]*\s+|[。！？]")
_WORD = re.compile(r"\s+")
_AFTER_SENTENCE = re.compile(r"(?:[.!?。！？…][\"')\]»”]*\s+|[。！？])\Z")


def blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) of each block, without the line end that closes it."""
    out, start, end, pos, fence = [], None, 0, 0, None
    lines = lines_of(text)
    close = closers(text, lines)
    for k, (a, b) in enumerate(lines):
        bare = text[a:b].rstrip("\r\n")
        if fence is None and not bare.strip():
            if start is not None:
                out.append((start, end))
                start = None
            continue
        if start is None:
            start = a
        end = a + len(bare)
        if fence is None:
            fence = close.get(k)
        elif k == fence:
            fence = None
    if start is not None:
        out.append((start, end))
    return out


def _snap(levels: list[list[int]], lo: int, hi: int, target: int) -> int:
    """The boundary in [lo, hi] of the strongest level that has one, nearest to the target."""
    for cuts in levels:
        i = bisect.bisect_left(cuts, lo)
        j = bisect.bisect_right(cuts, hi)
        if i < j:
            k = bisect.bisect_left(cuts, target, i, j)
            return min(cuts[max(i, k - 1) : min(j, k + 1)], key=lambda c: abs(c - target))
    return max(lo, min(hi, target))


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[int], list[tuple[int, int]]]:
    """Cut positions (0, c1, ..., len) and the blocks."""
    spans = blocks(text)
    n = len(text)
    if n <= limit:
        return [0, n], spans
    outside = [a for a, _ in spans[1:]]
    lines = [m.end() for m in re.finditer(r"\r\n|\r|\n", text)]
    levels = [outside, lines, [m.end() for m in _SENTENCE.finditer(text)], [m.end() for m in _WORD.finditer(text)]]
    room = limit - overlap
    starts, between = frozenset(outside), _greedy(outside, n, limit, room)
    if between:
        cuts = _balanced(levels, n, limit, room, len(between), starts) or _even(outside, n, limit, room, len(between))
        return [*cuts, n], spans
    count = 1 + -(-(n - limit) // room)
    while not (cuts := _balanced(levels, n, limit, room, count, None)):
        count += 1
    return [*cuts, n], spans


def _balanced(levels: list[list[int]], n: int, limit: int, room: int, count: int, only: frozenset[int] | None) -> list[int] | None:
    """Starts of ``count`` pieces of about equal length; None where a piece would
    pass the limit or, if ``only`` is given, a cut would stand elsewhere."""
    cuts = [0]
    for k in range(1, count):
        at, left = cuts[-1], count - k
        most = at + (room if k > 1 else limit)
        least = max(at + 1, n - left * room)  # what the pieces left can still hold
        if least > most:
            return None
        cuts.append(_snap(levels, least, min(most, n - 1), round(at + (n - at) / (left + 1))))
        if only is not None and cuts[-1] not in only:
            return None
    return cuts if n - cuts[-1] <= (room if len(cuts) > 1 else limit) else None


def _greedy(outside: list[int], n: int, limit: int, room: int) -> list[int] | None:
    """Starts of the fewest pieces that are all cut between blocks, or None."""
    cuts = [0]
    while n - cuts[-1] > (room if len(cuts) > 1 else limit):
        i = bisect.bisect_right(outside, cuts[-1] + (room if len(cuts) > 1 else limit)) - 1
        if i < 0 or outside[i] <= cuts[-1]:
            return None
        cuts.append(outside[i])
    return cuts


def _even(outside: list[int], n: int, limit: int, room: int, count: int) -> list[int]:
    """Starts of ``count`` pieces cut between blocks, where that is the least number:
    the longest piece as short as it can be, each cut nearest to its target."""
    low, high = -(-n // count), max(limit, room)
    while low < high:
        mid = (low + high) // 2
        got = _greedy(outside, n, min(limit, mid), min(room, mid))
        low, high = (low, mid) if got and len(got) <= count else (mid + 1, high)
    first, other = min(limit, low), min(room, low)
    earliest = [n]  # starts from which the pieces left still reach the end, from the last
    for _ in range(count - 1):
        earliest.append(outside[bisect.bisect_left(outside, earliest[-1] - other)])
    cuts = [0]
    for k in range(1, count):
        at = cuts[-1]
        target = round(at + (n - at) / (count - k + 1))
        cuts.append(_snap([outside], max(at + 1, earliest[count - k]), at + (other if k > 1 else first), target))
    return cuts


#: the boundaries a cut can stand at, strongest first
STRENGTHS = ("block", "line", "sentence", "word", "character")


def cut_places(text: str, cuts: list[int], spans: list[tuple[int, int]]) -> list[tuple[str, int]]:
    """Of each inner cut: the boundary it stands at and the length of the block it divides (0 between blocks)."""
    starts, out = [a for a, _ in spans], []
    for c in cuts[1:-1]:
        k = bisect.bisect_right(starts, c) - 1
        a, b = spans[k] if k >= 0 else (c, c)
        if not a < c < b:
            out.append(("block", 0))
            continue
        before = text[max(a, c - 40) : c]
        at = "line" if before[-1] in "\r\n" else "sentence" if _AFTER_SENTENCE.search(before) else "word" if before[-1].isspace() else "character"
        out.append((at, b - a))
    return out


def split_rows(df: DataFrame, id_col: str = "conv_id", text_col: str = "markdown", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id, piece_no, n_pieces, start, length, piece, cut_at, cut_block, cut_kind, longest_block).

    ``start`` is the place of the piece's first character in the text, its overlap
    included. ``cut_at`` is the boundary where the piece was cut off the one before
    (null for the first), ``cut_block`` the length of the block which that cut
    divides, 0 between blocks. ``cut_kind`` tells whether any cut of the text
    divides a block; ``longest_block`` is a measure of the text. Short texts are
    filtered in the JVM; only oversized ones reach Python, and redelivered keys are
    dropped before.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must lie in [0, limit)")

    def fn(ids, texts):
        out = {k: [] for k in (id_col, "piece_no", "n_pieces", "start", "length", "piece", "cut_at", "cut_block", "cut_kind", "longest_block")}
        for i, t in zip(ids, texts):
            cuts, spans = split_text(t, limit, overlap)
            longest = max((b - a for a, b in spans), default=0)
            places = [(None, 0), *cut_places(t, cuts, spans)]
            kind = "inside_block" if any(n for _, n in places) else "between_blocks"
            for k in range(len(cuts) - 1):
                a = max(0, cuts[k] - overlap) if k else 0
                for name, v in zip(out, (i, k, len(cuts) - 1, a, cuts[k + 1] - a, t[a : cuts[k + 1]], *places[k], kind, longest)):
                    out[name].append(v)
        return out

    kind = df.schema[id_col].dataType.simpleString()
    big = df.select(id_col, text_col).where(F.char_length(text_col) > limit).dropDuplicates([id_col])
    return map_columns(big, fn, f"{id_col} {kind}, piece_no int, n_pieces int, start int, length int, piece string, cut_at string, cut_block int, cut_kind string, longest_block int")


def oversized(df: DataFrame, id_col: str = "conv_id", text_col: str = "markdown", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id, cut_kind): one row for each oversized text, from the cuts made.

    ``inside_block`` if a cut divides a block that is alone longer than the limit.
    A shorter block may be divided too, where it does not fit behind the overlap
    (over limit - overlap); that is ``between_blocks`` here and ``inside_block`` in
    ``split_rows``.
    """
    cut = split_rows(df, id_col, text_col, limit, overlap).groupBy(id_col).agg(F.max("cut_block").alias("most"))
    return cut.select(id_col, F.when(F.col("most") > limit, "inside_block").otherwise("between_blocks").alias("cut_kind"))
