"""Problem 5: visually identical text -> one consistent form.

A transducer over grapheme clusters: rules for full-width forms, characters
without width, no-break spaces and look-alike letters are combined with the
decomposition of accented letters into one mapping of characters, and the
composition of letters and accents is a table of pairs; both are computed once,
checked for conflicts (one input, two outputs; outputs that would change again)
and compiled into one pattern. A text is rewritten in one left-to-right pass by
longest match: of a cluster each character is mapped, its accents are put in
order and composed from the pairs. Clusters outside the rules are untouched, and
a text without any rule character is returned without a pass.

Accents are composed within the Basic Multilingual Plane.

Defined results: null gives null, empty gives empty; the rewriting is
idempotent; case, other letters, accents and the number of blanks are kept.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.arrow import map_columns
from docloom.plans.session import materialise

# fixed values: Cyrillic and Greek letters shaped like Latin ones
LOOKALIKES = {
    # Cyrillic capitals
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Ӏ": "I",
    # Cyrillic small letters
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ү": "y",
    # Greek capitals
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Greek small letters
    "ο": "o", "ϲ": "c", "ϳ": "j", "ν": "v",
}
# fixed values: characters without width, and kinds of no-break space
WIDTHLESS = "­͏؜᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿"
NO_BREAK = "   "


def rules() -> dict[str, str]:
    """Single characters -> canonical text; full-width forms come from a rule."""
    wide = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {"\u3000": " ", "￠": "¢", "￡": "£", "￥": "¥"}
    return wide | LOOKALIKES | dict.fromkeys(WIDTHLESS, "") | dict.fromkeys(NO_BREAK, " ")


class Transducer:
    """The compiled mapping; raises on conflicting rules."""

    def __init__(self, pairs: list[tuple[str, str]]) -> None:
        table: dict[str, str] = {}
        for k, v in pairs:
            if table.setdefault(k, v) != v:
                raise ValueError(f"conflict: {k!r} gives {table[k]!r} and {v!r}")
        for k, v in table.items():
            if any(c in table for c in v):
                raise ValueError(f"not final: {k!r} gives {v!r}, which changes again")
        # the precomputed mapping: characters to rule output and bare letters, accents' order, pairs to composed letters
        self.full, self.order, self.pair = dict(table), {}, {}
        for c in map(chr, [*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x10000)]):
            if k := unicodedata.combining(c):
                self.order[c] = k
            kind = unicodedata.decomposition(c)
            if kind and kind[0] != "<":
                if c not in table:
                    self.full[c] = "".join(table.get(x, x) for x in unicodedata.normalize("NFD", c))
                two = [chr(int(x, 16)) for x in kind.split()]
                if len(two) == 2 and unicodedata.normalize("NFC", c) == c and self.pair.setdefault(tuple(two), c) != c:
                    raise ValueError(f"conflict: {two!r} gives {self.pair[tuple(two)]!r} and {c!r}")
        for v in self.full.values():
            if any(self.full.get(x, x) != x for x in v):
                raise ValueError(f"not final: {v!r} changes again")
        # a composed letter that takes part: its canonical form differs from itself, or its base is a rule's
        composed, marks = [], []  # beyond the BMP, Python tests classes one range after another
        for c in map(chr, [*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x10000)]):
            if unicodedata.combining(c):
                marks.append(c)
            kind = unicodedata.decomposition(c)
            if kind and kind[0] != "<" and c not in table and (any(x in table for x in unicodedata.normalize("NFD", c)) or unicodedata.normalize("NFC", c) != c):
                composed.append(c)
        self.widthless = "".join(k for k, v in table.items() if not v)
        mark = self._class(marks)
        rare = self._class([*table, *composed])
        w = self._class(list(self.widthless))
        jamo = "\u1100-\u11ff"
        self.sign = re.compile(f"[{rare}{mark}{jamo}]")  # any match holds one
        self.joining = re.compile(f"[{mark}{jamo}]")  # without one, every cluster is one character
        self.runs = re.compile(f"[{rare}]+")
        self.clusters = re.compile(f"[^{mark}{w}](?:[{w}]*[{mark}])+|[{mark}][{w}{mark}]*|[{rare}][{w}]*|[\u1100-\u115f\uac00-\ud7a3][{w}\u1160-\u11ff]+")
        self.cluster = lru_cache(maxsize=65536)(self._cluster)

    @staticmethod
    def _class(chars: list[str]) -> str:
        """A character class body with ranges."""
        codes, out = sorted(map(ord, chars)), []
        i = 0
        while i < len(codes):
            j = i
            while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
                j += 1
            out.append(re.escape(chr(codes[i])) + (f"-{re.escape(chr(codes[j]))}" if j > i else ""))
            i = j + 1
        return "".join(out)

    def _cluster(self, s: str) -> str:
        """Map, put accents in order, compose."""
        flat = [x for c in s for x in self.full.get(c, c)]
        i = 0
        while i < len(flat):
            j = i
            while j < len(flat) and flat[j] in self.order:
                j += 1
            flat[i:j] = sorted(flat[i:j], key=self.order.__getitem__)
            i = j + 1
        out: list[str] = []
        base, last = -1, 0
        for c in flat:
            k = self.order.get(c, 0)
            # an accent meets its letter unless one of the same or a higher order stands between
            if base >= 0 and (last < k or len(out) == base + 1):
                if got := self._joined(out[base], c):
                    out[base] = got
                    continue
            out.append(c)
            last = k
            if not k:
                base, last = len(out) - 1, 0
        return "".join(out)

    def _joined(self, a: str, b: str) -> str | None:
        """Two characters in one, by the table or, for Hangul, by its rule."""
        x, y = ord(a), ord(b)
        if 0x1100 <= x < 0x1113 and 0x1161 <= y < 0x1176:
            return chr(0xAC00 + ((x - 0x1100) * 21 + y - 0x1161) * 28)
        if 0xAC00 <= x < 0xD7A4 and (x - 0xAC00) % 28 == 0 and 0x11A7 < y < 0x11C3:
            return chr(x + y - 0x11A7)
        return self.pair.get((a, b))

    def __call__(self, text: str | None) -> str | None:
        if not text or text.isascii() or not self.sign.search(text):
            return text
        pattern = self.clusters if self.joining.search(text) else self.runs
        return pattern.sub(lambda m: self.cluster(m[0]), text)


@lru_cache(maxsize=1)
def transducer() -> Transducer:
    return Transducer(list(rules().items()))


def canonical(text: str | None) -> str | None:
    """The one form of a text."""
    return transducer()(text)


def canonical_text(df: DataFrame, id_col: str = "conv_id", columns: tuple[str, ...] = ("title", "markdown")) -> DataFrame:
    """(id, each column in its one form): a narrow pass, a row for each input row."""

    def fn(ids, *cols):
        return {id_col: ids, **{n: [canonical(t) for t in c] for n, c in zip(columns, cols)}}

    kind = df.schema[id_col].dataType.simpleString()
    return map_columns(df.select(id_col, *columns), fn, ", ".join([f"{id_col} {kind}", *(f"{c} string" for c in columns)]))


def lookalike_classes(df: DataFrame, id_col: str = "conv_id", columns: tuple[str, ...] = ("title", "markdown")) -> DataFrame:
    """(id, field_name, form, raw): 128-bit digests of the one form and of the
    characters themselves; only digests leave the pass. Null and empty values
    are no case; a redelivered row gives one row."""
    import hashlib

    def digest(t: str) -> bytes:
        return hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()

    def fn(ids, *cols):
        out = {id_col: [], "field_name": [], "form": [], "raw": []}
        for n, c in zip(columns, cols):
            for i, t in zip(ids, c):
                if t:
                    f = canonical(t)
                    d = digest(t)
                    for k, v in zip(out, (i, n, d if f == t else digest(f), d)):
                        out[k].append(v)
        return out

    kind = df.schema[id_col].dataType.simpleString()
    return map_columns(df.select(id_col, *columns), fn, f"{id_col} {kind}, field_name string, form binary, raw binary").distinct()


#: rows of one class that a task of the expansion takes; a class is hot beyond it and beyond this share of all rows
CLASS_ROWS, HOT_PART = 50_000, 100_000


def lookalike_pairs(df: DataFrame, id_col: str = "conv_id", columns: tuple[str, ...] = ("title", "markdown")) -> DataFrame:
    """Pairs of rows whose field looks the same but holds other characters.

    The texts are mapped once and written as digests. Rows with the same characters
    are one class; classes are joined, not rows: of each form with several
    classes their pairs. These are expanded to members, the smaller class first, so
    that its few rows meet the larger one. A hot class is split by a hash of the
    id: over ``CLASS_ROWS`` rows and over 1 / ``HOT_PART`` of all rows, so there are
    at most HOT_PART of them and their list can be broadcast.
    """
    rows = materialise(lookalike_classes(df, id_col, columns), "forms")
    key = ["field_name", "form"]
    classes = materialise(rows.groupBy(*key, "raw").agg(F.count("*").alias("n")), "form_classes")
    n = classes.agg(F.sum("n")).first()[0] or 0
    most = max(CLASS_ROWS, n // HOT_PART)
    parts = F.ceil(F.col("n") / most)
    several = classes.groupBy(*key).agg(F.count("*").alias("k")).where("k > 1").select(*key)
    mixed = classes.join(several, key, "left_semi")
    x, y = mixed.select(*key, F.col("raw").alias("ra"), F.col("n").alias("na")), mixed.select(*key, F.col("raw").alias("rb"), F.col("n").alias("nb"))
    # each pair of classes once, the smaller one as ra
    pairs = x.join(y, key).where("na < nb or (na = nb and ra < rb)").select("field_name", "ra", "rb", F.ceil(F.col("na") / most).alias("pa"), F.ceil(F.col("nb") / most).alias("pb"))
    hot = classes.where(F.col("n") > most).select(F.col("field_name").alias("f"), F.col("raw").alias("h"), parts.alias("parts"))
    salt = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(id_col), "parts"))
    members = rows.join(F.broadcast(hot), (F.col("field_name") == F.col("f")) & (F.col("raw") == F.col("h")), "left").select(id_col, "field_name", "raw", salt.cast("int").alias("salt"))
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c).cast("int") - 1)).alias("salt")
    a = pairs.select("field_name", F.col("ra").alias("raw"), "rb", "pb", each("pa")).join(members, ["field_name", "raw", "salt"])
    a = a.select("field_name", F.col("rb").alias("raw"), F.col(id_col).alias("a"), each("pb"))
    b = a.join(members.withColumnRenamed(id_col, "b"), ["field_name", "raw", "salt"]).where("a <> b")
    return b.select(F.least("a", "b").alias(f"{id_col}_a"), F.greatest("a", "b").alias(f"{id_col}_b"), "field_name").distinct()


def lookalike_report(df: DataFrame, id_col: str = "conv_id", columns: tuple[str, ...] = ("title", "markdown")) -> DataFrame:
    """Each form that occurs in several variants: how many variants and rows."""
    rows = lookalike_classes(df, id_col, columns).groupBy("field_name", "form", "raw").agg(F.count("*").alias("n"))
    return rows.groupBy("field_name", "form").agg(F.count("*").alias("n_variants"), F.sum("n").alias("n_rows")).where("n_variants > 1").select("field_name", F.lower(F.hex("form")).alias("form"), "n_variants", "n_rows")
