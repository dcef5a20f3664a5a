"""Image plans: crop, resize and encoding steps as arithmetic columns, before any pixel is touched."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def resolution_limit(model: Column) -> Column:
    """Longest side in pixels; the area limit is its square (fixed values)."""
    m = F.lower(F.coalesce(model, F.lit("")))
    return F.when(m.contains("pixtral"), 1024).when(m.contains("mistral"), 1540).otherwise(2048)


def crop(w: Column, h: Column, pct: Column) -> Column:
    """struct(width, height, left, top, tag): a centre crop, null where none applies."""
    cw, ch = F.floor(w * pct / 100), F.floor(h * pct / 100)
    ok = (pct > 0) & (pct < 100) & (cw > 100) & (ch > 100)
    return F.when(ok, F.struct(cw.alias("width"), ch.alias("height"), F.floor((w - cw) / 2).alias("left"), F.floor((h - ch) / 2).alias("top"), F.concat(F.lit("crop-"), pct.cast("string"), F.lit("%")).alias("tag")))


def resize_direct(w: Column, h: Column, side: Column) -> Column:
    """struct(width, height, tag) within the area and side limits, null where it fits already."""
    area, ar = (side * side).cast("double"), w.cast("double") / h
    w1, h1 = F.sqrt(area * ar), F.sqrt(area / ar)
    w2, h2 = F.when(w1 > side, side.cast("double")).otherwise(w1), F.when(w1 > side, side / ar).otherwise(h1)
    h3, w3 = F.when(h2 > side, side.cast("double")).otherwise(h2), F.when(h2 > side, side * ar).otherwise(w2)
    over = (w.cast("bigint") * h > side * side) | (w > side) | (h > side)
    rw, rh = F.floor(w3 + 0.5).cast("int"), F.floor(h3 + 0.5).cast("int")
    return F.when(over, F.struct(rw.alias("width"), rh.alias("height"), F.concat(F.lit("resize-"), rw.cast("string"), F.lit("x"), rh.cast("string"), F.lit("-pixels")).alias("tag")))


def resize_worker(w: Column, h: Column) -> Column:
    rh = F.floor(h * 2048.0 / w + 0.5).cast("int")
    return F.when(w > 2048, F.struct(F.lit(2048).alias("width"), rh.alias("height"), F.concat(F.lit("resize-2048x"), rh.cast("string")).alias("tag")))


def plan_image(w: Column, h: Column, pct: Column, model: Column, contrast: Column, quality: Column, plan: str = "direct") -> Column:
    """struct(width, height, tags): what the steps leave of an image.

    The resize is computed from the size before the crop.
    """
    c = crop(w, h, pct)
    r = resize_direct(w, h, resolution_limit(model)) if plan == "direct" else resize_worker(w, h)
    tags = F.array(
        c["tag"],
        r["tag"],
        F.when(F.coalesce(contrast, F.lit(True)), F.lit("contrast")),
        F.lit("color-preserved" if plan == "worker" else None).cast("string"),
        F.concat(F.lit("jpeg-q"), F.coalesce(quality, F.lit(95)).cast("string")),
    )
    return F.struct(F.coalesce(r["width"], c["width"].cast("int"), w).alias("width"), F.coalesce(r["height"], c["height"].cast("int"), h).alias("height"), F.array_compact(tags).alias("tags"))


def png_size(content: Column) -> Column:
    """struct(width, height) from a PNG's header."""
    at = lambda i: F.conv(F.hex(F.substring(content, i, 4)), 16, 10).cast("int")
    return F.when(F.startswith(content, F.unhex(F.lit("89504E470D0A1A0A"))), F.struct(at(17).alias("width"), at(21).alias("height")))
