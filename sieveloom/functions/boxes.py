"""Bounding boxes as columns: text forms, conversion, clipping and placement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveloom.functions.parse import col, strip

_INT = "^[+-]?[0-9]{1,9}$"


def _parts(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda p: F.trim(p))


def _box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), w.cast("int").alias("w"), h.cast("int").alias("h"))


def parse_xywh(c: Column | str, positive: bool = False) -> Column:
    """``x,y,w,h`` of four integers as a struct, else null; positive: width and height must be above 0."""
    p = _parts(strip(c))
    ok = (F.size(p) == 4) & F.forall(p, lambda v: v.rlike(_INT))
    at = lambda i: F.try_element_at(p, F.lit(i)).try_cast("int")
    if positive:
        ok = ok & (at(3) > 0) & (at(4) > 0)
    return F.when(ok, _box(at(1), at(2), at(3), at(4)))


def parse_xywh_rounded(c: Column | str) -> Column:
    """``x,y,w,h`` of four numbers, rounded half to even; width and height must be above 0."""
    p = _parts(strip(c))
    at = lambda i: F.try_element_at(p, F.lit(i)).try_cast("double")
    r = [F.bround(at(i)) for i in range(1, 5)]
    ok = (F.size(p) == 4) & F.forall(p, lambda v: v.try_cast("double").isNotNull() & ~F.isnan(v.try_cast("double")))
    return F.when(ok & (r[2] > 0) & (r[3] > 0), _box(*r))


def parse_xyxy(c: Column | str) -> Column:
    """``(x1, y1, x2, y2)`` as the struct of origin and size, else null."""
    p = _parts(F.regexp_replace(strip(c), "^\\(|\\)$", ""))
    ok = (F.size(p) == 4) & F.forall(p, lambda v: v.rlike(_INT))
    at = lambda i: F.try_element_at(p, F.lit(i)).try_cast("int")
    return F.when(ok, _box(at(1), at(2), at(3) - at(1), at(4) - at(2)))


def xyxy_text(b: Column | str) -> Column:
    b = col(b)
    return F.when(b.isNotNull(), F.format_string("(%d, %d, %d, %d)", b["x"], b["y"], b["x"] + b["w"], b["y"] + b["h"]))


def centroid_text(b: Column | str) -> Column:
    b = col(b)
    half = lambda o, s: (o + s / F.lit(2.0)).cast("double").cast("string")
    return F.when(b.isNotNull(), F.concat(F.lit("("), half(b["x"], b["w"]), F.lit(", "), half(b["y"], b["h"]), F.lit(")")))


def key_text(b: Column | str) -> Column:
    """Normalised text of a box, empty when there is none."""
    b = col(b)
    return F.when(b.isNotNull(), F.concat_ws(",", *[b[p].cast("string") for p in "xywh"])).otherwise("")


def rebase(b: Column | str, ox: Column, oy: Column, cw: Column, ch: Column) -> Column:
    """The box relative to a crop at (ox, oy) of size (cw, ch), clipped to it; null when nothing is left."""
    b = col(b)
    x, y = b["x"] - ox, b["y"] - oy
    w, h = b["w"] + F.least(x, F.lit(0)), b["h"] + F.least(y, F.lit(0))
    x, y = F.greatest(x, F.lit(0)), F.greatest(y, F.lit(0))
    w, h = F.least(w, cw - x), F.least(h, ch - y)
    return F.when((w > 0) & (h > 0), _box(x, y, w, h))


def _unit(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def yolo(b: Column | str, width: Column, height: Column) -> Column:
    """Centre and size as shares of the image, clamped to the unit interval; null when there is no extent."""
    b = col(b)
    cx, cy = _unit((b["x"] + b["w"] / F.lit(2.0)) / width), _unit((b["y"] + b["h"] / F.lit(2.0)) / height)
    w, h = _unit(b["w"] / width), _unit(b["h"] / height)
    return F.when((width > 0) & (height > 0) & (w > 0) & (h > 0), F.struct(cx.alias("cx"), cy.alias("cy"), w.alias("w"), h.alias("h")))


def yolo_line(class_id: Column, y: Column) -> Column:
    return F.when(y.isNotNull(), F.format_string("%d %.6f %.6f %.6f %.6f", class_id, y["cx"], y["cy"], y["w"], y["h"]))


def edge_surface(b: Column | str, width: Column, height: Column, margin: float = 0.08, span: float = 0.8) -> Column:
    """span: covers most of a side; edge: near a border; else surface."""
    b = col(b)
    m = F.lit(margin) * F.least(width, height)
    near = (b["x"] <= m) | (b["y"] <= m) | (width - (b["x"] + b["w"]) <= m) | (height - (b["y"] + b["h"]) <= m)
    long = (b["w"] >= F.lit(span) * width) | (b["h"] >= F.lit(span) * height)
    return F.when((width <= 0) | (height <= 0), "surface").when(long, "span").when(near, "edge").otherwise("surface")


def scale_to_fit(cw: Column, ch: Column, bw: Column, bh: Column, margin: float = 0.95) -> Column:
    """1 when the crop fits the background, else the factor that makes it fit with a margin."""
    none = (cw <= 0) | (ch <= 0) | (bw <= 0) | (bh <= 0)
    fits = (cw <= bw) & (ch <= bh)
    return F.when(none | fits, F.lit(1.0)).otherwise(F.least(bw.cast("double") / cw, bh.cast("double") / ch) * F.lit(margin))


def effective_size(cw: Column, ch: Column, scale: Column) -> tuple[Column, Column]:
    shrunk = lambda c: F.greatest(F.lit(1), F.floor(c * scale).cast("int"))
    return F.when(scale >= 1, cw).otherwise(shrunk(cw)), F.when(scale >= 1, ch).otherwise(shrunk(ch))


def place(cw: Column, ch: Column, width: Column, height: Column, want_edge: Column, u: Column) -> Column:
    """Top left corner of a crop on a border (which one, u in [0, 1) decides) or near the middle; null if it doesn't fit."""
    fits = (cw > 0) & (ch > 0) & (cw <= width) & (ch <= height)
    xm, ym = width - cw, height - ch
    along = lambda m: F.least(m, F.floor(u * m).cast("int"))
    side = F.floor(u * 4).cast("int") % 4
    truncated = lambda c: F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("int")
    inner = lambda m: F.greatest(F.lit(0), F.least(m, F.floor(m / F.lit(2)).cast("int") + truncated((u - 0.5) * 0.4 * m)))
    x = F.when(want_edge, F.when(side == 0, 0).when(side == 2, xm).otherwise(along(xm))).otherwise(inner(xm))
    y = F.when(want_edge, F.when(side == 1, 0).when(side == 3, ym).otherwise(along(ym))).otherwise(inner(ym))
    return F.when(fits, F.struct(x.cast("int").alias("x"), y.cast("int").alias("y")))
