"""Rectangles as struct<left, top, right, bottom> (right and bottom exclusive), in Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sizes that cues have by default.
STICKER_AREA, STICKER_MARGIN, INSET_ZOOM, INSET_MOST, FALLBACK_SIDE, REFERENCE_EDGE = 0.04, 0.02, 2.0, 0.4, 0.6, 512


def rect(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return F.struct(left.cast("int").alias("left"), top.cast("int").alias("top"), right.cast("int").alias("right"), bottom.cast("int").alias("bottom"))


def clamp(r: Column, w: Column, h: Column) -> Column:
    """Within the frame, and of one pixel at least."""
    left, top = F.greatest(F.lit(0), F.least(r["left"], w - 1)), F.greatest(F.lit(0), F.least(r["top"], h - 1))
    return rect(left, top, F.greatest(left + 1, F.least(r["right"], w)), F.greatest(top + 1, F.least(r["bottom"], h)))


def area(r: Column) -> Column:
    return (r["right"] - r["left"]).cast("long") * (r["bottom"] - r["top"])


def area_share(r: Column, w: Column, h: Column) -> Column:
    return area(r) / F.greatest(F.lit(1), w * h)


def overlap(a: Column, b: Column) -> Column:
    """Pixels in both."""
    x = F.greatest(F.lit(0), F.least(a["right"], b["right"]) - F.greatest(a["left"], b["left"]))
    y = F.greatest(F.lit(0), F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"]))
    return x.cast("long") * y


def iou(a: Column, b: Column) -> Column:
    shared = overlap(a, b)
    return F.when(shared == 0, 0.0).otherwise(shared / (area(a) + area(b) - shared))


def centred(w: Column, h: Column, side: float = FALLBACK_SIDE) -> Column:
    bw, bh = F.bround(w * side).cast("int"), F.bround(h * side).cast("int")
    left, top = F.floor((w - bw) / 2), F.floor((h - bh) / 2)
    return clamp(rect(left, top, left + bw, top + bh), w, h)


def relative_px(w: Column, h: Column, reference: float) -> Column:
    """Pixels in proportion to the short edge, one at least."""
    return F.greatest(F.lit(1), F.bround(F.least(w, h) * reference / REFERENCE_EDGE).cast("int"))


def sticker_side(w: Column, h: Column, share: float = STICKER_AREA) -> Column:
    side = F.greatest(F.lit(8), F.floor(F.sqrt(w * h * share)).cast("int"))
    return F.least(side, F.floor(w / 2).cast("int"), F.floor(h / 2).cast("int"))


def sticker_slots(w: Column, h: Column, side: Column, margin: float = STICKER_MARGIN) -> Column:
    """The eight places of a square sticker: array<struct<name, box>>."""
    m = F.greatest(F.lit(1), F.floor(F.least(w, h) * margin).cast("int"))
    right, bottom = w - side - m, h - side - m
    mid_x, mid_y = F.floor((w - side) / 2).cast("int"), F.floor((h - side) / 2).cast("int")
    places = {"top-left": (m, m), "top-right": (right, m), "bottom-left": (m, bottom), "bottom-right": (right, bottom), "top-mid": (mid_x, m), "bottom-mid": (mid_x, bottom), "left-mid": (m, mid_y), "right-mid": (right, mid_y)}
    return F.array(*[F.struct(F.lit(k).alias("name"), rect(x, y, x + side, y + side).alias("box")) for k, (x, y) in places.items()])


def least_overlap(slots: Column, region: Column, n: int | None = None) -> Column:
    """(overlap, name) of the slot that meets the region least; of equal ones the first by name. Where all rows have ``n`` slots they are written out: compiled code is faster than a lambda."""
    met = lambda s: F.struct(overlap(s["box"], region).alias("overlap"), s["name"].alias("name"))
    return F.array_min(F.transform(slots, met)) if n is None else F.least(*[met(slots[i]) for i in range(n)])
