"""Boxes (struct x1, y1, x2, y2) and intervals (start, end) as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1: Column, y1: Column, x2: Column, y2: Column, low: float = 0.0, high: float = 1000.0) -> Column:
    """Corners put in order and clipped."""
    clip = lambda v: F.least(F.greatest(v.cast("double"), F.lit(low)), F.lit(high))
    return F.struct(clip(F.least(x1, x2)).alias("x1"), clip(F.least(y1, y2)).alias("y1"), clip(F.greatest(x1, x2)).alias("x2"), clip(F.greatest(y1, y2)).alias("y2"))


def area(b: Column) -> Column:
    return F.greatest(b["x2"] - b["x1"], F.lit(0.0)) * F.greatest(b["y2"] - b["y1"], F.lit(0.0))


def _common(a: Column, b: Column) -> Column:
    w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0))
    return w * F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where both are empty."""
    common = _common(a, b)
    return F.coalesce(F.try_divide(common, area(a) + area(b) - common), F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(_common(a, b), F.least(area(a), area(b))), F.lit(0.0))


def far_corner(b: Column, side: float = 1000.0) -> Column:
    """The box of the same size in the corner that overlaps it least (ties: first of the four)."""
    w, h = b["x2"] - b["x1"], b["y2"] - b["y1"]
    options = []
    for n, (right, down) in enumerate(((0, 0), (1, 0), (0, 1), (1, 1))):
        x, y = (F.lit(side) - w if right else F.lit(0.0)), (F.lit(side) - h if down else F.lit(0.0))
        c = F.struct(x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"))
        options.append(F.struct(iou(b, c).alias("iou"), F.lit(n).alias("n"), c.alias("box")))
    return F.array_min(F.array(*options))["box"]


def to_thousand(value: Column, size: Column) -> Column:
    """Pixels to 0..1000, half to even at three places."""
    return F.bround(F.least(F.greatest(value * 1000.0 / size, F.lit(0.0)), F.lit(1000.0)), 3)


def whole_box(b: Column, width: Column, height: Column) -> Column:
    """A pixel box rounded and clipped to the picture, then to whole 0..1000 (half to even); null where it is empty, lacks a corner or the picture has no size."""
    pixel = lambda v, size: F.greatest(F.lit(0.0), F.least(size.cast("double"), F.bround(v.cast("double"), 0)))
    x1, y1, x2, y2 = pixel(b["x1"], width), pixel(b["y1"], height), pixel(b["x2"], width), pixel(b["y2"], height)
    scaled = lambda v, size: F.bround(F.try_divide(v, size) * 1000.0, 0).cast("int")
    out = F.struct(scaled(x1, width).alias("x1"), scaled(y1, height).alias("y1"), scaled(x2, width).alias("x2"), scaled(y2, height).alias("y2"))
    whole = b["x1"].isNotNull() & b["y1"].isNotNull() & b["x2"].isNotNull() & b["y2"].isNotNull()
    return F.when(whole & (width > 0) & (height > 0) & (x2 > x1) & (y2 > y1), out)


def overlap_seconds(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return F.greatest(F.least(a2, b2) - F.greatest(a1, b1), F.lit(0.0))
