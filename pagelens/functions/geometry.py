"""Boxes as columns: overlap, clamping, conversion, padding, rescaling.

A box is a struct with the doubles ``x1, y1, x2, y2`` (top-left origin, pixels).
Everything here is a built-in expression; null in any corner makes the result null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Num = Column | float | int


def _lit(x: Num) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def box(x1: Num, y1: Num, x2: Num, y2: Num) -> Column:
    return F.struct(*(_lit(v).alias(n) for v, n in ((x1, "x1"), (y1, "y1"), (x2, "x2"), (y2, "y2"))))


def from_array(c: Column) -> Column:
    """Box of an array of four numbers; null unless it has exactly four."""
    return F.when(F.size(c) == 4, box(*(c[i].cast("double") for i in range(4))))


def to_array(b: Column) -> Column:
    return F.when(b.isNotNull(), F.array(b["x1"], b["y1"], b["x2"], b["y2"]))


def width(b: Column) -> Column:
    return b["x2"] - b["x1"]


def height(b: Column) -> Column:
    return b["y2"] - b["y1"]


def area(b: Column) -> Column:
    """Area, 0 for inverted boxes."""
    return F.greatest(F.lit(0.0), width(b)) * F.greatest(F.lit(0.0), height(b))


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union as the score has it: 0 without overlap or without union."""
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when((inter > 0) & (union > 0), inter / union).when(inter.isNotNull(), 0.0)


def iou_floored(a: Column, b: Column) -> Column:
    """Intersection over union as inference has it: the union counts at least one pixel."""
    inter = intersection(a, b)
    return inter / F.greatest(F.lit(1.0), area(a) + area(b) - inter)


def _within(c: Column, high: Num) -> Column:
    return F.greatest(F.lit(0.0), F.least(_lit(high).cast("double"), c))


def _sorted_within(b: Column, w: Num, h: Num) -> tuple[Column, ...]:
    x, y = (_within(b["x1"], w), _within(b["x2"], w)), (_within(b["y1"], h), _within(b["y2"], h))
    return F.least(*x), F.least(*y), F.greatest(*x), F.greatest(*y)


def clamp(b: Column, w: Num, h: Num, min_side: float = 3, digits: int = 0) -> Column:
    """Box inside its page with inverted sides swapped; null if a side is under ``min_side``.

    Rounded half to even, to integers (``digits`` 0) or two decimals (2).
    """
    x1, y1, x2, y2 = _sorted_within(b, w, h)
    ok = (x2 - x1 >= min_side) & (y2 - y1 >= min_side)
    return F.when(ok, box(*(F.bround(v, digits).cast("double") for v in (x1, y1, x2, y2))))


def clamp_guess(b: Column, w: Num, h: Num) -> Column:
    """An inverted box is taken for x, y, width, height; a side is at least a pixel."""
    w, h = _lit(w).cast("double"), _lit(h).cast("double")
    wrong = (b["x2"] <= b["x1"]) | (b["y2"] <= b["y1"])
    far = lambda a, z: F.when(wrong, a + F.greatest(F.lit(0.0), z)).otherwise(z)
    x1, y1 = _within(b["x1"], w), _within(b["y1"], h)
    x2, y2 = _within(far(b["x1"], b["x2"]), w), _within(far(b["y1"], b["y2"]), h)
    wide = lambda a, z, most: F.when(z <= a, F.least(most, a + 1.0)).otherwise(z)
    return F.when(b.isNotNull(), box(x1, y1, wide(x1, x2, w), wide(y1, y2, h)))


def clamp_inner(b: Column, w: Num, h: Num) -> Column:
    """Corners up to the last pixel; null where a side is one pixel or less."""
    x1, y1, x2, y2 = _within(b["x1"], _lit(w) - 1), _within(b["y1"], _lit(h) - 1), _within(b["x2"], _lit(w) - 1), _within(b["y2"], _lit(h) - 1)
    return F.when((x2 - x1 > 1) & (y2 - y1 > 1), box(x1, y1, x2, y2))


def to_coco(b: Column) -> Column:
    """``x, y, w, h`` of a box."""
    return F.struct(b["x1"].alias("x"), b["y1"].alias("y"), width(b).alias("w"), height(b).alias("h"))


def from_coco(c: Column) -> Column:
    return box(c["x"], c["y"], c["x"] + c["w"], c["y"] + c["h"])


def clamp_coco(c: Column, w: Num, h: Num) -> Column:
    """Origin at most two pixels from the far edge; sides at least one pixel."""
    w, h = _lit(w).cast("double"), _lit(h).cast("double")
    x, y = _within(c["x"], w - 2.0), _within(c["y"], h - 2.0)
    side = lambda v, most: F.greatest(F.lit(1.0), F.least(v, most))
    return F.struct(x.alias("x"), y.alias("y"), side(c["w"], w - x).alias("w"), side(c["h"], h - y).alias("h"))


def to_yolo(b: Column, w: Num, h: Num) -> Column:
    """Centre and size as shares of the page; null where they leave it."""
    w, h = _lit(w), _lit(h)
    out = F.struct(
        ((b["x1"] + width(b) / 2) / w).alias("cx"), ((b["y1"] + height(b) / 2) / h).alias("cy"),
        (width(b) / w).alias("w"), (height(b) / h).alias("h"),
    )
    ok = out["cx"].between(0, 1) & out["cy"].between(0, 1) & (out["w"] > 0) & (out["w"] <= 1) & (out["h"] > 0) & (out["h"] <= 1)
    return F.when(ok, out)


def six_decimals(x: Column) -> Column:
    """Text of a number from 0 on with six decimals, rounded by its exact binary value.

    The formatter of the JVM rounds the shortest decimal form instead.  The product
    with a million is taken apart without error, which tells on which side of a tie it is.
    """
    million = 1e6
    product = x * million
    high = x * 134217729.0 - (x * 134217729.0 - x)
    error = (high * million - product) + (x - high) * million
    whole = F.floor(product)
    part = product - whole
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
    n = whole + up.cast("bigint")
    return F.concat(F.floor(n / million).cast("string"), F.lit("."), F.lpad((n % 1_000_000).cast("string"), 6, "0"))


def yolo_line(class_id: Column, y: Column) -> Column:
    """``class cx cy w h`` with six decimals; null where class or box is."""
    numbers = lambda b: F.transform(F.array(b["cx"], b["cy"], b["w"], b["h"]), six_decimals)
    line = lambda b: F.when(b.isNotNull(), F.concat(class_id.cast("string"), F.lit(" "), F.array_join(numbers(b), " ")))
    return F.element_at(F.transform(F.array(y), line), 1)  # a variable: the box is not written out again and again


def grid(b: Column, w: Num, h: Num, cells: int = 1000) -> Column:
    """Corners on an integer grid of the page, half to even."""
    at = lambda v, most: F.least(F.lit(cells), F.greatest(F.lit(0), F.bround(v / most * cells).cast("int")))
    return F.struct(at(b["x1"], _lit(w)).alias("x1"), at(b["y1"], _lit(h)).alias("y1"), at(b["x2"], _lit(w)).alias("x2"), at(b["y2"], _lit(h)).alias("y2"))


def pad_by_longest(b: Column, w: Num, h: Num, ratio: float) -> Column:
    """Every side moved by a share of the longer side, whole pixels, inside the page."""
    p = F.bround(F.greatest(width(b), height(b)) * ratio)
    return box(
        F.bround(F.greatest(F.lit(0.0), b["x1"] - p)), F.bround(F.greatest(F.lit(0.0), b["y1"] - p)),
        F.bround(F.least(_lit(w).cast("double"), b["x2"] + p)), F.bround(F.least(_lit(h).cast("double"), b["y2"] + p)),
    )


def pad_by_height(b: Column, fx: float, fy: float) -> Column:
    """Sides moved by shares of the height, which counts at least one pixel."""
    tall = F.greatest(F.lit(1.0), height(b))
    return box(b["x1"] - tall * fx, b["y1"] - tall * fy, b["x2"] + tall * fx, b["y2"] + tall * fy)


def pad_by_side(b: Column, w: Num, h: Num, ratio: float = 0.12, least: float = 12.0) -> Column:
    """Sides moved by a share of width and height, at least ``least`` pixels, inside the page."""
    px, py = F.greatest(F.lit(least), width(b) * ratio), F.greatest(F.lit(least), height(b) * ratio)
    return box(
        F.greatest(F.lit(0.0), b["x1"] - px), F.greatest(F.lit(0.0), b["y1"] - py),
        F.least(_lit(w).cast("double"), b["x2"] + px), F.least(_lit(h).cast("double"), b["y2"] + py),
    )


def shrink(w: Column, h: Column, most: int = 4000) -> Column:
    """``(scale, w, h)`` of a page whose longer side may have at most ``most`` pixels; sizes truncated."""
    scale = F.when(F.greatest(w, h) > most, F.lit(float(most)) / F.greatest(w, h)).otherwise(1.0)
    return F.struct(scale.alias("scale"), F.floor(w * scale).cast("int").alias("w"), F.floor(h * scale).cast("int").alias("h"))


def scaled(b: Column, scale: Column) -> Column:
    return box(*(b[c] * scale for c in ("x1", "y1", "x2", "y2")))


def budget(w: Column, h: Column, pixels: int) -> Column:
    """``(w, h)`` scaled to at most about ``pixels`` in all; at least one pixel a side."""
    s = F.sqrt(F.lit(float(pixels)) / F.greatest(F.lit(1), w * h))
    side = lambda v: F.when(w * h <= pixels, v).otherwise(F.greatest(F.lit(1), F.bround(v * s).cast("int"))).cast("int")
    return F.struct(side(w).alias("w"), side(h).alias("h"))


def area_ratio(b: Column, w: Column, h: Column) -> Column:
    """Share of the page a box covers; either counts at least one pixel."""
    return F.greatest(F.lit(1.0), width(b) * height(b)) / F.greatest(F.lit(1.0), (w * h).cast("double"))


def percent(v: Column, whole: Column) -> Column:
    """Position in per cent, four decimals; 0 on an empty page."""
    return F.when(whole > 0, F.round(v / whole * 100, 4)).otherwise(0.0)


def relative(b: Column, crop: Column) -> Column:
    """A box in the coordinates of a crop."""
    return box(b["x1"] - crop["x1"], b["y1"] - crop["y1"], b["x2"] - crop["x1"], b["y2"] - crop["y1"])
