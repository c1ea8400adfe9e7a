"""Geometry over columns: boxes x0, y0, x1, y1 and arrays of points."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Shares and reaches of the grouping rules.
CONTAIN, OVERLAP, GAP, RATIO, ABSORB = 0.70, 0.50, 1.50, 0.30, 0.50
SAME_SPAN, SAME_SIDE, SAME_WIDTH = 0.8, 0.7, 0.6
BLEED = 0.08


def let(value: Column, body) -> Column:
    """Bind a value once: a lambda variable is evaluated once, an inlined expression on every use."""
    return F.transform(F.array(value), body)[0]


def _c(side: str, name: str) -> Column:
    return F.col(f"{side}.{name}" if side else name)


def width(side: str = "") -> Column:
    return _c(side, "x1") - _c(side, "x0")


def height(side: str = "") -> Column:
    return _c(side, "y1") - _c(side, "y0")


def min_side(least) -> Column:
    return (width() >= least) & (height() >= least)


def edge_adjacent(page_width: Column) -> Column:
    margin = BLEED * width()
    return (F.col("x0") < margin) | (page_width - F.col("x1") < margin)


def overlap(a: str, b: str, axis: str) -> Column:
    """Signed overlap on an axis; negative is a gap."""
    return F.least(_c(a, f"{axis}1"), _c(b, f"{axis}1")) - F.greatest(_c(a, f"{axis}0"), _c(b, f"{axis}0"))


def contained(a: str, b: str) -> Column:
    """Share of the smaller box that lies in the other."""
    both = F.greatest(overlap(a, b, "x"), F.lit(0)) * F.greatest(overlap(a, b, "y"), F.lit(0))
    smaller = F.least(width(a) * height(a), width(b) * height(b))
    return F.when(smaller > 0, both / smaller).otherwise(0.0)


def neighbours(a: str, b: str, unit: Column, apart: Column | None = None) -> Column:
    """Whether two boxes are of one block: nested, or near enough side by side or stacked, at comparable glyph size."""
    ga, gb = F.least(width(a), height(a)), F.least(width(b), height(b))
    alike = F.least(ga, gb) >= RATIO * F.greatest(ga, gb)
    beside = (overlap(a, b, "y") >= OVERLAP * F.least(height(a), height(b))) & (-overlap(a, b, "x") <= GAP * unit)
    stacked = (overlap(a, b, "x") >= OVERLAP * F.least(width(a), width(b))) & (-overlap(a, b, "y") <= GAP * unit)
    near = alike & (beside | stacked)
    return (contained(a, b) >= CONTAIN) | (near if apart is None else ~apart & near)


def same_text(a: str, b: str) -> Column:
    """Whether two boxes are one line or column seen twice, on the reading axis of the longer box."""
    flat = F.greatest(width(a), width(b)) >= F.greatest(height(a), height(b))
    pick = lambda x, y: F.when(flat, x).otherwise(y)
    ox, oy = overlap(a, b, "x"), overlap(a, b, "y")
    span, sa, sb = pick(ox, oy), pick(width(a), height(a)), pick(width(b), height(b))
    side, ta, tb = pick(oy, ox), pick(height(a), width(a)), pick(height(b), width(b))
    return (ox > 0) & (oy > 0) & (span >= SAME_SPAN * F.greatest(sa, sb)) & (side >= SAME_SIDE * F.least(ta, tb)) & (F.least(ta, tb) >= SAME_WIDTH * F.greatest(ta, tb))


def bbox(points: Column) -> Column:
    """Box of an array of points (structs x, y)."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def point(x, y) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def corners(side: str = "") -> Column:
    """A box as the polygon of its corners, clockwise from the top left."""
    x0, y0, x1, y1 = (_c(side, n) for n in ("x0", "y0", "x1", "y1"))
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))


def ellipse(side: str = "", n: int = 64) -> Column:
    """n points of the ellipse inscribed in a box."""
    cx, cy = (_c(side, "x0") + _c(side, "x1")) / 2, (_c(side, "y0") + _c(side, "y1")) / 2
    angle = lambda i: i * (2 * 3.141592653589793 / n)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: point(cx + width(side) / 2 * F.cos(angle(i)), cy + height(side) / 2 * F.sin(angle(i))))


def ellipse_points(x0, y0, x1, y1, n: int = 64):
    """``ellipse`` of many boxes at once: the points' x and y, a row a box."""
    angle = np.arange(n) * (2 * 3.141592653589793 / n)
    at = lambda low, high, turn: ((low + high) / 2)[:, None] + ((high - low) / 2)[:, None] * turn
    return at(x0, x1, np.cos(angle)), at(y0, y1, np.sin(angle))


def _edges(points: Column) -> Column:
    """Edges of a polygon, the last back to the first."""
    turned = F.concat(F.slice(points, F.lit(2), F.size(points)), F.slice(points, 1, 1))
    return F.zip_with(points, turned, lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))


def tilt(points: Column) -> Column:
    """Degrees of the longest edge off the nearer axis; of equal edges the first."""
    longest = F.aggregate(
        _edges(points),
        F.struct(F.lit(-1.0).alias("len"), F.lit(0.0).alias("deg")),
        lambda s, e: F.when(F.hypot(e["bx"] - e["ax"], e["by"] - e["ay"]) > s["len"], F.struct(F.hypot(e["bx"] - e["ax"], e["by"] - e["ay"]).alias("len"), (F.abs(F.degrees(F.atan2(e["by"] - e["ay"], e["bx"] - e["ax"]))) % 90).alias("deg"))).otherwise(s),
        lambda s: s["deg"],
    )
    return F.least(longest, 90 - longest)


def widest_chord(points: Column, y: Column) -> Column:
    """The widest run inside a polygon at a height (even-odd, half-open edges, the leftmost of equals); null if there is none."""
    crossing = F.filter(_edges(points), lambda e: (e["ay"] != e["by"]) & (F.least(e["ay"], e["by"]) <= y) & (y < F.greatest(e["ay"], e["by"])))
    xs = F.array_sort(F.transform(crossing, lambda e: e["ax"] + (y - e["ay"]) * (e["bx"] - e["ax"]) / (e["by"] - e["ay"])))

    def widest(xs: Column) -> Column:
        runs = F.transform(xs, lambda x, i: F.struct((F.get(xs, i + 1) - x).alias("w"), (-x).alias("left"), x.alias("lo"), F.get(xs, i + 1).alias("hi"), i.alias("i")))
        best = F.array_max(F.filter(runs, lambda r: (r["i"] % 2 == 0) & r["hi"].isNotNull()))
        return let(best, lambda b: F.when(b.isNotNull(), F.struct(b["lo"].alias("lo"), b["hi"].alias("hi"))))

    return let(xs, widest)


def narrowest(points: Column, top: Column, bottom: Column, page_width: Column) -> Column:
    """What the widest chords from ``top`` to ``bottom`` have in common, on the page; null if there is none.

    Between the heights of corners sides are straight, so the chords at the ends and at the corners between them tell all.
    """
    ys = F.filter(F.transform(points, lambda p: p["y"]), lambda y: (y > top) & (y < bottom))
    page = F.struct(F.lit(0.0).alias("lo"), page_width.cast("double").alias("hi"))

    def met(held: Column, y: Column) -> Column:
        both = lambda c: F.when(c.isNotNull(), F.struct(F.greatest(held["lo"], c["lo"]).alias("lo"), F.least(held["hi"], c["hi"]).alias("hi")))
        return let(widest_chord(points, y), both)

    return let(F.aggregate(F.concat(F.array(top.cast("double"), bottom.cast("double")), ys), page, lambda held, y: F.when(held.isNotNull(), met(held, y))), lambda r: F.when(r["hi"] > r["lo"], r))


def inset(points: Column, d: Column) -> Column:
    """The polygon mapped from its box onto the box with every side ``d`` further in; as it is if the box has no room for that."""

    def mapped(b: Column) -> Column:
        axis = lambda v, low, high: low + d + (v - low) * (1 - 2 * d / (high - low))
        moved = F.transform(points, lambda p: point(axis(p["x"], b["x0"], b["x1"]), axis(p["y"], b["y0"], b["y1"])))
        return F.when((d > 0) & (F.least(b["x1"] - b["x0"], b["y1"] - b["y0"]) > 2 * d), moved).otherwise(points)

    return let(bbox(points), mapped)


def holds(points: Column, x: Column, y: Column) -> Column:
    """Even-odd test of a point in a polygon."""
    crossed = F.filter(_edges(points), lambda e: ((e["ay"] > y) != (e["by"] > y)) & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"]) + e["ax"]))
    return F.size(crossed) % 2 == 1


def to_page(x: Column, y: Column, sx: Column, sy: Column, w: Column, h: Column) -> Column:
    """Net to page pixels: scaled by axis, rounded half to even, clamped to the page."""
    at = lambda v, s, most: F.least(F.greatest(F.bround(v * s), F.lit(0)), most - 1).cast("int")
    return F.struct(at(x, sx, w).alias("x"), at(y, sy, h).alias("y"))
