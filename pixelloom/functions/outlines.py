"""Measures of closed outlines: arrays of points (x, y) whose neighbours lie on one of eight directions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sides(points: Column) -> Column:
    """(x, y, u, v) of every side, the closing one included."""
    n = F.size(points)
    side = lambda i: F.struct(points[i]["x"].alias("x"), points[i]["y"].alias("y"), points[(i + 1) % n]["x"].alias("u"), points[(i + 1) % n]["y"].alias("v"))
    return F.transform(F.sequence(F.lit(0), n - 1), side)


def closed_length(points: Column) -> Column:
    """Straight and diagonal steps are counted apart, so that sums are exact."""
    across = lambda s: F.abs(s["u"] - s["x"])
    down = lambda s: F.abs(s["v"] - s["y"])
    total = lambda f: F.aggregate(_sides(points), F.lit(0), lambda acc, s: acc + f(s))
    diagonal = total(lambda s: F.least(across(s), down(s)))
    return total(lambda s: F.greatest(across(s), down(s)) - F.least(across(s), down(s))).cast("double") + F.sqrt(F.lit(2.0)) * diagonal


def enclosed_area(points: Column) -> Column:
    """Area of the polygon through the points, by the shoelace formula."""
    twice = F.aggregate(_sides(points), F.lit(0), lambda acc, s: acc + s["x"] * s["v"] - s["u"] * s["y"])
    return F.abs(twice) / F.lit(2.0)
