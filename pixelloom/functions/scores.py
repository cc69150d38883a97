"""Scores and classes of regions, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def part(x: Column, full: Column | float) -> Column:
    return F.least(F.lit(1.0), x / full)


def percent(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(100.0))


def openness(clearance: Column, area: Column, perimeter: Column, w: Column, h: Column) -> Column:
    half = F.lit(0.5) * F.greatest(F.lit(1), F.least(w, h))
    compact = F.when(perimeter > 0, F.least(F.lit(1.0), 4 * math.pi * area / (perimeter * perimeter))).otherwise(F.lit(0.0))
    x = 0.5 * part(clearance, half) + 0.3 * compact + 0.2 * part(area, w * h)
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def area_score(area: Column, image_area: Column, full_share: float) -> Column:
    return 100.0 * part(area / image_area, F.lit(full_share))


def clearance_score(clearance: Column, full: float) -> Column:
    return 100.0 * part(clearance, F.lit(full))


def final_score(area: Column, clearance: Column, open_: Column) -> Column:
    return percent(0.4 * area + 0.4 * clearance + 0.2 * open_)


def isolation_score(contact: Column, separation: Column, share_of_largest: Column, full: float) -> Column:
    return percent(100.0 * (0.45 * contact + 0.35 * part(separation, F.lit(full)) + 0.20 * (1.0 - F.least(F.lit(1.0), share_of_largest))))


def drop_parts(clearance: Column, water: Column, distance: Column, radius: Column, water_full: float) -> tuple[Column, Column, Column]:
    """Clearance, distance to water and nearness to the centre, each 0 to 1."""
    r = F.greatest(F.lit(1), radius)
    return part(clearance, r), part(water, F.lit(water_full)), F.greatest(F.lit(0.0), 1.0 - distance / r)


def drop_score(clearance: Column, water: Column, near: Column) -> Column:
    return 100.0 * (0.4 * clearance + 0.3 * water + 0.3 * near)


def classify_zone(score: Column) -> Column:
    return F.when(score >= 80, "HIGH POTENTIAL").when(score >= 60, "MODERATE POTENTIAL").when(score >= 40, "LOW POTENTIAL").otherwise("NOT RECOMMENDED")


def classify_isolation(score: Column) -> Column:
    return F.when(score >= 80, "HIGH ISOLATION").when(score >= 50, "MODERATE ISOLATION").otherwise("LOW ISOLATION")
