"""Neighbourhood operators of pixel tables (image_id, y, x, ...) as window frames.

Kernels run along rows, then along columns; all columns that one axis needs are
computed in one select, so an axis costs one sort. Every window is partitioned by
(image_id, y) or (image_id, x): partitions hold one line of one image.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("image_id", "y", "x")


def _along(axis: str) -> Window:
    other = "y" if axis == "x" else "x"
    return Window.partitionBy("image_id", other).orderBy(axis)


def mirrored(df: DataFrame, r: int) -> DataFrame:
    """``df`` with r more pixels at each edge: its neighbours mirrored, the edge itself not
    repeated. ``df`` has the image's w and h; those copies have x or y outside them."""

    def copies(at: str, size: str) -> Column:
        low = F.when((F.col(at) >= 1) & (F.col(at) <= r), -F.col(at))
        high = F.when((F.col(at) <= F.col(size) - 2) & (F.col(at) >= F.col(size) - 1 - r), 2 * (F.col(size) - 1) - F.col(at))
        return F.filter(F.array(F.col(at), low, high), lambda v: v.isNotNull())

    return df.withColumn("x", F.explode(copies("x", "w"))).withColumn("y", F.explode(copies("y", "h")))


def inside(df: DataFrame) -> DataFrame:
    return df.where("x between 0 and w - 1 and y between 0 and h - 1")


def box_sums(df: DataFrame, cols: Sequence[str], n: int, prefix: str = "sum_") -> DataFrame:
    """Sums of ``cols`` over n x n pixels, cut off at the edge."""
    r = n // 2
    for axis in ("x", "y"):
        w = _along(axis).rowsBetween(-r, r)
        df = df.select(*[c for c in df.columns if not c.startswith(prefix)], *[F.sum(c if axis == "x" else f"{prefix}{c}").over(w).alias(f"{prefix}{c}") for c in cols])
    return df


def box_mean(df: DataFrame, col: str, n: int, name: str) -> DataFrame:
    """Mean over n x n pixels with mirrored edges; ``df`` has w and h."""
    out = box_sums(mirrored(df, n // 2), [col], n, "_s_")
    return inside(out.withColumn(name, F.col(f"_s_{col}") / float(n * n)).drop(f"_s_{col}"))


def local_std(df: DataFrame, col: str, n: int, name: str) -> DataFrame:
    """Standard deviation over n x n pixels with mirrored edges."""
    out = box_sums(mirrored(df.withColumn("_sq", F.col(col) * F.col(col)), n // 2), [col, "_sq"], n, "_s_")
    m, m2 = F.col(f"_s_{col}") / float(n * n), F.col("_s__sq") / float(n * n)
    return inside(out.withColumn(name, F.sqrt(F.greatest(m2 - m * m, F.lit(0.0)))).drop("_sq", f"_s_{col}", "_s__sq"))


def gaussian(df: DataFrame, cols: Sequence[str], n: int) -> DataFrame:
    """Binomial blur of ``cols`` by n x n pixels, rounded to integers, mirrored edges."""
    kernel = [math.comb(n - 1, k) for k in range(n)]
    r = n // 2
    out = mirrored(df, r)
    for axis in ("x", "y"):
        w = _along(axis)
        blur = {c: sum(weight * F.lag(c, r - k).over(w) for k, weight in enumerate(kernel)) for c in cols}
        out = out.select(*[c for c in out.columns if c not in cols], *[e.alias(c) for c, e in blur.items()])
    whole = float(sum(kernel) ** 2)
    return inside(out).select(*[F.floor(F.col(c) / whole + 0.5).cast("int").alias(c) if c in cols else F.col(c) for c in df.columns])


def ellipse(k: int) -> list[int]:
    """Half-widths of the rows of an elliptical k x k kernel, from top to bottom."""
    r = k // 2
    return [round(math.sqrt(r * r - dy * dy)) for dy in range(-r, r + 1)] if r else [0]


def dilate(df: DataFrame, col: str, k: int, name: str | None = None) -> DataFrame:
    """``col`` (boolean) true wherever the kernel, centred there, meets a true pixel."""
    widths = ellipse(k)
    r = len(widths) // 2
    name = name or col
    x = {w: F.max(col).over(_along("x").rowsBetween(-w, w)).alias(f"_d{w}") for w in set(widths)}
    rows = df.select("*", *x.values())
    y = _along("y")
    hits = [F.coalesce(F.lag(f"_d{w}", -dy).over(y), F.lit(False)) for dy, w in zip(range(-r, r + 1), widths, strict=True)]
    hit = hits[0]
    for h in hits[1:]:
        hit = hit | h
    return rows.select(*[c for c in df.columns if c != name], hit.alias(name))


def erode(df: DataFrame, col: str, k: int, name: str | None = None) -> DataFrame:
    """``col`` true where all of the kernel inside the image is true."""
    name = name or col
    out = dilate(df.withColumn("_not", ~F.col(col)), "_not", k, "_not")
    return out.select(*[c for c in df.columns if c != name], (~F.col("_not")).alias(name))


def opened(df: DataFrame, col: str, k: int) -> DataFrame:
    return dilate(erode(df, col, k), col, k)


def closed(df: DataFrame, col: str, k: int) -> DataFrame:
    return erode(dilate(df, col, k), col, k)


def edges(df: DataFrame, col: str, low: int, high: int) -> DataFrame:
    """Canny edges of an integer column: adds edge_weak and edge_strong (after thinning).

    Gradients are Sobel's with |gx| + |gy| as magnitude; a pixel stays where it is
    no less than its two neighbours across the edge."""
    y, x = _along("y"), _along("x")
    at = lambda c, d, w: F.coalesce(F.lag(c, -d).over(w), F.col(c))
    s1 = df.select("*", at(col, -1, x).alias("_l"), at(col, 1, x).alias("_r"))
    s1 = s1.select("*", (F.col("_r") - F.col("_l")).alias("_dx"), (F.col("_l") + 2 * F.col(col) + F.col("_r")).alias("_sx"))
    s2 = s1.select(*df.columns, (at("_dx", -1, y) + 2 * F.col("_dx") + at("_dx", 1, y)).alias("_gx"), (at("_sx", 1, y) - at("_sx", -1, y)).alias("_gy"))
    s2 = s2.withColumn("_m", F.abs("_gx") + F.abs("_gy"))
    s3 = s2.select("*", F.coalesce(F.lag("_m", 1).over(y), F.lit(0)).alias("_up"), F.coalesce(F.lead("_m", 1).over(y), F.lit(0)).alias("_dn"))
    side = lambda c, d: F.coalesce(F.lag(c, -d).over(x), F.lit(0))
    s4 = s3.select("*", *[side(c, d).alias(f"{c}{'l' if d < 0 else 'r'}") for c in ("_m", "_up", "_dn") for d in (-1, 1)])
    ax, ay = F.abs("_gx"), F.abs("_gy")
    flat, steep = ay * 2.414213562373095 < ax, ay > ax * 2.414213562373095
    same_sign = (F.col("_gx") * F.col("_gy")) >= 0
    a = F.when(flat, F.col("_ml")).when(steep, F.col("_up")).when(same_sign, F.col("_upl")).otherwise(F.col("_upr"))
    b = F.when(flat, F.col("_mr")).when(steep, F.col("_dn")).when(same_sign, F.col("_dnr")).otherwise(F.col("_dnl"))
    peak = (F.col("_m") > a) & (F.col("_m") >= b)
    return s4.select(*df.columns, (peak & (F.col("_m") > low)).alias("edge_weak"), (peak & (F.col("_m") > high)).alias("edge_strong"))
