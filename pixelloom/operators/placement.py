"""Places of text labels: a greedy fold over candidate boxes, one label after the other.

A label is a text beside something that spans ``top`` to ``bottom`` at ``x``. Six places are tried,
above it and below it, centred, left and right; each is moved into the image, and the first
of least overlap with what is already there is taken. There is no font here: a character has
a fixed advance, which is what layout needs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Font:
    """Sizes in pixels: a character's advance, its height above the base line and what hangs below."""

    advance: int = 9
    height: int = 11
    below: int = 5


_BOX = "array<struct<x1:int,y1:int,x2:int,y2:int>>"
_PLACED = "array<struct<overlap:int,nth:int,text_x:int,text_y:int,x1:int,y1:int,x2:int,y2:int,n:int>>"


def text_box(x: Column, y: Column, width: Column, w: Column, h: Column, font: Font) -> tuple[Column, Column, list[Column]]:
    """Where a text that was meant for x, y (its base line's left end) stands inside of an image,
    and its ground: x1, y1, x2, y2."""
    # the left and upper limits win where a text does not fit
    tx = F.greatest(F.lit(2), F.least(x, w - width - 4)).cast("int")
    ty = F.greatest(F.lit(font.height + 4), F.least(y, h - 4)).cast("int")
    return tx, ty, [tx - 3, ty - font.height - 4, tx + width + 3, ty + font.below + 1]


def _overlap(a: Column, b: Column) -> Column:
    wide = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    high = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.when((wide > 0) & (high > 0), wide * high).otherwise(0)


def placed(labels: DataFrame, frames: DataFrame | None, taken: DataFrame, font: Font = Font(), below_first: bool = False, by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """``labels`` (``by``, n, text, x, top, bottom; placed in order of n, a few an image) with text_x,
    text_y, their ground x1, y1, x2, y2, and its overlap with what was there before.

    ``frames``: image_id, w, h; None if ``labels`` have w and h. ``taken``: ``by``, x1, y1, x2, y2: what labels should stay off."""
    numbers = F.struct(F.col("n").cast("int").alias("n"), F.col("x").cast("int").alias("x"), F.col("top").cast("int").alias("top"), F.col("bottom").cast("int").alias("bottom"), (F.length("text") * font.advance).alias("width"), F.struct(*[c for c in labels.columns if c not in by]).alias("row"))
    size = [F.first(c).alias(c) for c in ("w", "h")] if frames is None else []
    held = labels.groupBy(*by).agg(F.array_sort(F.collect_list(numbers)).alias("_labels"), *size)
    boxes = taken.groupBy(*by).agg(F.collect_list(F.struct(*[F.col(c).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")])).alias("_taken"))
    if frames is not None:
        held = held.join(frames.select("image_id", "w", "h"), "image_id")
    held = held.join(boxes, list(by), "left").withColumn("_taken", F.coalesce("_taken", F.array().cast(_BOX)))

    def place(done: Column, label: Column) -> Column:
        above, under = label["top"] - font.below - 6, label["bottom"] + font.height + 8
        lines = (under, above) if below_first else (above, under)
        # half of a width, rounded up, to the left
        asides = (-F.ceil(label["width"] / 2).cast("int"), -label["width"] - 8, F.lit(8))
        tried = []
        for nth, (y, dx) in enumerate((y, dx) for y in lines for dx in asides):
            tx, ty, ground = text_box(label["x"] + dx, y, label["width"], F.col("w"), F.col("h"), font)
            tried.append(F.struct(F.lit(nth).alias("nth"), tx.alias("text_x"), ty.alias("text_y"), *[v.cast("int").alias(c) for v, c in zip(ground, ("x1", "y1", "x2", "y2"), strict=True)]))

        def judged(t: Column) -> Column:
            total = lambda boxes, start: F.aggregate(boxes, start, lambda s, b: s + _overlap(t, b))
            cost = total(done, total(F.col("_taken"), F.lit(0)))
            return F.struct(cost.alias("overlap"), *[t[c].alias(c) for c in ("nth", "text_x", "text_y", "x1", "y1", "x2", "y2")], label["n"].alias("n"))

        return F.concat(done, F.array(F.array_min(F.transform(F.array(*tried), judged))).cast(_PLACED))

    held = held.withColumn("_placed", F.aggregate("_labels", F.array().cast(_PLACED), place))
    out = held.select(*by, F.explode(F.arrays_zip("_labels", "_placed")).alias("_p"))
    return out.select(*[c if c in by else F.col("_p._labels.row")[c].alias(c) for c in labels.columns], *[F.col("_p._placed")[c].alias(c) for c in ("text_x", "text_y", "x1", "y1", "x2", "y2", "overlap")])
