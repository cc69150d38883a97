"""Masks as runs: (image_id, y, x0, x1), the stretches of true pixels of each line.

A mask of large areas has a few runs a line where it has hundreds of pixels, so set
operations, growth, counts and components cost by the outline and not by the area. The
runs of a line are disjoint, do not touch, and tell all of the mask; lines without a
true pixel have none. Set operations sweep a line's ends from left to right, which is
a window over the runs of one line of one image.

``images``: image_id, w, h; one row an image, for what depends on the frame.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from . import whole
from .windows import ellipse

LINE = ("image_id", "y")
_START = Window.unboundedPreceding


def of_mask(px: DataFrame, col: str) -> DataFrame:
    """Runs of the pixels (image_id, y, x) where ``col`` is true."""
    line = Window.partitionBy(*LINE).orderBy("x")
    on = px.where(F.col(col)).select(*LINE, "x", (F.col("x") - F.row_number().over(line)).alias("_g"))
    return on.groupBy(*LINE, "_g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_g")


def pixels(runs: DataFrame) -> DataFrame:
    """The true pixels: image_id, y, x, and whatever else a run has."""
    return runs.withColumn("x", F.explode(F.sequence("x0", "x1"))).drop("x0", "x1")


def merged(intervals: DataFrame) -> DataFrame:
    """Intervals (image_id, y, x0, x1) that may overlap or touch, as runs."""
    line = Window.partitionBy(*LINE).orderBy("x0", "x1")
    reach = F.max("x1").over(line.rowsBetween(_START, -1))
    first = F.coalesce(F.col("x0") > reach + 1, F.lit(True)).cast("int")
    out = intervals.select(*LINE, "x0", "x1", first.alias("_first"))
    out = out.select(*LINE, "x0", "x1", F.sum("_first").over(line.rowsBetween(_START, 0)).alias("_g"))
    return out.groupBy(*LINE, "_g").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_g")


def combined(keep: str, **masks: DataFrame) -> DataFrame:
    """Runs of the pixels that satisfy ``keep``, a condition on the masks' names that is false
    where all of them are: combined("a and not b", a=land, b=water)."""
    names, events = list(masks), None
    for name, runs in masks.items():
        step = [F.lit(0).alias(n) if n != name else F.col("_step").alias(n) for n in names]
        ends = F.explode(F.array(F.struct(F.col("x0").alias("at"), F.lit(1).alias("step")), F.struct((F.col("x1") + 1).alias("at"), F.lit(-1).alias("step")))).alias("_e")
        side = runs.select(*LINE, ends).select(*LINE, F.col("_e.at").alias("at"), F.col("_e.step").alias("_step")).select(*LINE, "at", *step)
        events = side if events is None else events.unionByName(side)
    met = events.groupBy(*LINE, "at").agg(*[F.sum(n).alias(n) for n in names])
    line = Window.partitionBy(*LINE).orderBy("at")
    inside = [(F.sum(n).over(line.rowsBetween(_START, 0)) > 0).alias(n) for n in names]
    parts = met.select(*LINE, F.col("at").alias("x0"), (F.lead("at").over(line) - 1).alias("x1"), *inside)
    return merged(parts.where(F.expr(keep) & F.col("x1").isNotNull()).select(*LINE, "x0", "x1"))


def union(*masks: DataFrame) -> DataFrame:
    out = masks[0].select(*LINE, "x0", "x1")
    for m in masks[1:]:
        out = out.unionByName(m.select(*LINE, "x0", "x1"))
    return merged(out)


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return combined("a and b", a=a, b=b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return combined("a and not b", a=a, b=b)


def frames(images: DataFrame) -> DataFrame:
    """The whole of every image, as runs."""
    return images.select("image_id", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y"), F.lit(0).alias("x0"), (F.col("w") - 1).alias("x1"))


def complement(runs: DataFrame, images: DataFrame) -> DataFrame:
    return combined("f and not a", f=frames(images), a=runs)


def grown(runs: DataFrame, images: DataFrame, k: int) -> DataFrame:
    """Dilation by an elliptical k x k kernel: each run, widened on each of the kernel's lines."""
    widths = ellipse(k)
    r = len(widths) // 2
    kernel = F.explode(F.array(*[F.struct(F.lit(d - r).alias("dy"), F.lit(n).alias("n")) for d, n in enumerate(widths)])).alias("_k")
    wide = runs.join(images.select("image_id", "w", "h"), "image_id").select("*", kernel)
    wide = wide.select("image_id", (F.col("y") + F.col("_k.dy")).alias("y"), F.greatest(F.col("x0") - F.col("_k.n"), F.lit(0)).alias("x0"), F.least(F.col("x1") + F.col("_k.n"), F.col("w") - 1).alias("x1"), "h")
    return merged(wide.where("y between 0 and h - 1"))


def shrunk(runs: DataFrame, images: DataFrame, k: int) -> DataFrame:
    """Erosion; what lies outside of the image counts as true."""
    return complement(grown(complement(runs, images), images, k), images)


def opened(runs: DataFrame, images: DataFrame, k: int) -> DataFrame:
    return grown(shrunk(runs, images, k), images, k)


def closed(runs: DataFrame, images: DataFrame, k: int) -> DataFrame:
    return shrunk(grown(runs, images, k), images, k)


def area(*more: Column) -> Column:
    """Pixels of a group of runs."""
    return F.sum(F.col("x1") - F.col("x0") + 1).cast("long")


def labelled(runs: DataFrame) -> DataFrame:
    """Adds the label of each run's 8-connected component: the place (line, pixel) of its first pixel."""

    def work(table: pa.Table) -> pa.Table:
        y, x0, x1 = (table.column(c).to_numpy().astype(np.int64) for c in ("y", "x0", "x1"))
        starts = whole.groups(table.column("image_id"))
        image = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        at = (image * (y.max() + 2) + y) * whole.LINE  # images are a line apart
        above = at - whole.LINE
        low = np.searchsorted(at + x1, above + x0 - 1)
        n = np.maximum(np.searchsorted(at + x0, above + x1 + 1, "right") - low, 0)
        own = np.repeat(np.arange(len(y)), n)
        root = whole._least(len(y), own, np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n))
        return table.set_column(table.schema.get_field_index("label"), "label", pa.array((y * whole.LINE + x0)[root]))

    out = runs.withColumn("label", F.lit(0).cast("long"))
    return whole.stream(out, ["y", "x0"], work, out.schema)


def stats(labelled_: DataFrame, *more: Column) -> DataFrame:
    """Area, bounding box and centroid of each component, and further aggregates of its runs."""
    n = (F.col("x1") - F.col("x0") + 1).cast("long")
    out = labelled_.groupBy("image_id", "label").agg(
        area().alias("area"), F.min("x0").alias("left"), F.min("y").alias("top"), (F.max("x1") - F.min("x0") + 1).alias("width"), (F.max("y") - F.min("y") + 1).alias("height"),
        F.sum((F.col("x0") + F.col("x1")) * n).alias("_sx"), F.sum(F.col("y") * n).alias("_sy"), *more,
    )
    return out.withColumn("cx", F.col("_sx") / (2.0 * F.col("area"))).withColumn("cy", F.col("_sy") / F.col("area").cast("double")).drop("_sx", "_sy")


# --- pixel tables, stored as runs ----------------------------------------------------


class Packing:
    """Sorted pixels of full rectangles -> a row for each stretch of a line on which all columns but
    ``each`` are equal; those become arrays. ``without``: columns that are not kept. ``peak``: a column whose
    greatest value in a stretch is kept as _top, with its first place as _at (x), and further columns whose values
    there are kept as _top and their name (where stages need no more, so that arrays need not be kept)."""

    def __init__(self, each: Sequence[str], without: Sequence[str] = (), peak: Sequence[str] = ()):
        self.each, self.peak, self.without = list(each), list(peak), ("image_id", "y", "x", *each, *without, *peak)

    def _peaks(self, table: pa.Table, bounds: np.ndarray) -> dict[str, pa.Array]:
        by, *more = self.peak
        values = pc.fill_null(table.column(by), -np.inf).to_numpy()
        top = np.maximum.reduceat(values, bounds[:-1])
        run = np.repeat(np.arange(len(top)), np.diff(bounds))
        hits = np.flatnonzero(values == top[run])
        first = hits[np.diff(run[hits], prepend=-1) > 0]
        none = top == -np.inf
        out = {"_top": pa.array(top, mask=none), "_at": pa.array(table.column("x").to_numpy()[first], mask=none)}
        return out | {f"_top{c}": table.column(c).take(pa.array(first, mask=none)).combine_chunks() for c in more}

    def table(self, table: pa.Table) -> pa.Table:
        same = [c for c in table.column_names if c not in self.without]

        def key(c: str) -> pa.ChunkedArray:
            a = table.column(c)
            return a if a.null_count == 0 else pa.chunked_array([pc.fill_null(a, -1).combine_chunks()])

        bounds = whole.groups(*(key(c) for c in ("image_id", "y", *same)))
        first = table.take(pa.array(bounds[:-1]))
        lists = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), table.column(c).combine_chunks()) for c in self.each]
        x = table.column("x").to_numpy()
        peaks = self._peaks(table, bounds) if self.peak else {}
        return pa.table([first.column("image_id"), first.column("y"), pa.array(x[bounds[:-1]]), pa.array(x[bounds[1:] - 1]), *[first.column(c) for c in same], *peaks.values(), *lists], ["image_id", "y", "x0", "x1", *same, *peaks, *self.each])

    def schema(self, px: StructType) -> StructType:
        same = [f for f in px.fields if f.name not in self.without]
        peaks = [StructField("_top", DoubleType()), StructField("_at", IntegerType()), *[StructField(f"_top{c}", px[c].dataType) for c in self.peak[1:]]] if self.peak else []
        return StructType([px["image_id"], px["y"], StructField("x0", IntegerType()), StructField("x1", IntegerType()), *same, *peaks, *[StructField(c, ArrayType(px[c].dataType)) for c in self.each]])


def packed(px: DataFrame, each: Sequence[str]) -> DataFrame:
    """A pixel table of full rectangles, packed."""
    p = Packing(each)
    return whole.stream(px, ["y", "x"], p.table, p.schema(px.schema))


def unpacked(rows: DataFrame, each: Sequence[str]) -> DataFrame:
    """The pixel table again. Arrays that are not asked for are not read."""
    same = [c for c in rows.columns if c not in (*each, "y", "x0", "x1", "image_id")]
    out = rows.select("image_id", "y", *same, *each, F.posexplode(F.sequence("x0", "x1")).alias("_at", "x"))
    return out.select("image_id", "y", "x", *same, *[F.get(c, F.col("_at")).alias(c) for c in each])
