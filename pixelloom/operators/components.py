"""8-connected components as rows: what is known of each, from pixels that carry its label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import whole


def labelled(px: DataFrame, col: str, name: str = "label") -> DataFrame:
    """``px`` with the label of the component of true ``col`` that each pixel is in."""
    return whole.add(px, **{name: whole.labels(col)})


def stats(labelled_: DataFrame, *more, name: str = "label") -> DataFrame:
    """Area, bounding box and centroid of each component, and further aggregates of its pixels."""
    out = labelled_.where(F.col(name).isNotNull()).groupBy("image_id", name).agg(
        F.count("*").alias("area"),
        F.min("x").alias("left"),
        F.min("y").alias("top"),
        (F.max("x") - F.min("x") + 1).alias("width"),
        (F.max("y") - F.min("y") + 1).alias("height"),
        F.sum("x").alias("_sx"),
        F.sum("y").alias("_sy"),
        *more,
    )
    centre = lambda c: (F.col(c) / F.col("area").cast("double"))
    return out.withColumn("cx", centre("_sx")).withColumn("cy", centre("_sy")).drop("_sx", "_sy")
