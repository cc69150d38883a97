"""The whole analysis, from image files (or masks) to one report for each image."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import colour
from ..operators import report as reports
from ..operators import around, inference, runs, stages, whole
from ..sources import images, views
from ..store import cut, small_rows


@dataclass(frozen=True)
class Analysis:
    """The tables of an analysis, each keyed by image_id."""

    cfg: Config
    pixels: DataFrame
    band: DataFrame
    summary: DataFrame
    regions: DataFrame
    zones: DataFrame
    sensors: DataFrame
    segments: DataFrame
    isolated: DataFrame


def of_masks(px: DataFrame, cfg: Config = Config(), ordered: bool = False) -> Analysis:
    """Everything that follows from water and canopy (image_id, y, x, w, h, water, canopy and
    more). Masks, labels and distances are stored once; the tables read from there."""
    rows = stages.zoned_rows(px, cfg, ordered)
    regions = cut(stages.regions(rows, cfg), "regions")
    zones = stages.top_zones(stages.scored(regions, cfg), cfg)
    sensors = cut(stages.sensor_zones(zones, rows, cfg), "sensors")
    # dealt and sorted as runs, of which there are fewer than pixels
    masks = runs.unpacked(whole.in_order(rows.select("image_id", "y", "x0", "x1", "w", "h", "water", "canopy"), "y", "x0"), [])
    band = stages.band_rows(masks, cfg, True)
    segments = cut(stages.supply_segments(band, cfg), "segments")
    isolated = cut(stages.isolated_regions(masks, cfg, True), "isolated")
    summary = reports.summary(stages.coverage(rows), stages.band_totals(band), zones, sensors, segments, isolated, cfg)
    counted = regions.groupBy("image_id").agg(F.count("*").alias("regions"))
    summary = summary.join(counted, "image_id", "left").withColumn("regions", F.coalesce("regions", F.lit(0)))
    return Analysis(cfg, runs.unpacked(rows, stages.ZONED), runs.unpacked(band, stages.BAND), cut(summary, "summary"), regions, zones, sensors, segments, isolated)


def analysis_copy(px: DataFrame, ordered: bool = False) -> DataFrame:
    """Adds ab, ag, ar: the display copy (b, g, r) softened, its lightness equalised. For detection only. In order."""
    soft = whole.add(px, ordered=ordered, **{f"a{c}": around.blurred(c, 5) for c in "bgr"})
    light, a, b = colour.lab8(F.col("ab"), F.col("ag"), F.col("ar"))
    lab = soft.select(*px.columns, light.alias("_l"), a.alias("_a"), b.alias("_b"))
    even = whole.add(lab, ordered=True, without=["_l"], _even=whole.equalised("_l"))
    back = colour.from_lab8(F.col("_even"), F.col("_a"), F.col("_b"))
    return even.select(*px.columns, *[v.alias(n) for v, n in zip(back, ("ab", "ag", "ar"), strict=True)])


def of_pixels(px: DataFrame, cfg: Config = Config()) -> tuple[Analysis, DataFrame]:
    """The analysis of colour pixels (image_id, y, x, w, h, b, g, r), and the scene models."""
    seen, model = stages.detect_water(stages.stored(analysis_copy(px), "copy"), cfg)
    seen = stages.stored(seen.drop("ab", "ag", "ar", "evidence", "support"), "water")
    land = stages.stored(stages.canopy_mask(seen, cfg), "canopy")
    with small_rows(px.sparkSession):
        return of_masks(land, cfg), model


def analyse(spark: SparkSession, path: str, cfg: Config = Config(), drawn: tuple[str, ...] = (), manifest: DataFrame | None = None, detector: Callable[[], inference.Predict] | None = None) -> DataFrame:
    """(image_id, status, doc, and a base64 PNG column for each view that is asked for) of the
    image files under ``path``: the report of those that can be analysed, the error code of
    the others. Views that are not asked for are not drawn.

    detector: loads a model (see ``operators.inference``) whose objects the reports tell; where it
    fails they say so, and all else is as without. ``config.from_env`` reads switches and lists."""
    files = cut(images.decoded_images(spark, path, cfg, manifest), "decoded")
    sized = images.processed_size(files.where("status = 'OK'"), cfg)
    made, model = of_pixels(images.pixels(files, cfg), cfg)
    info = sized.select("image_id", F.struct(F.col("w").alias("original_width"), F.col("h").alias("original_height"), F.col("new_w").alias("processed_width"), F.col("new_h").alias("processed_height"), F.round("scale", 4).alias("scale")).alias("image_info"))
    summary = made.summary.join(model.select("image_id", "scene_model"), "image_id").join(info, "image_id")
    objects = (None, None)
    if detector is not None and cfg.detector_enabled:
        pictures = images.from_pixels(made.pixels.select(*stages.PIXEL, "w", "h", *"bgr"))
        objects = inference.object_context(cut(inference.predicted(pictures, detector, cfg), "predicted"), cfg)
    docs = reports.report(summary, made.zones, made.sensors, made.segments, made.isolated, cfg, *objects)
    out = files.select("image_id", "status").join(docs, "image_id", "left")
    for name in drawn:
        picture = images.pngs(views.DRAWN[name](made))
        out = out.join(picture.select("image_id", F.base64("png").alias(name)), "image_id", "left")
    return out
