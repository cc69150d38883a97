"""Drawings as pixel expressions: pixel tables in, pixel tables with other b, g, r out.

Text is not drawn (``annotations`` has it as rows); shapes are predicates on x and y
over the few zones, regions or boxes of an image, collected in one array each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import placement, whole, windows
from .images import dimmed, tint

# fixed values: colours as B, G, R
WATER, SENSOR, SUPPLY, MARGIN = (200, 90, 20), (247, 85, 168), (94, 197, 34), (150, 255, 170)
CANOPY, ISOLATED, TEXT, OUTLINE, REGION = (60, 60, 60), (0, 140, 255), (255, 255, 255), (18, 18, 18), (170, 170, 170)
CLASS_COLOURS = {
    "person": (60, 200, 60), "car": (0, 140, 255), "truck": (0, 0, 255), "bus": (0, 210, 210), "boat": (255, 120, 0),
    "motorcycle": (220, 220, 0), "bicycle": (200, 0, 220),
}


def paint(px: DataFrame, where: Column, bgr: tuple[int, int, int]) -> DataFrame:
    return px.withColumns({c: F.when(where, F.lit(v)).otherwise(F.col(c)).cast("short") for c, v in zip("bgr", bgr, strict=True)})


def line_layer(px: DataFrame, col: str, name: str, dash: int = 0) -> DataFrame:
    """Adds ``name``: pixels of ``col`` that a 3 x 3 erosion removes, less those within two of the
    image's frame. With ``dash``, only those on the even squares of a grid of that width."""
    inner = windows.erode(px, col, 3, "_inner")
    edge = F.col(col) & ~F.col("_inner") & F.col("x").between(2, F.col("w") - 3) & F.col("y").between(2, F.col("h") - 3)
    if dash:
        edge = edge & ((F.floor(F.col("x") / dash) + F.floor(F.col("y") / dash)) % 2 == 0)
    return inner.withColumn(name, edge).drop("_inner")


def stroke(px: DataFrame, layer: str, bgr: tuple[int, int, int]) -> DataFrame:
    """The layer in its colour, with a dark halo of one pixel."""
    out = windows.box_sums(px.withColumn("_on", F.col(layer).cast("int")), ["_on"], 3, "_halo_")
    return paint(paint(out, F.col("_halo__on") > 0, OUTLINE), F.col(layer), bgr).drop("_on", "_halo__on")


def _within(px: DataFrame, shapes: DataFrame, fields: list[str], inside: Callable[[Column], Column], name: str) -> DataFrame:
    """Adds ``name``: whether a pixel is inside of any shape; an image has a few."""
    held = shapes.groupBy("image_id").agg(F.collect_list(F.struct(*fields)).alias("_shapes"))
    out = px.join(held, "image_id", "left")
    return out.withColumn(name, F.coalesce(F.exists("_shapes", inside), F.lit(False))).drop("_shapes")


def circles(px: DataFrame, sensors: DataFrame, alpha: float = 0.3) -> DataFrame:
    """Viable circles: filled, with a ring in a darker halo."""
    viable = sensors.where("not_viable is null")
    away = lambda z: F.sqrt(((F.col("x") - z["cx"]) * (F.col("x") - z["cx"]) + (F.col("y") - z["cy"]) * (F.col("y") - z["cy"])).cast("double"))
    out = tint(_within(px, viable, ["cx", "cy", "radius"], lambda z: away(z) <= z["radius"], "_in"), "_in", SENSOR, alpha)
    for width, bgr in ((2.0, OUTLINE), (1.0, SENSOR)):
        out = _within(out, viable, ["cx", "cy", "radius"], lambda z: F.abs(away(z) - z["radius"]) <= width, "_ring")  # noqa: B023
        out = paint(out, F.col("_ring"), bgr).drop("_ring")
    return out.drop("_in")


def rectangles(px: DataFrame, boxes: DataFrame, bgr: tuple[int, int, int]) -> DataFrame:
    """Frames, two pixels wide, of boxes (image_id, x1, y1, x2, y2)."""
    x, y = F.col("x"), F.col("y")

    def frame(b: Column) -> Column:
        inside = x.between(b["x1"] - 1, b["x2"]) & y.between(b["y1"] - 1, b["y2"])
        return inside & ~(x.between(b["x1"] + 1, b["x2"] - 2) & y.between(b["y1"] + 1, b["y2"] - 2))

    out = _within(px, boxes, ["x1", "y1", "x2", "y2"], frame, "_frame")
    return paint(out, F.col("_frame"), bgr).drop("_frame")


def detection_view(px: DataFrame, found: DataFrame) -> DataFrame:
    """The untouched scene with the boxes of ``found`` (image_id, label, x1 .. y2) in their classes' colours."""
    for label, bgr in CLASS_COLOURS.items():
        px = rectangles(px, found.where(F.col("label") == label), bgr)
    return px


def water_view(made) -> DataFrame:
    """Water over the dimmed scene, its outer outline in white."""
    px = dimmed(made.pixels)
    px = whole.add(tint(px, "water", WATER, 0.75), _solid=whole.filled("water", 1 << 20)).repartition("image_id")
    px = windows.erode(px, "_solid", 3, "_inner")
    return paint(px, F.col("_solid") & ~F.col("_inner"), TEXT)


def supply_layer(px: DataFrame, made, alpha: float) -> DataFrame:
    """The band, and its margins where they border it: the inner solid, the outer dashed."""
    band = made.band.select("image_id", "y", "x", "band", F.col("_wd").alias("_margin"))
    px = tint(px.join(band, ["image_id", "y", "x"]), "band", SUPPLY, alpha)
    px = windows.dilate(px, "band", 9, "_near")
    px = px.withColumn("_outer", F.col("water") | (F.col("_margin") <= made.cfg.supply_outer)).withColumn("_inner_", F.col("water") | (F.col("_margin") <= made.cfg.supply_inner))
    for mask, dash in (("_outer", 6), ("_inner_", 0)):
        px = line_layer(px, mask, "_line", dash).withColumn("_line", F.col("_line") & F.col("_near"))
        px = stroke(px, "_line", MARGIN).drop("_line")
    return px


def supply_view(made) -> DataFrame:
    shore = made.band.select("image_id", "y", "x", (F.col("shoreline") & F.col("canopy")).alias("_trees"))
    px = tint(made.pixels, "water", WATER, 0.35).join(shore, ["image_id", "y", "x"])
    return supply_layer(tint(px, "_trees", CANOPY, 0.45), made, 0.50)


def sensor_view(made) -> DataFrame:
    """Outlines of the ranked zones' components and the circles."""
    ranked = made.zones.select("image_id", "label", F.lit(True).alias("_ranked"))
    px = tint(made.pixels, "water", WATER, 0.35).join(ranked, ["image_id", "label"], "left")
    px = px.withColumn("_zone", F.coalesce("_ranked", F.lit(False)))
    px = stroke(line_layer(px.repartition("image_id"), "_zone", "_line"), "_line", REGION)
    return circles(px, made.sensors)


def final_view(made) -> DataFrame:
    return circles(supply_layer(tint(made.pixels, "water", WATER, 0.40), made, 0.42), made.sensors)


def isolated_view(made) -> DataFrame:
    boxes = made.isolated.select("image_id", F.col("left").alias("x1"), F.col("top").alias("y1"), (F.col("left") + F.col("width")).alias("x2"), (F.col("top") + F.col("height")).alias("y2"))
    return rectangles(tint(made.pixels, "water", WATER, 0.35), boxes, ISOLATED)


def candidate_view(made) -> DataFrame:
    return tint(tint(dimmed(made.pixels), "buffer", MARGIN, 0.25), "candidate", REGION, 0.6)


DRAWN = {"original": lambda made: made.pixels, "water_mask": water_view, "candidate_mask": candidate_view, "sensor_zones": sensor_view, "supply_zones": supply_view, "final_analysis": final_view, "isolated_regions": isolated_view}


def annotations(made) -> DataFrame:
    """(image_id, view, text, x, y, text_x, text_y, x1, y1, x2, y2): what the views would say in
    words beside x, y, and where each text and its ground stand."""
    zones = made.zones.select("image_id", "zone_id", "final_score", "classification")
    sensors = made.sensors.where("not_viable is null").join(zones, ["image_id", "zone_id"])
    frames = made.pixels.where("x = 0 and y = 0").select("image_id", "w", "h")
    circles_ = sensors.select(
        "image_id", F.col("zone_id").alias("n"), F.format_string("Sensor %d: %.0f %s", "zone_id", "final_score", F.initcap("classification")).alias("text"),
        F.col("cx").alias("x"), F.col("cy").alias("y"), (F.col("cy") - F.col("radius")).alias("top"), (F.col("cy") + F.col("radius")).alias("bottom"),
    )
    bands = made.segments.where("segment_id <= 3").select(
        "image_id", (F.col("segment_id") + made.cfg.max_zones).alias("n"), F.format_string("Supply %d", "segment_id").alias("text"),
        F.col("anchor_x").alias("x"), F.col("anchor_y").alias("y"), (F.col("anchor_y") - 4).alias("top"), (F.col("anchor_y") + 4).alias("bottom"),
    )
    seen = lambda df, *views: df.withColumn("view", F.explode(F.array(*map(F.lit, views))))
    said = seen(circles_, "sensor_zones", "final_analysis").unionByName(seen(bands, "supply_zones", "final_analysis"))
    round_ = sensors.select("image_id", *[(F.col(c) + sign * F.col("radius")).alias(n) for n, c, sign in (("x1", "cx", -1), ("y1", "cy", -1), ("x2", "cx", 1), ("y2", "cy", 1))])
    out = placement.placed(said, frames, seen(round_, "sensor_zones", "final_analysis"), by=("image_id", "view"))
    columns = ["image_id", "view", "text", "x", "y", "text_x", "text_y", "x1", "y1", "x2", "y2"]
    # regions' names stand at their boxes' upper left corners
    font = placement.Font()
    alone = made.isolated.join(frames, "image_id").select("image_id", F.lit("isolated_regions").alias("view"), F.format_string("Isolated #%d %.0f %s", "region_id", "isolation_score", F.split_part("classification", F.lit(" "), F.lit(1))).alias("text"), F.col("left").alias("x"), F.col("top").alias("y"), "w", "h")
    tx, ty, ground = placement.text_box(F.col("x"), F.greatest(F.lit(14), F.col("y") - 6), F.length("text") * font.advance, F.col("w"), F.col("h"), font)
    alone = alone.withColumns({"text_x": tx, "text_y": ty} | dict(zip(("x1", "y1", "x2", "y2"), ground, strict=True)))
    return out.select(*columns).unionByName(alone.select(*columns))
