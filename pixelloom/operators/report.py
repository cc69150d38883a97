"""One nested report for each image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.rounding import exact_round


def warnings(cfg: Config = Config()) -> Column:
    """Messages from the columns of ``summary``; at most six."""
    land = F.col("pixels") - F.col("water_pixels")
    said = [
        F.when(F.col("water_pixels") == 0, "No water was found; candidate regions cover the whole frame and mean little."),
        F.when(F.col("zones") == 0, "No candidate zone is large and wide enough outside the water buffer."),
        F.when((F.col("zones") > 0) & (F.col("sensors") == 0), f"No candidate zone has room for a sensor circle of {cfg.min_radius} px."),
        F.when((F.col("water_pixels") > 0) & (F.col("segments") == 0), "There is no open land between the margins around the water."),
        F.when((land > 0) & (F.col("canopy_pixels") / F.greatest(land, F.lit(1)) >= 0.5), F.format_string("%d %% of the land is tree canopy and is left out.", F.round(100.0 * F.col("canopy_pixels") / F.greatest(land, F.lit(1))).cast("int"))),
        F.when(F.col("isolated") == 0, "No isolated land region was found."),
    ]
    return F.filter(F.array(*said), lambda m: m.isNotNull())


def share(part: str, whole: str, digits: int = 2) -> Column:
    """Percentage, 0 of nothing."""
    return exact_round(100.0 * F.col(part) / F.greatest(F.lit(1), F.col(whole)), digits)


def summary(coverage: DataFrame, band: DataFrame, zones: DataFrame, sensors: DataFrame, segments: DataFrame, isolated: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Coverage and band totals with the numbers of zones, sensors, segments and isolated
    regions, all percentages, and warnings. One row an image."""
    out = coverage.join(band, "image_id", "left")
    for frame, name in ((zones, "zones"), (sensors.where("not_viable is null"), "sensors"), (segments, "segments"), (isolated, "isolated")):
        out = out.join(frame.groupBy("image_id").agg(F.count("*").alias(name)), "image_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    out = out.withColumn("supply_pct", share("band_pixels", "pixels")).withColumn("canopy_pct", share("canopy_pixels", "pixels")).withColumn("candidate_pct", share("candidate_pixels", "pixels"))
    # how much of the shore trees take away
    out = out.withColumn("shore_canopy_pct", F.when(F.col("shoreline_pixels") > 0, share("canopy_excluded", "shoreline_pixels", 1)).otherwise(0.0))
    return out.withColumn("warnings", warnings(cfg))


def nested(frame: DataFrame, order: str, name: str, most: int | None = None) -> DataFrame:
    """The rows of an image (few) as one array, in order."""
    cols = [c for c in frame.columns if c != "image_id"]
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*cols).alias("_v")))), lambda x: x["_v"])
    return frame.groupBy("image_id").agg((F.slice(rows, 1, most) if most else rows).alias(name))


def point(x: str, y: str, digits: int | None = None) -> Column:
    at = lambda c: F.col(c) if digits is None else exact_round(F.col(c), digits)
    return F.struct(at(x).alias("x"), at(y).alias("y"))


def box() -> Column:
    return F.struct(F.col("left").alias("x"), F.col("top").alias("y"), "width", "height")


def zone_documents(zones: DataFrame) -> DataFrame:
    parts = F.struct("area_score", F.col("water_score").alias("water_clearance_score"), "openness_score")
    return zones.select("image_id", F.col("zone_id").alias("id"), F.col("final_score").alias("score"), "classification", F.col("area").alias("pixel_area"), "water_clearance", F.col("clearance").alias("region_clearance"), box().alias("bounding_box"), point("cx", "cy", 1).alias("centroid"), point("drop_x", "drop_y").alias("max_clearance_point"), parts.alias("score_breakdown"))


def sensor_documents(sensors: DataFrame, zones: DataFrame) -> DataFrame:
    """Viable circles with the score of their zone (an inner join on its id)."""
    own = zone_documents(zones).select("image_id", F.col("id").alias("zone_id"), "score", "classification", "score_breakdown")
    out = sensors.where("not_viable is null").join(own, ["image_id", "zone_id"])
    return out.select("image_id", F.col("zone_id").alias("id"), "zone_id", "score", "classification", point("cx", "cy").alias("center"), F.col("radius").alias("radius_px"), "limiting_factor", F.col("limiting_distance").alias("limiting_distance_px"), F.col("water_clearance").alias("water_clearance_px"), "score_breakdown")


def refused_documents(sensors: DataFrame) -> DataFrame:
    radius = F.when(F.col("not_viable") == "radius_below_minimum", F.col("radius")).otherwise(0).alias("radius_px")
    return sensors.where("not_viable is not null").select("image_id", "zone_id", F.col("not_viable").alias("reason"), radius)


def segment_documents(segments: DataFrame, totals: DataFrame) -> DataFrame:
    of_band = exact_round(100.0 * F.col("area") / F.greatest(F.lit(1), F.col("band_pixels")), 1)
    return segments.join(totals.select("image_id", "band_pixels"), "image_id").select("image_id", F.col("segment_id").alias("id"), F.col("area").alias("pixel_area"), of_band.alias("share_of_band"), box().alias("bounding_box"), point("cx", "cy", 1).alias("centroid"), point("anchor_x", "anchor_y").alias("anchor"))


def isolated_documents(isolated: DataFrame) -> DataFrame:
    parts = F.struct(F.col("water_contact").alias("water_contact_ratio"), F.col("separation").alias("separation_px"), "relative_size")
    return isolated.select("image_id", F.col("region_id").alias("id"), "isolation_score", "classification", F.col("area").alias("pixel_area"), box().alias("bounding_box"), point("cx", "cy").alias("centroid"), parts.alias("score_breakdown"))


def parameters(cfg: Config) -> Column:
    """The thresholds behind a report."""
    sensor = F.struct(F.lit(cfg.safety_margin).alias("radius_margin_px"), F.lit(cfg.min_radius).alias("min_radius_px"), F.lit(cfg.max_radius).alias("max_radius_px"))
    supply = F.struct(F.lit(cfg.supply_inner).alias("inner_margin_px"), F.lit(cfg.supply_outer).alias("outer_margin_px"), F.lit(cfg.supply_min_area).alias("min_segment_area_px"))
    weights = F.struct(F.lit(0.4).alias("area"), F.lit(0.4).alias("water_clearance"), F.lit(0.2).alias("openness"))
    return F.struct(
        F.lit(cfg.buffer_size).alias("water_buffer_px"), F.lit(cfg.candidate_min_area).alias("min_region_area_px"), F.lit(cfg.isolated_min_area).alias("min_isolated_area_px"), F.lit(cfg.max_zones).alias("max_zones"),
        sensor.alias("sensor"), supply.alias("supply"), F.lit(True).alias("canopy_excluded"), F.col("scene_model").alias("scene_colour_model"), weights.alias("score_weights"),
    )


#: What a reader of reports needs; further fields are ignored.
DOCUMENT = (
    "success boolean, metrics struct<water_percentage:double,candidate_regions:long,sensor_zones:long,supply_zone_segments:long>, "
    "sensor_zones array<struct<id:long,score:double,radius_px:long,center:struct<x:long,y:long>>>, "
    "supply_zone struct<pixel_area:long,segment_count:long>, parameters struct<sensor:struct<min_radius_px:long>,supply:struct<inner_margin_px:double>>"
)


def read_back(docs: DataFrame, column: str = "doc") -> DataFrame:
    """``docs`` with their JSON as a typed column ``report`` and a ``report_status``: OK; MALFORMED_RESPONSE
    where the text is no document of these types (cut off, or a field of another type);
    EMPTY_RESULT without success or metrics; INCOMPATIBLE_BACKEND where sensor zones, the supply
    zone or their parameters are missing, as in reports of older versions."""
    parsed = F.from_json(F.col(column), f"{DOCUMENT}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    out = docs.withColumn("report", parsed)
    r = F.col("report")
    broken = r.isNull() | r["_broken"].isNotNull()
    empty = ~F.coalesce(r["success"], F.lit(False)) | r["metrics"].isNull()
    old = r["sensor_zones"].isNull() | r["supply_zone"].isNull() | r["parameters"]["sensor"].isNull() | r["parameters"]["supply"].isNull()
    return out.withColumn("report_status", F.when(broken, "MALFORMED_RESPONSE").when(empty, "EMPTY_RESULT").when(old, "INCOMPATIBLE_BACKEND").otherwise("OK")).withColumn("report", r.dropFields("_broken"))


def report(summary_: DataFrame, zones: DataFrame, sensors: DataFrame, segments: DataFrame, isolated: DataFrame, cfg: Config = Config(), detections: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """(image_id, doc): the nested document as JSON. ``summary_`` may carry scene_model and
    image_info; detections and their counts (image_id, counts, and ai_status and ai_message where
    a detector may have failed) are told where there are any."""
    out = summary_ if "scene_model" in summary_.columns else summary_.withColumn("scene_model", F.lit(False))
    children = [
        (zone_documents(zones), "id", "zones_", None), (sensor_documents(sensors, zones), "id", "sensor_zones", None), (refused_documents(sensors), "zone_id", "refused", None),
        (segment_documents(segments, summary_), "id", "segments_", cfg.supply_reported), (isolated_documents(isolated), "id", "isolated_regions", None),
    ]
    if detections is not None:
        found = detections.select("image_id", "n", "label", "confidence", F.struct("x1", "y1", "x2", "y2").alias("bbox"))
        children.append((found, "n", "detections", None))
        if "ai_status" not in counts.columns:
            counts = counts.withColumns({"ai_status": F.lit("active"), "ai_message": F.lit(None).cast("string")})
        out = out.join(counts, "image_id", "left").withColumn("ai_status", F.coalesce("ai_status", F.lit("unavailable")))
    for frame, order, name, most in children:
        out = out.join(nested(frame, order, name, most), "image_id", "left").withColumn(name, F.coalesce(name, F.array()))
    metrics = F.struct(
        F.col("water_pct").alias("water_percentage"), F.col("non_water_pct").alias("non_water_percentage"), F.col("regions").alias("candidate_regions") if "regions" in out.columns else F.col("zones").alias("candidate_regions"),
        F.col("isolated").alias("isolated_regions"), F.col("sensors").alias("sensor_zones"), F.col("segments").alias("supply_zone_segments"), F.col("supply_pct").alias("supply_area_percentage"),
        F.col("canopy_pct").alias("canopy_percentage"), F.col("candidate_pct").alias("candidate_area_percentage"), F.col("shore_canopy_pct").alias("shore_canopy_percentage"),
    )
    supply = F.struct(
        F.lit(cfg.supply_inner).alias("inner_margin_px"), F.lit(cfg.supply_outer).alias("outer_margin_px"), F.col("band_pixels").alias("pixel_area"), F.col("supply_pct").alias("area_percentage"),
        F.col("shoreline_pixels").alias("shoreline_land_px"), F.col("canopy_excluded").alias("canopy_excluded_px"), F.col("segments").alias("segment_count"), F.col("segments_").alias("segments"),
    )
    circles = F.struct(F.col("zones").alias("evaluated"), F.col("sensors").alias("viable"), F.col("refused").alias("not_viable"))
    if detections is not None:
        active = F.col("ai_status") == "active"
        # fields that are null are not written
        ai = F.struct(F.when(active, "active").otherwise("unavailable").alias("status"), F.col("ai_message").alias("message"), F.when(active, F.col("detections")).alias("detections"), F.when(active, F.col("counts")).alias("counts"))
    else:
        active, ai = F.lit(False), F.struct(F.lit("unavailable").alias("status"))
    info = [F.col("image_info")] if "image_info" in out.columns else []
    doc = F.struct(F.lit(True).alias("success"), F.struct(F.lit(True).alias("opencv"), active.alias("ai")).alias("analysis_mode"), ai.alias("ai"), *info, parameters(cfg).alias("parameters"), metrics.alias("metrics"), F.col("zones_").alias("zones"), "sensor_zones", supply.alias("supply_zone"), circles.alias("sensor_analysis"), "isolated_regions", "warnings")
    return out.select("image_id", F.to_json(doc).alias("doc"))
