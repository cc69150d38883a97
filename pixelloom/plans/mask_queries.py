"""Queries on masks as runs, on the chamfer metric and on contours. The SQL works on pixels."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import outlines
from ..operators import runs, stages, whole, windows
from ..store import cut
from . import scenes as sc
from .registry import _OPEN, CFG, _zoned, query


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.scenes(spark, sf_dir).select(F.col("s_suppkey").alias("image_id"), F.lit(sc.W).alias("w"), F.lit(sc.H).alias("h"))


def _measured(runs_: DataFrame, name: str) -> DataFrame:
    """Pixels of an image's runs, and the sums of their x and of x * y."""
    n = F.col("x1") - F.col("x0") + 1
    sx = F.expr("(x0 + x1) * (x1 - x0 + 1) div 2")
    return runs_.groupBy("image_id").agg(F.lit(name).alias("mask"), F.sum(n).cast("long").alias("pixels"), F.sum(sx).alias("by_x"), F.sum(sx * F.col("y")).alias("by_xy"))


def _sql_measured(*masks: tuple[str, str, str]) -> str:
    return " UNION ALL ".join(f"SELECT image_id, '{name}' AS mask, count(*) AS pixels, sum(x)::BIGINT AS by_x, sum(x * y)::BIGINT AS by_xy FROM {src} WHERE {condition} GROUP BY image_id" for name, src, condition in masks)


def _set(name: str, condition: str) -> str:
    """CTE: the scene's pixels of a condition."""
    return f"{name} AS (SELECT image_id, y, x FROM px WHERE {condition})"


def _grown(name: str, src: str, k: int) -> str:
    """CTE: the pixels of ``src`` moved by every offset of the kernel."""
    kernel = ", ".join(f"({dy - k // 2}, {dx})" for dy, n in enumerate(windows.ellipse(k)) for dx in range(-n, n + 1))
    return f"""{name} AS (
  SELECT DISTINCT image_id, y + dy AS y, x + dx AS x FROM {src} CROSS JOIN (VALUES {kernel}) o(dy, dx) WHERE y + dy BETWEEN 0 AND {sc.H - 1} AND x + dx BETWEEN 0 AND {sc.W - 1})"""


def _without(name: str, src: str) -> str:
    """CTE: the scene's pixels that are not in ``src``."""
    return f"{name} AS (SELECT px.image_id, px.y, px.x FROM px ANTI JOIN {src} s ON s.image_id = px.image_id AND s.y = px.y AND s.x = px.x)"


@query(f"""WITH {sc.PX}, g AS (SELECT image_id, y, x, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS g FROM px WHERE water),
r AS (SELECT image_id, y, min(x) AS x0, max(x) AS x1 FROM g GROUP BY image_id, y, g)
SELECT image_id, count(*) AS runs, sum(x1 - x0 + 1)::BIGINT AS pixels, max(x1 - x0 + 1) AS longest, sum(x0 * y)::BIGINT AS starts, sum(x1 * y)::BIGINT AS ends FROM r GROUP BY image_id""")
def mask_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The water of each scene as runs."""
    out = runs.of_mask(sc.scene_pixels(spark, sf_dir), "water")
    return out.groupBy("image_id").agg(F.count("*").alias("runs"), runs.area().alias("pixels"), F.max(F.col("x1") - F.col("x0") + 1).alias("longest"), F.sum(F.col("x0") * F.col("y")).alias("starts"), F.sum(F.col("x1") * F.col("y")).alias("ends"))


@query(f"""WITH {sc.PX}, {_set("t", "canopy")}, {_grown("g", "t", 5)}, m AS (SELECT px.image_id, px.y, px.x, water AS a, g.image_id IS NOT NULL AS b FROM px LEFT JOIN g USING (image_id, y, x))
{_sql_measured(("union", "m", "a OR b"), ("intersection", "m", "a AND b"), ("difference", "m", "a AND NOT b"), ("apart", "m", "a <> b"), ("complement", "m", "NOT a"))}""")
def mask_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set operations of water (a) and of canopy grown by 5 x 5 (b), on runs."""
    px, images = sc.scene_pixels(spark, sf_dir), _images(spark, sf_dir)
    a, b = runs.of_mask(px, "water"), runs.grown(runs.of_mask(px, "canopy"), images, 5)
    made = {"union": runs.union(a, b), "intersection": runs.intersection(a, b), "difference": runs.difference(a, b), "apart": runs.combined("a <> b", a=a, b=b), "complement": runs.complement(a, images)}
    return reduce(DataFrame.unionByName, [_measured(m, name) for name, m in made.items()])


@query(f"""WITH {sc.PX}, {_set("t", "canopy")}, {_grown("d", "t", 5)}, {_set("land", "NOT water")}, {_grown("l1", "land", 5)}, {_without("e", "l1")}, {_grown("o", "e", 5)},
{_without("n", "d")}, {_grown("n1", "n", 5)}, {_without("c", "n1")}
{_sql_measured(("dilated", "d", "true"), ("eroded", "e", "true"), ("opened", "o", "true"), ("closed", "c", "true"))}""")
def mask_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Morphology with an elliptical 5 x 5 kernel on runs: canopy grown and closed, water shrunk and opened."""
    px, images = sc.scene_pixels(spark, sf_dir), _images(spark, sf_dir)
    water, canopy = runs.of_mask(px, "water"), runs.of_mask(px, "canopy")
    made = {"dilated": runs.grown(canopy, images, 5), "eroded": runs.shrunk(water, images, 5), "opened": runs.opened(water, images, 5), "closed": runs.closed(canopy, images, 5)}
    return reduce(DataFrame.unionByName, [_measured(m, name) for name, m in made.items()])


@query(f"""WITH RECURSIVE {sc.PX}, {sc.labels("l", "px", "NOT water")}, {sc.stats_of("s", "l")} SELECT image_id, label, area, "left", top, width, height, round(cx, 4) AS cx, round(cy, 4) AS cy FROM s""", pixels=True)
def run_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land components, labelled on runs."""
    images = _images(spark, sf_dir)
    land = runs.complement(runs.of_mask(sc.scene_pixels(spark, sf_dir), "water"), images)
    found = runs.stats(runs.labelled(land))
    return found.select("image_id", "label", "area", "left", "top", "width", "height", F.round("cx", 4).alias("cx"), F.round("cy", 4).alias("cy"))


_CHAMFER = """CASE WHEN greatest(abs(p.y - q.y), abs(p.x - q.x)) >= 2 * least(abs(p.y - q.y), abs(p.x - q.x))
  THEN 21969 * least(abs(p.y - q.y), abs(p.x - q.x)) + 10000 * (greatest(abs(p.y - q.y), abs(p.x - q.x)) - 2 * least(abs(p.y - q.y), abs(p.x - q.x)))
  ELSE 21969 * abs(abs(p.y - q.y) - abs(p.x - q.x)) + 14000 * (2 * least(abs(p.y - q.y), abs(p.x - q.x)) - greatest(abs(p.y - q.y), abs(p.x - q.x))) END"""


@query(f"""WITH {sc.PX}, d AS (SELECT p.image_id, p.y, p.x, min({_CHAMFER})::BIGINT AS units FROM px p JOIN (SELECT image_id, y, x FROM px WHERE water) q USING (image_id) GROUP BY ALL)
SELECT image_id, sum(units)::BIGINT AS total, max(units)::BIGINT AS furthest, sum(units * x)::BIGINT AS by_x, sum(units * y)::BIGINT AS by_y FROM d GROUP BY image_id""", pixels=True)
def chamfer_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances to water by steps of the 5 x 5 mask, in ten-thousandths of a pixel."""
    px = sc.scene_pixels(spark, sf_dir).withColumn("dry", ~F.col("water"))
    out = whole.add(px, d=whole.clearance("dry", padded=False, metric="chamfer5"))
    units = F.round(F.col("d") * whole.UNIT).cast("long")
    return out.groupBy("image_id").agg(F.sum(units).alias("total"), F.max(units).alias("furthest"), F.sum(units * F.col("x")).alias("by_x"), F.sum(units * F.col("y")).alias("by_y"))


@query(f"""WITH RECURSIVE {sc.CANDIDATE}, {sc.labels("l", "cand", "candidate")}, {sc.pixels_of("p", "l")}, {sc.stats_of("s", "l")},
off AS (SELECT image_id, y, x FROM cand WHERE NOT candidate UNION ALL SELECT i.image_id, e.y, e.x FROM (SELECT DISTINCT image_id FROM px) i, (
  SELECT a.y - 1 AS y, b.x - 1 AS x FROM range({sc.H + 2}) a(y), range({sc.W + 2}) b(x) WHERE a.y IN (0, {sc.H + 1}) OR b.x IN (0, {sc.W + 1})) e),
clr AS (SELECT p.image_id, p.y, p.x, p.label, min({_CHAMFER}) AS d FROM p JOIN off q USING (image_id) GROUP BY ALL),
wet AS (SELECT p.image_id, p.y, p.x, min({_CHAMFER}) AS d FROM p JOIN (SELECT image_id, y, x FROM px WHERE water) q USING (image_id) GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, label ORDER BY d DESC, y, x) AS n FROM clr) WHERE n = 1)
SELECT b.image_id, b.label, b.x AS drop_x, b.y AS drop_y, round(b.d / 10000.0::DOUBLE, 2) AS clearance, round(least(coalesce(w.d / 10000.0::DOUBLE, 80.0::DOUBLE), 80.0::DOUBLE), 2) AS water_clearance
FROM best b JOIN s USING (image_id, label) LEFT JOIN wet w ON w.image_id = b.image_id AND w.y = b.y AND w.x = b.x WHERE s.area >= 20 AND b.d >= 20000""", pixels=True)
def chamfer_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate regions under the other metric: the points of most clearance, and their distances."""
    cfg = replace(CFG, metric="chamfer5")
    zoned = stages.zone_rows(sc.scene_pixels(spark, sf_dir), cfg, True)
    return stages.regions(zoned, cfg).select("image_id", "label", "drop_x", "drop_y", "clearance", "water_clearance")


@query(f"""WITH RECURSIVE {_OPEN}, sq AS (SELECT image_id // 67108864 AS image_id, image_id % 67108864 AS label, count_if(n = 4) + count_if(n = 3) / 2.0::DOUBLE AS enclosed FROM per_s GROUP BY ALL)
SELECT image_id, label, round(perimeter, 4) AS length, enclosed, "left", top, ("left" + width - 1) AS "right", (top + height - 1) AS bottom FROM opened JOIN sq USING (image_id, label)""", pixels=True)
def zone_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outer contours of the candidate regions as points: their length, the area they enclose, their extent."""
    zoned = cut(_zoned(spark, sf_dir).where("label is not null"), "zoned")
    regions = stages.regions(zoned, CFG).select("image_id", F.col("region_id").alias("zone_id"), "label")
    found = stages.zone_contours(regions, zoned)
    p = F.col("points")
    side = lambda f, c: f(F.transform(p, lambda q: q[c]))
    return found.select(
        "image_id", "label", F.round(outlines.closed_length(p), 4).alias("length"), outlines.enclosed_area(p).alias("enclosed"),
        side(F.array_min, "x").alias("left"), side(F.array_min, "y").alias("top"), side(F.array_max, "x").alias("right"), side(F.array_max, "y").alias("bottom"),
    )
