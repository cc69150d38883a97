"""Rasters derived from the driver's tables, in integer arithmetic that Spark and
DuckDB share: one 64 x 48 scene for each supplier, with a river, a lake and woods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

W, H = 64, 48

WATER = (
    "(y BETWEEN 10 + s_nationkey AND 14 + s_nationkey) OR "
    "(x - (s_suppkey * 7) % 64) * (x - (s_suppkey * 7) % 64) + (y - (s_suppkey * 5) % 48) * (y - (s_suppkey * 5) % 48) <= (4 + s_suppkey % 6) * (4 + s_suppkey % 6)"
)
WOODS = "(x * 3 + y * 5 + s_suppkey) % 23 < 4 AND (x + y * 2) % 17 < 9"
COLOURS = {
    "b": "(s_suppkey * 31 + x * 7 + y * 3) % 256",
    "g": "(s_suppkey * 17 + x * 5 + y * 11) % 256",
    "r": "(s_suppkey * 13 + x * 3 + y * 7) % 256",
}
SUPPORT = "((x * y + s_suppkey) % 101) / 100.0D"


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers, dealt by scene before they have pixels. The number is given, since by the
    size of these few rows Spark would put them all into one task."""
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey").repartition(n, "s_suppkey")


def scene_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, y, x, w, h, water, canopy of every scene."""
    grid = scenes(spark, sf_dir).select("s_suppkey", "s_nationkey", F.explode(F.sequence(F.lit(0), F.lit(W * H - 1))).alias("i"))
    at = grid.select("s_suppkey", "s_nationkey", F.expr(f"cast(i div {W} as int)").alias("y"), (F.col("i") % W).alias("x"))
    return at.select(F.col("s_suppkey").alias("image_id"), "y", "x", F.lit(W).alias("w"), F.lit(H).alias("h"), F.expr(WATER).alias("water"), F.expr(f"({WOODS}) AND NOT ({WATER})").alias("canopy"))


def colour_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, y, x, w, h, b, g, r, support of every scene."""
    grid = scenes(spark, sf_dir).select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(W * H - 1))).alias("i"))
    at = grid.select("s_suppkey", F.expr(f"cast(i div {W} as int)").alias("y"), (F.col("i") % W).alias("x"))
    return at.select(F.col("s_suppkey").alias("image_id"), "y", "x", F.lit(W).alias("w"), F.lit(H).alias("h"), *[F.expr(f"cast({e} as int)").alias(c) for c, e in COLOURS.items()], F.expr(SUPPORT).alias("support"))


# --- the same in DuckDB --------------------------------------------------------------

PX = f"""
px AS (
  SELECT s_suppkey AS image_id, y, x, {W} AS w, {H} AS h, {WATER} AS water, ({WOODS}) AND NOT ({WATER}) AS canopy
  FROM (SELECT s_suppkey, s_nationkey, i // {W} AS y, i % {W} AS x FROM supplier, range({W * H}) t(i))
)"""
RGB = f"""
px AS (
  SELECT s_suppkey AS image_id, y, x, {", ".join(f"({e})::INTEGER AS {c}" for c, e in COLOURS.items())}, {SUPPORT.replace("D", "::DOUBLE")} AS support
  FROM (SELECT s_suppkey, i // {W} AS y, i % {W} AS x FROM supplier, range({W * H}) t(i))
)"""
CROSS = "(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)"


def grown(name: str, src: str, col: str, how: str = "bool_or", kernel: str = CROSS) -> str:
    """CTE: ``col`` dilated (bool_or) or eroded (bool_and) by a list of offsets."""
    return f"""
{name} AS (
  SELECT p.image_id, p.y, p.x, {how}(q.{col}) AS {col} FROM {src} p CROSS JOIN (VALUES {kernel}) o(dy, dx)
  JOIN {src} q ON q.image_id = p.image_id AND q.y = p.y + o.dy AND q.x = p.x + o.dx GROUP BY ALL
)"""


def labels(name: str, src: str, condition: str, reach: int = 1) -> str:
    """CTEs: ``name`` has the runs of the pixels that satisfy a condition, with component
    labels; reach 1: eight neighbours, 0: four."""
    return f"""
{name}_r AS (
  SELECT image_id, y, min(x) AS x0, max(x) AS x1, y * 1048576 + min(x) AS id
  FROM (SELECT image_id, y, x, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS g FROM {src} WHERE {condition}) GROUP BY image_id, y, g
), {name}_e AS (
  SELECT a.image_id, a.id AS a, b.id AS b FROM {name}_r a JOIN {name}_r b
  ON a.image_id = b.image_id AND abs(b.y - a.y) = 1 AND b.x0 <= a.x1 + {reach} AND b.x1 >= a.x0 - {reach}
), {name}_c AS (
  SELECT image_id, id, id AS root FROM {name}_r UNION SELECT c.image_id, e.b, c.root FROM {name}_c c JOIN {name}_e e ON e.image_id = c.image_id AND e.a = c.id
), {name} AS (
  SELECT r.image_id, y, x0, x1, m.label FROM {name}_r r JOIN (SELECT image_id, id, min(root) AS label FROM {name}_c GROUP BY ALL) m ON m.image_id = r.image_id AND m.id = r.id
)"""


def pixels_of(name: str, src: str) -> str:
    """CTE: the pixels of labelled runs."""
    return f"{name} AS (SELECT image_id, y, unnest(range(x0, x1 + 1)) AS x, label FROM {src})"


def stats_of(name: str, src: str) -> str:
    return f"""
{name} AS (
  SELECT image_id, label, sum(x1 - x0 + 1)::BIGINT AS area, min(x0) AS "left", min(y) AS top, (max(x1) - min(x0) + 1) AS width, (max(y) - min(y) + 1) AS height,
         sum((x0 + x1) * (x1 - x0 + 1))::BIGINT / (2.0::DOUBLE * sum(x1 - x0 + 1)::BIGINT) AS cx, sum(y * (x1 - x0 + 1))::BIGINT::DOUBLE / sum(x1 - x0 + 1)::BIGINT AS cy FROM {src} GROUP BY ALL
)"""


CANDIDATE = ",".join([
    PX,
    grown("buf", "px", "water"),
    "c0 AS (SELECT px.*, buf.water AS buffer, NOT px.water AND NOT px.canopy AND NOT buf.water AS candidate FROM px JOIN buf USING (image_id, y, x))",
    grown("c1", "c0", "candidate", "bool_and"),
    grown("c2", "c1", "candidate"),
    grown("c3", "c2", "candidate"),
    grown("c4", "c3", "candidate", "bool_and"),
    "cand AS (SELECT c0.* EXCLUDE (candidate), c4.candidate FROM c0 JOIN c4 USING (image_id, y, x))",
])
WATER_DISTANCE = """
wd AS (
  SELECT p.image_id, p.y, p.x, min((p.y - q.y) * (p.y - q.y) + (p.x - q.x) * (p.x - q.x)) AS d2
  FROM px p JOIN (SELECT image_id, y, x FROM px WHERE water) q USING (image_id) GROUP BY ALL
)"""
CLEARANCE = f"""
clr AS (
  SELECT p.image_id, p.y, p.x, least(min((p.y - q.y) * (p.y - q.y) + (p.x - q.x) * (p.x - q.x)), (p.x + 1) * (p.x + 1), (p.y + 1) * (p.y + 1), ({W} - p.x) * ({W} - p.x), ({H} - p.y) * ({H} - p.y)) AS d2
  FROM cand p LEFT JOIN (SELECT image_id, y, x FROM cand WHERE NOT candidate) q USING (image_id) WHERE p.candidate GROUP BY p.image_id, p.y, p.x
)"""


def outlines(name: str, pixels: str, regions: str) -> str:
    """CTEs: ``name`` has the perimeter of each component (image_id, label) of ``regions``: its
    holes are filled (background that four neighbours join to the outside is none), and
    each 2 x 2 square says how the outline passes."""
    key = 67108864
    return f"""
{name}_p AS (SELECT image_id * {key} + label AS image_id, y, x FROM {pixels} JOIN (SELECT image_id, label FROM {regions}) USING (image_id, label)),
{name}_g AS (
  SELECT k.image_id, a.y, b.x, p.image_id IS NOT NULL AS inside FROM (SELECT DISTINCT image_id FROM {name}_p) k CROSS JOIN range({H + 2}) a(y) CROSS JOIN range({W + 2}) b(x)
  LEFT JOIN {name}_p p ON p.image_id = k.image_id AND p.y = a.y - 1 AND p.x = b.x - 1
), {labels(f"{name}_o", f"{name}_g", "NOT inside", 0)}, {pixels_of(f"{name}_q", f"{name}_o")},
{name}_f AS (SELECT g.image_id, g.y, g.x, (q.image_id IS NULL)::INTEGER AS v FROM {name}_g g LEFT JOIN {name}_q q ON q.image_id = g.image_id AND q.y = g.y AND q.x = g.x AND q.label = 0),
{name}_s AS (
  SELECT a.image_id, a.v + b.v + c.v + d.v AS n, a.v = d.v AS diagonal FROM {name}_f a
  JOIN {name}_f b ON b.image_id = a.image_id AND b.y = a.y AND b.x = a.x + 1
  JOIN {name}_f c ON c.image_id = a.image_id AND c.y = a.y + 1 AND c.x = a.x
  JOIN {name}_f d ON d.image_id = a.image_id AND d.y = a.y + 1 AND d.x = a.x + 1
), {name} AS (
  SELECT image_id // {key} AS image_id, image_id % {key} AS label,
         count_if(n = 2 AND NOT diagonal)::DOUBLE + sqrt(2.0::DOUBLE) * (2 * count_if(n = 2 AND diagonal) + count_if(n = 3))::DOUBLE AS perimeter FROM {name}_s GROUP BY ALL
)"""
