"""Queries on edges, texture support and cue means, and on the table function."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import colour
from ..operators import stages, tables
from . import scenes as sc
from .registry import CUES, _down, query


def _mirrored(name: str, src: str, r: int, cols: str) -> str:
    """CTE: ``src`` with r more pixels at each edge."""
    at = lambda c, n: f"list_filter([{c}, CASE WHEN {c} BETWEEN 1 AND {r} THEN -{c} END, CASE WHEN {c} BETWEEN {n - 1 - r} AND {n - 2} THEN {2 * (n - 1)} - {c} END], lambda q: q IS NOT NULL)"
    return f"{name} AS (SELECT image_id, {cols}, y, unnest({at('x', sc.W)}) AS x FROM (SELECT image_id, {cols}, x, unnest({at('y', sc.H)}) AS y FROM {src}))"


def _boxes(name: str, src: str, r: int, cols: tuple[str, ...]) -> str:
    """CTE: sums of columns over (2 r + 1) x (2 r + 1) pixels of mirrored ``src``, at the image's own pixels."""
    along = lambda axis, other, c: f"sum({c}) OVER (PARTITION BY image_id, {other} ORDER BY {axis} ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS {c}"
    return f"""{name} AS (SELECT * FROM (SELECT image_id, y, x, {", ".join(along("y", "x", c) for c in cols)} FROM (SELECT image_id, y, x, {", ".join(along("x", "y", c) for c in cols)} FROM {src}))
  WHERE y BETWEEN 0 AND {sc.H - 1} AND x BETWEEN 0 AND {sc.W - 1})"""


_EDGES = f"""{sc.RGB}, gray AS (SELECT *, floor((114 * b + 587 * g + 299 * r) / 1000.0::DOUBLE + 0.5::DOUBLE)::INTEGER AS v FROM px), {_mirrored("gm", "gray", 1, "v")},
soft AS (SELECT p.image_id, p.y, p.x, floor(sum(q.v * (2 - abs(q.y - p.y)) * (2 - abs(q.x - p.x))) / 16.0::DOUBLE + 0.5::DOUBLE)::INTEGER AS v FROM gray p JOIN gm q ON q.image_id = p.image_id AND q.y BETWEEN p.y - 1 AND p.y + 1 AND q.x BETWEEN p.x - 1 AND p.x + 1 GROUP BY ALL),
nb AS (SELECT p.image_id, p.y, p.x, q.v, least(greatest(p.y + dy, 0), {sc.H - 1}) - p.y AS ey, dy, dx FROM soft p CROSS JOIN (VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 0), (0, 1), (1, -1), (1, 0), (1, 1)) o(dy, dx)
  JOIN soft q ON q.image_id = p.image_id AND q.y = least(greatest(p.y + dy, 0), {sc.H - 1}) AND q.x = least(greatest(p.x + dx, 0), {sc.W - 1})),
grad AS (SELECT image_id, y, x, sum(v * dx * (2 - abs(dy)))::INTEGER AS gx, sum(v * dy * (2 - abs(dx)))::INTEGER AS gy FROM nb GROUP BY ALL),
mag AS (SELECT *, abs(gx) + abs(gy) AS m FROM grad),
way AS (SELECT *, CASE WHEN abs(gy) * 2.414213562373095::DOUBLE < abs(gx) THEN [0, 1] WHEN abs(gy) > abs(gx) * 2.414213562373095::DOUBLE THEN [1, 0] WHEN gx * gy >= 0 THEN [1, 1] ELSE [1, -1] END AS d FROM mag),
thin AS (SELECT w.image_id, w.y, w.x, w.m > coalesce(a.m, 0) AND w.m >= coalesce(b.m, 0) AND w.m > 60 AS weak, w.m > coalesce(a.m, 0) AND w.m >= coalesce(b.m, 0) AND w.m > 150 AS strong
  FROM way w LEFT JOIN mag a ON a.image_id = w.image_id AND a.y = w.y - d[1] AND a.x = w.x - d[2] LEFT JOIN mag b ON b.image_id = w.image_id AND b.y = w.y + d[1] AND b.x = w.x + d[2]),
{sc.labels("l", "thin", "weak")}, {sc.pixels_of("lp", "l")},
held AS (SELECT DISTINCT image_id, label FROM lp JOIN thin USING (image_id, y, x) WHERE strong),
edge AS (SELECT thin.*, held.label IS NOT NULL AS edge FROM thin LEFT JOIN lp USING (image_id, y, x) LEFT JOIN held USING (image_id, label))"""


@query(f"""WITH RECURSIVE {_EDGES}, e AS (SELECT image_id, y, x, edge::INTEGER AS e FROM edge), {_mirrored("em", "e", 7, "e")}, {_boxes("eb", "em", 7, ("e",))},
n AS (SELECT image_id, sum(e)::BIGINT AS around, max(e)::BIGINT AS most FROM eb GROUP BY image_id)
SELECT image_id, count_if(weak) AS weak, count_if(strong) AS strong, count_if(edge) AS edges, sum(CASE WHEN edge THEN x * y ELSE 0 END)::BIGINT AS moment, around, most FROM edge JOIN n USING (image_id) GROUP BY image_id, around, most""", pixels=True)
def canny_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the coloured scenes: softened, thinned, weak ones only where they hang on strong
    ones; and how many lie in the 15 x 15 pixels around."""
    px = sc.colour_pixels(spark, sf_dir).select("image_id", "y", "x", "w", "h", colour.gray(F.col("b"), F.col("g"), F.col("r")).alias("gray"))
    n = F.count_if
    around = F.round(F.col("share") * 225).cast("long")
    held = stages.edge_density(px, "gray", "share", ordered=True)
    return held.groupBy("image_id").agg(
        n("edge_weak").alias("weak"), n("edge_strong").alias("strong"), n("edge").alias("edges"), F.sum(F.when(F.col("edge"), F.col("x") * F.col("y")).otherwise(0)).alias("moment"),
        F.sum(around).alias("around"), F.max(around).alias("most"),
    )


_LINEAR = ", ".join(f"CASE WHEN {c} / 255.0::DOUBLE <= 0.04045::DOUBLE THEN {c} / 255.0::DOUBLE / 12.92::DOUBLE ELSE pow(({c} / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END AS l{c}" for c in "bgr")
_XYZ = ", ".join(f"({a}::DOUBLE * lr + {b}::DOUBLE * lg + {c}::DOUBLE * lb){d} AS {n}" for n, a, b, c, d in (("cx", 0.412453, 0.357580, 0.180423, " / 0.950456::DOUBLE"), ("cy", 0.212671, 0.715160, 0.072169, ""), ("cz", 0.019334, 0.119193, 0.950227, " / 1.088754::DOUBLE")))
_F = ", ".join(f"CASE WHEN {c} > 0.008856::DOUBLE THEN cbrt({c}) ELSE 7.787::DOUBLE * {c} + {16.0 / 116.0!r}::DOUBLE END AS f{c[1]}" for c in ("cx", "cy", "cz"))
_STD = lambda s, q, n: f"sqrt(greatest({q} / {n}.0::DOUBLE - ({s} / {n}.0::DOUBLE) * ({s} / {n}.0::DOUBLE), 0.0::DOUBLE))"


@query(f"""WITH RECURSIVE {_EDGES}, e AS (SELECT image_id, y, x, edge::INTEGER AS e FROM edge), {_mirrored("em", "e", 7, "e")}, {_boxes("eb", "em", 7, ("e",))},
lin AS (SELECT image_id, y, x, {_LINEAR} FROM px), xyz AS (SELECT image_id, y, x, {_XYZ} FROM lin), ff AS (SELECT image_id, y, x, {_F} FROM xyz),
lab AS (SELECT image_id, y, x, floor(500.0::DOUBLE * (fx - fy) + 128.0::DOUBLE + 0.5::DOUBLE)::BIGINT AS a, floor(200.0::DOUBLE * (fy - fz) + 128.0::DOUBLE + 0.5::DOUBLE)::BIGINT AS c FROM ff),
lab2 AS (SELECT *, a * a AS a2, c * c AS c2 FROM lab), {_mirrored("lm", "lab2", 7, "a, a2, c, c2")}, {_boxes("lb", "lm", 7, ("a", "a2", "c", "c2"))},
g2 AS (SELECT image_id, y, x, v, v * v AS v2 FROM gray), {_mirrored("g2m", "g2", 4, "v, v2")}, {_boxes("gb", "g2m", 4, ("v", "v2"))},
sup AS (SELECT image_id, y, x, least(greatest(0.40::DOUBLE * {_down(f"({_STD('a', 'a2', 225)} + {_STD('c', 'c2', 225)})", 6, 16)} + 0.20::DOUBLE * {_down(_STD("v", "v2", 81), 10, 34)} + 0.40::DOUBLE * {_down("(e / 225.0::DOUBLE)", 0.05, 0.22)}, 0.0::DOUBLE), 1.0::DOUBLE) AS s
  FROM lb JOIN gb USING (image_id, y, x) JOIN eb USING (image_id, y, x))
SELECT image_id, sum(round(s * 1000)::BIGINT)::BIGINT AS support, count_if(s >= 0.5::DOUBLE) AS smooth, sum(round(s * 1000)::BIGINT * x)::BIGINT AS by_x FROM sup GROUP BY image_id""", pixels=True)
def texture_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How smooth the coloured scenes are: colour and brightness that vary little, and few edges."""
    px = sc.colour_pixels(spark, sf_dir).drop("support").select("*", *[F.col(c).alias(f"a{c}") for c in "bgr"])
    out = stages.support_map(px, ordered=True)
    s = F.round(F.col("support") * 1000).cast("long")
    return out.groupBy("image_id").agg(F.sum(s).alias("support"), F.count_if(F.col("support") >= 0.5).alias("smooth"), F.sum(s * F.col("x")).alias("by_x"))


@query(f"""WITH {sc.RGB}, {CUES}
SELECT image_id, {", ".join(f"round(avg({c}), 6) AS {n}" for c, n in (("blue", "blue"), ("turbid", "turbid"), ("dark", "dark"), ("pale", "low_saturation"), ("support", "support"), ("veg", "vegetation")))} FROM lik GROUP BY image_id""")
def cue_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of every cue over a scene, as reports may tell for diagnosis."""
    px = sc.colour_pixels(spark, sf_dir).select("*", *[F.col(c).alias(f"a{c}") for c in "bgr"])
    means = stages.cue_means(px)
    return means.select("image_id", *[F.round(c, 6).alias(c) for c in means.columns[1:]])


@query(f"""WITH RECURSIVE {sc.PX}, {sc.labels("l", "px", "NOT water")}, {sc.pixels_of("p", "l")}, {sc.WATER_DISTANCE}
SELECT image_id, label, count(*) AS area, sum(d2)::BIGINT AS d2_sum, max(d2)::BIGINT AS d2_max FROM p JOIN wd USING (image_id, y, x) GROUP BY image_id, label""", pixels=True)
def components_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land components and their distances to water, by a table function in SQL text."""
    tables.register(spark)
    sc.scene_pixels(spark, sf_dir).createOrReplaceTempView("scene_pixels")
    return spark.sql("""
        SELECT image_id, label, count(*) AS area, sum(d2) AS d2_sum, max(d2) AS d2_max
        FROM image_components(TABLE(SELECT image_id, y, x, NOT water AS mask FROM scene_pixels) PARTITION BY image_id ORDER BY (y, x))
        WHERE label IS NOT NULL GROUP BY image_id, label
    """)
