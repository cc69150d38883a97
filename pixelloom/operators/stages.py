"""Stages of the analysis: each takes and returns DataFrames keyed by image_id.

``px`` is a pixel table (image_id, y, x, w, h and boolean or numeric columns). Stages
that need the pixels several times store them once in the shared folder (``stored``).
Window stages keep a partitioning by image, under which both axes only sort. Stages with
``ordered`` add their columns in passes over whole images; pixels that are in order
already (see ``whole``) are then neither shuffled nor sorted, and stay in order.

Tables that several stages read are stored as runs (``*_rows``): image_id, y, x0, x1, arrays of
what differs from pixel to pixel. Stages that read them take pixels too, as runs of one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from ..config import Config
from ..functions import colour, scores
from ..store import cut
from . import components as cc
from . import around, runs, whole, windows

PIXEL = ["image_id", "y", "x"]


def stored(px: DataFrame, name: str) -> DataFrame:
    """``px`` written to the shared folder, dealt by image again."""
    return cut(px, name).repartition("image_id")


def in_runs(px: DataFrame, name: str, each: list[str], without: list[str], ordered: bool = False, **added: whole.Added) -> DataFrame:
    """``px`` with added columns, stored as runs: a row for each stretch of a line on which all but
    ``each`` is equal. Columns are added and packed in one pass."""
    return cut(whole.add(px, runs.Packing(each, without), ordered, **added), name)


def as_runs(rows: DataFrame, *each: str) -> DataFrame:
    """Pixels as runs of one, with ``each`` in arrays; runs as they are."""
    if "x0" in rows.columns:
        return rows
    same = [c for c in rows.columns if c not in ("x", *each)]
    return rows.select(*same, F.col("x").alias("x0"), F.col("x").alias("x1"), *[F.array(c).alias(c) for c in each])


def in_a_run(condition: str) -> Column:
    """Pixels of the runs of a group that satisfy a condition."""
    return F.sum(F.expr(f"case when {condition} then x1 - x0 + 1 else 0 end")).cast("long")


def topmost(rows: DataFrame, by: str, *more: str) -> DataFrame:
    """Adds _at (x of a run's first pixel of the greatest ``by``), _top (that value), and the values of ``more`` there."""
    out = rows.withColumn("_top", F.array_max(by))
    out = out.withColumn("_i", (F.array_position(by, F.col("_top")) - 1).cast("int"))
    return out.select(*[c for c in rows.columns if c not in (by, *more)], "_top", (F.col("x0") + F.col("_i")).alias("_at"), *[F.get(c, F.col("_i")).alias(c) for c in more])


def rank(order: list[Column], name: str, *by: str) -> Column:
    return F.row_number().over(Window.partitionBy(*(by or ("image_id",))).orderBy(*order)).alias(name)


# --- masks ---------------------------------------------------------------------------


def support_map(px: DataFrame, cfg: Config = Config(), ordered: bool = False) -> DataFrame:
    """Adds support (0 to 1): smooth colour, smooth brightness and few edges around."""
    light, a, b_ = colour.lab(F.col("ab"), F.col("ag"), F.col("ar"))
    out = px.withColumn("_gray", colour.gray(F.col("ab"), F.col("ag"), F.col("ar"))).withColumn("_la", colour.half_up(a + 128.0)).withColumn("_lb", colour.half_up(b_ + 128.0))
    stds = {name: around.deviation(col, n) for col, n, name in (("_la", 15, "_sa"), ("_lb", 15, "_sb"), ("_gray", 9, "_sg"))}
    out = whole.add(out, ordered=ordered, without=["_gray", "_la", "_lb", *EDGE], **stds, **edge_columns("_gray"), _edges=around.mean("_edge", 15))
    return out.select(*px.columns, colour.support(F.col("_sa") + F.col("_sb"), F.col("_sg"), F.col("_edges")).alias("support"))


#: Columns that ``edge_columns`` adds.
EDGE = ("_soft", "_grade", "edge_weak", "edge_strong", "_edge")


def edge_columns(gray: str, low: int = 60, high: int = 150) -> dict[str, whole.Added]:
    """Canny edges: of the softened column, weak ones count if they hang on a strong one."""
    return {"_soft": around.blurred(gray, 3), "_grade": around.edge_grade("_soft", low, high), "edge_weak": around.graded("_grade", 1), "edge_strong": around.graded("_grade", 2), "_edge": whole.reached("edge_weak", "edge_strong")}


def edge_density(px: DataFrame, gray: str, name: str, low: int = 60, high: int = 150, ordered: bool = False) -> DataFrame:
    """Adds edge_weak, edge_strong, edge, and the share of edge pixels in 15 x 15."""
    return whole.add(px, ordered=ordered, without=["_soft", "_grade"], **edge_columns(gray, low, high), **{name: around.mean("_edge", 15)}).withColumnRenamed("_edge", "edge")


def evidence(px: DataFrame, ordered: bool = False) -> DataFrame:
    """Adds evidence (float) from the columns ab, ag, ar (analysis copy) and support."""
    return whole.add(px, ordered=ordered, evidence=EVIDENCE)


def _evidence(get) -> np.ndarray:
    bgr = [get(c).astype(np.int64) for c in ("ab", "ag", "ar")]
    return colour.likelihood(*bgr, get("support"), (colour.hue(*bgr), colour.saturation(*bgr), colour.value(*bgr))).astype(np.float32)


EVIDENCE = whole.Added(FloatType(), _evidence)


def wet(px: DataFrame, cfg: Config = Config()) -> Column:
    return F.col("evidence") >= F.lit(cfg.water_threshold).cast("float")


def clean_water(px: DataFrame, cfg: Config = Config(), ordered: bool = False) -> DataFrame:
    """Opened and closed water without small holes, small parts and unsupported regions."""
    return verify_regions(
        px, cfg, ordered, _open=around.opened("water", cfg.water_open), _closed=around.closed("_open", cfg.water_close),
        _full=whole.filled("_closed", cfg.hole_max_area), _large=whole.at_least("_full", cfg.water_min_area),
    )


def verify_regions(px: DataFrame, cfg: Config = Config(), ordered: bool = False, **before: whole.Added) -> DataFrame:
    """Water regions that are large, or that their texture supports."""
    last = next(reversed(before), "water")
    out = whole.add(px, ordered=ordered, without=list(before), **before, _sure=whole.supported(last, "support", cfg.verify_share, cfg.verify_support))
    return out.withColumn("water", F.col("_sure")).drop("_sure")


def detect_water(px: DataFrame, cfg: Config = Config(), ordered: bool = False) -> tuple[DataFrame, DataFrame]:
    """Water of every image, from the analysis copy (ab, ag, ar) and the display copy (b, g,
    r): cues gated by texture, judged by the scene's own colours where enough sure water
    shows these, cleaned and verified. Adds support, evidence and water.

    Also (image_id, scene_model, clusters, rejected, primary_share), one row for each image."""
    seen = scene_match(weighted_lab(support_map(px, cfg, ordered), cfg, True, evidence=EVIDENCE), cfg)
    if not ordered:  # both results read it
        seen = whole.in_order(cut(seen, "judged"))
    images = seen.groupBy("image_id").agg(F.first("_clusters").alias("clusters"), F.first("_rejected").alias("rejected"), F.first("_share").alias("primary_share"))
    images = images.select("image_id", (F.col("clusters") > 0).alias("scene_model"), F.col("clusters").cast("long"), F.col("rejected").cast("long"), "primary_share")
    judged = seen.drop("_clusters", "_rejected", "_share", "cl", "ca", "cb")
    judged = judged.withColumn("evidence", (F.col("evidence") * F.col("match")).cast("float")).drop("match")
    return clean_water(judged.withColumn("water", wet(judged, cfg)), cfg, True), images


def cue_means(px: DataFrame) -> DataFrame:
    """Mean of every cue, of support and of vegetation over an image: for diagnosis."""
    bgr = (F.col("ab"), F.col("ag"), F.col("ar"))
    cues = {"blue": colour.blue_cue(*bgr), "turbid": colour.turbid_cue(*bgr), "dark": colour.dark_cue(*bgr), "low_saturation": colour.pale_cue(*bgr), "support": F.col("support"), "vegetation": colour.vegetation(*bgr)}
    return px.groupBy("image_id").agg(*[F.avg(c).alias(name) for name, c in cues.items()])


def canopy_mask(px: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Adds canopy: rough vegetation in stands of a minimal area, less the water. Reads b, g, r and water."""
    keep = px.columns
    out = px.select("*", *[F.col(c).alias(f"_{c}") for c in "bgr"], colour.gray(F.col("b"), F.col("g"), F.col("r")).alias("_g0"))
    out = windows.gaussian(out, ["_b", "_g", "_r"], 5)
    out = windows.local_std(out, "_g0", 11, "_std")
    out = out.withColumn("_raw", colour.vegetation(F.col("_b"), F.col("_g"), F.col("_r")) * colour.ramp_up(F.col("_std"), 8, 20))
    out = windows.box_mean(out, "_raw", 15, "_dense").select(*keep, (F.col("_dense") >= cfg.canopy_threshold).alias("canopy"))
    out = windows.closed(windows.opened(out, "canopy", cfg.canopy_kernel), "canopy", cfg.canopy_kernel)
    out = whole.add(out, _stand=whole.at_least("canopy", cfg.canopy_min_area))
    return out.withColumn("canopy", F.col("_stand") & ~F.col("water")).drop("_stand")


def candidate_columns(px: DataFrame, cfg: Config = Config()) -> dict[str, whole.Added]:
    """buffer (water grown) and candidate: open land outside the buffer, cleaned."""
    canopy = "canopy" in px.columns

    def land(get) -> np.ndarray:
        dry = ~get("water") & ~get("buffer")
        return around.close(around.open_(dry & ~get("canopy") if canopy else dry, cfg.candidate_kernel), cfg.candidate_kernel)

    return {"buffer": around.dilated("water", cfg.buffer_size), "candidate": whole.Added(whole.BooleanType(), land)}


def candidate_mask(px: DataFrame, cfg: Config = Config(), ordered: bool = False) -> DataFrame:
    """Adds ``candidate_columns``. In order."""
    return whole.add(px, ordered=ordered, **candidate_columns(px, cfg))


def coverage(px: DataFrame) -> DataFrame:
    """Pixel counts and percentages of an image's masks."""
    count = in_a_run if "x0" in px.columns else lambda c: F.count_if(F.expr(c))
    n = count("true")
    counts = [count(c).alias(f"{c}_pixels") for c in ("water", "canopy", "buffer", "candidate") if c in px.columns]
    out = px.groupBy("image_id").agg(n.alias("pixels"), *counts)
    water = F.round(100.0 * F.col("water_pixels") / F.col("pixels"), 2)
    return out.withColumn("water_pct", water).withColumn("non_water_pct", F.round(100.0 - F.col("water_pct"), 2))


# --- scene colours -------------------------------------------------------------------


def weighted_lab(px: DataFrame, cfg: Config = Config(), ordered: bool = False, **more: whole.Added) -> DataFrame:
    """Adds cl, ca, cb: Lab of the softened display copy, lightness weighing less; and ``more``, in the same pass."""
    soft = whole.add(px, ordered=ordered, **{f"_{c}": around.blurred(c, 5) for c in "bgr"}, **more)
    light, a, b = colour.lab(F.col("_b"), F.col("_g"), F.col("_r"))
    return soft.select(*px.columns, *more, (cfg.scene_lightness * light).alias("cl"), a.alias("ca"), b.alias("cb"))


def _enough(mask: np.ndarray, cfg: Config) -> np.ndarray:
    """Whether an image's seeds are any, and a minimal share of it."""
    n = mask.sum(axis=(1, 2), keepdims=True)
    return (n > 0) & (n >= cfg.seed_share * mask[0].size)


def seed_counts(px: DataFrame, cfg: Config = Config(), ordered: bool = False) -> DataFrame:
    """(image_id, seeds): how many pixels of an image are sure water, where they are any and a minimal share
    of it. ``px``: the analysis copy (ab, ag, ar) and support. Pixels come back as runs of seeds and of others."""
    seed = whole.Added(whole.BooleanType(), lambda get: (get("evidence") >= np.float32(cfg.water_threshold)) & (get("support") >= cfg.seed_support))
    read = ["ab", "ag", "ar", "support"]
    rows = whole.add(px.select(*PIXEL, "w", "h", *read), runs.Packing([], ["w", "h", *read, "evidence"]), ordered, evidence=EVIDENCE, _seed=seed)
    counts = rows.groupBy("image_id").agg(in_a_run("_seed").alias("seeds"), in_a_run("true").alias("_all"))
    return counts.where((F.col("seeds") > 0) & (F.col("seeds") >= cfg.seed_share * F.col("_all"))).select("image_id", "seeds")


def scene_seeds(px: DataFrame, cfg: Config = Config(), ordered: bool = False) -> DataFrame:
    """(image_id, y, x, cl, ca, cb) of sure water: wet, and smooth around; none of images
    where that is less than a minimal share. Uses the colours of ``weighted_lab`` if ``px`` has them.
    An image's seeds follow each other, in order."""
    flagged = px.withColumn("_seed", wet(px, cfg) & (F.col("support") >= cfg.seed_support))
    enough = whole.Added(whole.BooleanType(), lambda get: np.broadcast_to(_enough(get("_seed"), cfg), get("_seed").shape))
    lab = whole.add(flagged, ordered=ordered, _enough=enough) if "cl" in px.columns else weighted_lab(flagged, cfg, ordered, _enough=enough)
    return lab.where("_seed and _enough").select(*PIXEL, "cl", "ca", "cb")


#: Seeds (times attempts) whose images are clustered together.
TOGETHER = 1 << 15


def starts(data: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ centres."""
    centres, d = [data[rng.integers(len(data))]], np.inf
    while len(centres) < k:
        d = np.minimum(d, ((data - centres[-1]) ** 2).sum(axis=1))
        centres.append(data[rng.choice(len(data), p=d / d.sum())])
    return np.array(centres)


def k_means(data: np.ndarray, sizes: np.ndarray, at: np.ndarray, rounds: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lloyd's rounds on several sets of rows that follow each other, from the centres ``at`` (sets, k, 3;
    infinite: none) until a set's centres move by less than ``least``: each set's sum of squares,
    centres, each row's cluster."""
    at, columns = at.copy(), np.ascontiguousarray(data.T)
    k = at.shape[1]

    def nearest(columns: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row the squared distance to its set's nearest centre, and that."""
        d = np.repeat(at.transpose(1, 2, 0), sizes, axis=2)  # (centres, 3, rows)
        np.subtract(columns, d, out=d)
        np.multiply(d, d, out=d)
        d = d[:, 0] + d[:, 1] + d[:, 2]
        low, own = d[0].copy(), np.zeros(d.shape[1], np.int64)
        for j in range(1, k):
            np.copyto(own, j, where=d[j] < low)
            np.minimum(low, d[j], out=low)
        return low, own

    live, left, rows = np.arange(len(sizes)), sizes, columns
    for _ in range(rounds):
        own = nearest(rows, left, at[live])[1] + np.repeat(k * np.arange(len(live)), left)
        n = np.bincount(own, minlength=k * len(live)).reshape(-1, k, 1)
        sums = np.stack([np.bincount(own, c, k * len(live)) for c in rows], axis=1).reshape(-1, k, 3)
        moved = np.where(n > 0, sums / np.maximum(n, 1), at[live])
        go = np.abs(np.subtract(moved, at[live], out=np.zeros_like(moved), where=n > 0)).max(axis=(1, 2)) >= least
        at[live] = moved
        if not go.all():
            rows, live, left = rows[:, np.repeat(go, left)], live[go], left[go]
            if not len(live):
                break
    low, own = nearest(columns, sizes, at)
    ends = np.cumsum(sizes)
    return np.array([low[e - n : e].sum() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]), at, own


def clustered(seeds: list[np.ndarray], cfg: Config = Config(), rounds: int = 50, attempts: int = 3) -> list[tuple[np.ndarray, np.ndarray, np.ndarray] | None]:
    """Centres, shares and acceptance of each image's seed colours; None where the largest cluster's share is too
    small. The best of some attempts from seeded starts counts. Images are taken together by their seeds' number."""
    out, first = [], 0
    ends = np.cumsum([attempts * len(data) for data in seeds])
    while first < len(seeds):
        part = seeds[first : max(first + 1, np.searchsorted(ends, TOGETHER + (ends[first - 1] if first else 0), "right"))]
        first += len(part)
        at = np.full((len(part), attempts, cfg.scene_clusters, 3), np.inf)
        for i, data in enumerate(part):
            rng, k = np.random.default_rng(0), cfg.scene_clusters
            if len(np.unique(data[:256], axis=0)) < k:  # few colours at the start may be few in all
                k = min(k, len(np.unique(data, axis=0)))
            for j in range(attempts):
                at[i, j, :k] = starts(data, k, rng)
        sizes = np.repeat([len(data) for data in part], attempts)
        squares, centres, own = k_means(np.concatenate([data for data in part for _ in range(attempts)]), sizes, at.reshape(-1, *at.shape[2:]), rounds, 0.2)
        end = np.cumsum(sizes)
        for i in range(0, len(sizes), attempts):
            best = i + int(squares[i : i + attempts].argmin())
            there = np.isfinite(centres[best, :, 0])
            share = np.bincount(own[end[best] - sizes[best] : end[best]], minlength=there.sum()) / sizes[best]
            c = centres[best][there]
            out.append((c, share, accepted_clusters(c, share, cfg)) if share.max() >= cfg.scene_primary_share else None)
    return out


def scene_clusters(seeds: DataFrame, cfg: Config = Config(), rounds: int = 50, attempts: int = 3, ordered: bool = False) -> DataFrame:
    """k-means of an image's seed colours (cl, ca, cb): centres, shares, acceptance. No rows
    for images whose largest cluster has too small a share.

    ``seeds``: image_id, y, x, cl, ca, cb. A hash picks at most ``scene_samples`` of an
    image's (at most a million) pixels. ``ordered``: an image's seeds follow each other, as those of ``scene_seeds`` do."""
    hashed = seeds.withColumn("_h", F.xxhash64("y", "x"))

    def cluster(table: pa.Table) -> pa.Table:
        bounds, out = whole.groups(table.column("image_id")), []
        data = np.stack([table.column(c).to_numpy().astype(float) for c in ("cl", "ca", "cb")], axis=1)
        y, x, h = (table.column(c).to_numpy() for c in ("y", "x", "_h"))
        drawn = [start + np.lexsort((x[start:end], y[start:end], h[start:end]))[: cfg.scene_samples] for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for start, found in zip(bounds[:-1].tolist(), clustered([data[d] for d in drawn], cfg, rounds, attempts), strict=True):
            if found:
                centres, share, taken = found
                out += [(table.column("image_id")[start].as_py(), c, *centres[c].tolist(), float(share[c]), bool(taken[c])) for c in range(len(share))]
        names = ["image_id", "c", "cl", "ca", "cb", "share", "accepted"]
        types = [table.schema.field("image_id").type, pa.int32(), *[pa.float64()] * 4, pa.bool_()]
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    kind = seeds.schema["image_id"].dataType.simpleString()
    return whole.stream(hashed, ["y", "x"], cluster, f"image_id {kind}, c int, cl double, ca double, cb double, share double, accepted boolean", ordered=ordered)


def accepted(clusters: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Adds accepted to given clusters (image_id, c, cl, ca, cb, n), a few an image."""
    out = clusters.withColumn("accepted", F.lit(False))

    def judge(table: pa.Table) -> pa.Table:
        bounds = whole.groups(table.column("image_id"))
        centres = np.stack([table.column(c).to_numpy().astype(float) for c in ("cl", "ca", "cb")], axis=1)
        n = table.column("n").to_numpy()
        parts = [accepted_clusters(centres[a:b], n[a:b], cfg) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        return table.set_column(table.schema.get_field_index("accepted"), "accepted", pa.array(np.concatenate(parts)))

    return whole.stream(out, ["c"], judge, out.schema)


def accepted_clusters(centres: np.ndarray, share: np.ndarray, cfg: Config = Config()) -> np.ndarray:
    """Clusters of the scene's water: the largest; and, to a fixpoint, whatever has the hue
    of an accepted one and is not much lighter than the largest, or is clearly blue."""
    first = int(share.argmax())
    taken = np.arange(len(share)) == first
    light = centres[:, 0] / cfg.scene_lightness
    while True:
        near = np.hypot(centres[:, None, 1] - centres[None, taken, 1], centres[:, None, 2] - centres[None, taken, 2]).min(axis=1) <= cfg.scene_hue_gap
        more = taken | (near & (light <= light[first] + cfg.scene_lighter)) | (centres[:, 2] <= cfg.scene_blue)
        if (more == taken).all():
            return taken
        taken = more


def scene_match(px: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Adds match: 1 near accepted colours of the scene's clusters, 0 near rejected ones (1 without any
    rejected); and the clusters' number, that of rejected ones, and the largest's share. ``px``: in
    order, with evidence, support and the colours of ``weighted_lab``."""
    lab = ("cl", "ca", "cb")

    def scene(get) -> np.ndarray:
        """Of every pixel: distance to accepted and to rejected centres, clusters, rejected, share."""
        seed, h = get("_seed"), get("_h")
        colours = np.stack([get(c) for c in lab], axis=-1)
        enough = _enough(seed, cfg)[:, 0, 0]
        out = np.full((*seed.shape, 5), np.nan)
        out[..., 2:4] = 0
        data = colours.reshape(len(seed), -1, 3)

        def drawn(i: int) -> np.ndarray:
            at = np.flatnonzero(seed[i])
            return data[i][at[np.argsort(h[i].flat[at], kind="stable")][: cfg.scene_samples]]

        chosen = np.flatnonzero(enough).tolist()
        for i, found in zip(chosen, clustered([drawn(i) for i in chosen], cfg), strict=True):
            if found:
                centres, share, taken = found
                for j, which in enumerate((centres[taken], centres[~taken])):
                    if len(which):
                        d2 = [(data[i, :, 0] - c[0]) ** 2 + (data[i, :, 1] - c[1]) ** 2 + (data[i, :, 2] - c[2]) ** 2 for c in which]
                        out[i, ..., j] = np.sqrt(np.min(d2, axis=0)).reshape(seed[i].shape)
                out[i, ..., 2:] = len(share), (~taken).sum(), share.max()
        return out

    held: dict[int, np.ndarray] = {}

    def part(j: int) -> whole.Added:
        def values(get):
            if not j:
                held[0] = scene(get)
            v = held[0][..., j]
            return np.nan_to_num(v), np.isnan(v)

        return whole.Added(whole.DoubleType(), values)

    flagged = px.select("*", (wet(px, cfg) & (F.col("support") >= cfg.seed_support)).alias("_seed"), F.xxhash64("y", "x").alias("_h"))
    seen = whole.add(flagged, ordered=True, without=["_seed", "_h"], _yes=part(0), _no=part(1), _clusters=part(2), _rejected=part(3), _share=part(4))
    soft = cfg.scene_softness
    match = F.greatest(colour.ramp_up(F.col("_no") - F.col("_yes"), -soft, soft), colour.ramp_down(F.col("cb"), cfg.scene_blue - 4, cfg.scene_blue + 4))
    return seen.withColumn("match", F.when(F.col("_no").isNotNull(), match).otherwise(F.lit(1.0))).drop("_yes", "_no")


def closest(centres: Column) -> Column:
    """The nearest of an array of centres to a pixel's cl, ca, cb: (d2, at), the first of equals."""
    square = lambda c, name: (F.col(name) - c[name]) * (F.col(name) - c[name])
    return F.array_min(F.transform(centres, lambda c, i: F.struct((square(c, "cl") + square(c, "ca") + square(c, "cb")).alias("d2"), i.alias("at"))))


# --- regions -------------------------------------------------------------------------


def zoned_rows(px: DataFrame, cfg: Config = Config(), ordered: bool = False) -> DataFrame:
    """Adds to candidate, buffer and water (the first two made in the same pass if ``px`` has none) what
    regions, circles and drop points read: label (of the candidate component), its perimeter, _clear
    (distance to the nearest pixel that is no candidate), _free2 (squared, the buffer counting as none)
    and _wd (to water). Stored as runs."""
    return in_runs(px, "zoned", ZONED, ["_valid"], ordered, **_zone_columns(px, cfg, ZONED))


def _zone_columns(px: DataFrame, cfg: Config, each: list[str]) -> dict[str, whole.Added]:
    """Label and perimeter of the candidate components, the first two columns if ``px`` has none, and those of ``each``."""
    before = {} if "candidate" in px.columns else candidate_columns(px, cfg)
    far = {
        "_clear": whole.clearance("candidate", padded=True, metric=cfg.metric), "_free2": whole.squared("_valid", padded=True), "_wd": whole.distance_to("water", cfg.metric),
    }
    valid = {"_valid": whole.Added(whole.BooleanType(), lambda get: get("candidate") & ~get("buffer"))} if "_free2" in each else {}
    return {**before, **valid, "label": whole.labels("candidate"), "perimeter": whole.perimeters("candidate", cfg.candidate_min_area), **{c: far[c] for c in each}}


def zone_rows(px: DataFrame, cfg: Config = Config(), ordered: bool = False, keep: tuple[str, ...] = (), each: tuple[str, ...] = ()) -> DataFrame:
    """What ``regions`` reads of ``zoned_rows``: of each run its point of most clearance, and no distances of pixels
    but those in ``each``. Runs are of one label and of one value of each column in ``keep`` (of water, canopy,
    buffer, candidate). Not stored."""
    made = _zone_columns(px, cfg, [*dict.fromkeys(("_clear", "_wd", *each))])
    masks = [c for c in ("water", "canopy", "buffer", "candidate") if c not in keep]
    return whole.add(px, runs.Packing(each, ["_valid", *masks], ("_clear", "_wd")), ordered, **made)


#: What differs from pixel to pixel in ``zoned_rows``.
ZONED = ["_clear", "_free2", "_wd"]


def zoned(px: DataFrame, cfg: Config = Config(), ordered: bool = False) -> DataFrame:
    """``zoned_rows`` as pixels."""
    return runs.unpacked(zoned_rows(px, cfg, ordered), ZONED)


def regions(zoned_: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Candidate regions: size, box, the point of most clearance, water distance, openness."""
    run = ("image_id", "y", "x0", "x1", "w", "h", "label", "perimeter")
    if "_top" in zoned_.columns:
        rows = zoned_.select(*run, "_top", "_at", F.col("_top_wd").alias("_wd"))
    else:
        rows = topmost(as_runs(zoned_, "_clear", "_wd").select(*run, "_clear", "_wd"), "_clear", "_wd")
    rows = rows.where("label is not null")
    at = F.max_by(F.struct(F.col("_at").alias("x"), "y", F.col("_top").alias("_clear"), "_wd"), F.struct(F.col("_top"), -F.col("y"), -F.col("_at"))).alias("p")
    out = runs.stats(rows, at, F.first("perimeter").alias("perimeter"), F.first("w").alias("w"), F.first("h").alias("h")).where(F.col("area") >= cfg.candidate_min_area)
    out = out.withColumn("_c", F.col("p._clear")).where(F.col("_c") >= cfg.min_clearance)
    # clearance is rounded before openness is derived from it
    open_ = scores.openness(F.round("_c", 2), F.col("area"), F.col("perimeter"), F.col("width"), F.col("height"))
    return out.select(
        "image_id", rank([F.col("label")], "region_id"), "label", "area", "left", "top", "width", "height",
        F.round("cx", 4).alias("cx"), F.round("cy", 4).alias("cy"), F.col("p.x").alias("drop_x"), F.col("p.y").alias("drop_y"),
        F.round("_c", 2).alias("clearance"), F.round("p._wd", 2).alias("water_clearance"), "perimeter", F.round(open_, 4).alias("openness"), (F.col("w") * F.col("h")).alias("image_area"),
    )


def scored(regions_: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Scores of regions; ranking uses the rounded score, the class the exact one."""
    a = scores.area_score(F.col("area"), F.col("image_area"), cfg.area_full_share)
    c = scores.clearance_score(F.col("water_clearance"), cfg.clearance_full)
    o = 100.0 * F.col("openness")
    final = scores.final_score(a, c, o)
    return regions_.select("*", F.round(a, 1).alias("area_score"), F.round(c, 1).alias("water_score"), F.round(o, 1).alias("openness_score"), F.round(final, 1).alias("final_score"), scores.classify_zone(final).alias("classification"))


def zone_contours(zones: DataFrame, zoned_: DataFrame) -> DataFrame:
    """(image_id, zone_id, label, points): the outer border of each zone's component, in order."""
    rows = as_runs(zoned_).select("image_id", "label", "y", "x0", "x1").where("label is not null")
    found = whole.borders(rows.hint("merge").join(zones.select("image_id", "zone_id", "label"), ["image_id", "label"]), "label", "zone_id")
    return found.select("image_id", "zone_id", "label", "points")


def top_zones(scored_: DataFrame, cfg: Config = Config()) -> DataFrame:
    return scored_.select("*", rank([F.desc("final_score"), F.col("label")], "zone_id")).where(F.col("zone_id") <= cfg.max_zones)


def isolated_regions(px: DataFrame, cfg: Config = Config(), ordered: bool = False) -> DataFrame:
    """Land cut off from the largest land region, most isolated first."""
    sides = {"_above": (-1, 0), "_below": (1, 0), "_left": (0, -1), "_right": (0, 1)}

    def off_main(get) -> np.ndarray:
        found = get("label")
        return (found != whole.largest(found)) | (found < 0)

    def beside(dy: int, dx: int) -> whole.Added:
        def values(get):
            near = around.shifted(get("label"), dy, dx, -1)
            return near, near < 0

        return whole.Added(whole.LongType(), values)

    # stretches of a line that have one label and the same neighbours
    land = whole.add(
        px.select(*PIXEL, "w", "h", "water"), runs.Packing(["_far"], ["_land", "_off", "w", "h"]), ordered, _land=whole.Added(whole.BooleanType(), lambda get: ~get("water")), label=whole.labels("_land"), _off=whole.Added(whole.BooleanType(), off_main),
        _far=whole.clearance("_off", padded=False, metric=cfg.metric), **{name: beside(*d) for name, d in sides.items()},
    )
    # each pixel counts for its own component, and for the ring of each other one that is beside it
    own = F.array(F.struct("label", F.lit(True).alias("own")))
    others = F.array_distinct(F.filter(F.array(*sides), lambda v: v.isNotNull() & ~v.eqNullSafe(F.col("label"))))
    ring = F.transform(others, lambda v: F.struct(v.alias("label"), F.lit(False).alias("own")))
    inner = " and ".join(f"({c} is null or {c} <=> label)" for c in sides)
    run = ("image_id", "y", "x0", "x1", "water", "_near")
    parts = land.withColumn("_near", F.array_min("_far")).select(*run, F.explode(F.when(F.expr(inner), own).otherwise(F.concat(own, ring))).alias("_p")).select(*run, "_p.label", "_p.own").where("label is not null")
    mine = lambda c: F.when(F.col("own"), F.col(c))
    stat = parts.groupBy("image_id", "label").agg(
        in_a_run("own").alias("area"), F.min(mine("x0")).alias("left"), F.min(mine("y")).alias("top"), (F.max(mine("x1")) - F.min(mine("x0")) + 1).alias("width"), (F.max(mine("y")) - F.min(mine("y")) + 1).alias("height"),
        F.sum(F.expr("case when own then cast(x0 + x1 as long) * (x1 - x0 + 1) end")).alias("_sx"), F.sum(F.expr("case when own then cast(y as long) * (x1 - x0 + 1) end")).alias("_sy"), F.min(mine("_near")).alias("_gap"),
        in_a_run("not own").alias("_ring"), in_a_run("not own and water").alias("_wet"),
    )
    stat = stat.select("*", (F.col("_sx") / (2.0 * F.col("area"))).alias("cx"), (F.col("_sy") / F.col("area").cast("double")).alias("cy"))
    image = Window.partitionBy("image_id")
    main = F.max_by("label", F.struct(F.col("area"), -F.col("label"))).over(image)
    out = stat.select("*", main.alias("main"), F.max("area").over(image).alias("main_area"), F.count("*").over(image).alias("lands"))
    out = out.where((F.col("lands") > 1) & (F.col("label") != F.col("main")) & (F.col("area") >= cfg.isolated_min_area) & (F.col("_ring") > 0))
    touch = F.col("_wet") / F.col("_ring")
    apart = F.col("_gap")
    share = F.col("area") / F.greatest(F.lit(1), F.col("main_area"))
    score = scores.isolation_score(touch, apart, share, cfg.separation_full)
    out = out.withColumn("isolation_score", F.round(score, 1))
    return out.select(
        "image_id", rank([F.desc("isolation_score"), F.col("label")], "region_id"), "label", "area", "left", "top", "width", "height", F.round("cx", 1).alias("cx"), F.round("cy", 1).alias("cy"),
        F.round(touch, 4).alias("water_contact"), F.round(apart, 2).alias("separation"), F.round(1.0 - F.least(F.lit(1.0), share), 4).alias("relative_size"),
        "isolation_score", scores.classify_isolation(score).alias("classification"),
    )


def band_rows(px: DataFrame, cfg: Config = Config(), ordered: bool = False) -> DataFrame:
    """Adds _wd, shoreline and band: open land between the margins around water, opened, in
    parts of a minimal area; label and _in (distance to the band's edge) of these. Stored as runs."""

    def shore(get) -> np.ndarray:
        return _any_water(get) & ~get("water") & (get("_wd") > cfg.supply_inner) & (get("_wd") <= cfg.supply_outer)

    mask = lambda f: whole.Added(whole.BooleanType(), f)
    return in_runs(
        px, "band", BAND, ["_band"], ordered, _wd=whole.distance_to("water", cfg.metric), shoreline=mask(shore), _band=mask(lambda get: around.open_(get("shoreline") & ~get("canopy"), 3)),
        band=whole.at_least("_band", cfg.supply_min_area), label=whole.labels("band"), _in=whole.clearance("band", padded=True, metric=cfg.metric),
    )


#: What differs from pixel to pixel in ``band_rows``.
BAND = ["_wd", "_in"]


def supply_band(px: DataFrame, cfg: Config = Config(), ordered: bool = False) -> DataFrame:
    """``band_rows`` as pixels."""
    return runs.unpacked(band_rows(px, cfg, ordered), BAND)


def _any_water(get) -> np.ndarray:
    water = get("water")
    return np.broadcast_to(water.any(axis=(1, 2), keepdims=True), water.shape)


def band_totals(band: DataFrame) -> DataFrame:
    """Pixels of an image's shoreline, of the canopy left out of it, and of the band."""
    return as_runs(band).groupBy("image_id").agg(in_a_run("shoreline").alias("shoreline_pixels"), in_a_run("shoreline and canopy").alias("canopy_excluded"), in_a_run("band").alias("band_pixels"))


def supply_segments(band: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Parts of the band, largest first, each with the point deepest inside."""
    rows = topmost(as_runs(band, "_in").select("image_id", "y", "x0", "x1", "label", "_in").where("label is not null"), "_in")
    out = runs.stats(rows, F.max_by(F.struct(F.col("_at").alias("x"), "y"), F.struct(F.col("_top"), -F.col("y"), -F.col("_at"))).alias("p"))
    return out.select("image_id", rank([F.desc("area"), F.col("label")], "segment_id"), "label", "area", "left", "top", "width", "height", F.round("cx", 4).alias("cx"), F.round("cy", 4).alias("cy"), F.col("p.x").alias("anchor_x"), F.col("p.y").alias("anchor_y"))


# --- sensor zones --------------------------------------------------------------------


def sensor_zones(zones: DataFrame, zoned_: DataFrame, cfg: Config = Config()) -> DataFrame:
    """The largest valid circle around each zone's point, what limits it, or why there is none.

    ``zones``: image_id, zone_id, drop_x, drop_y, label (of the candidate component)."""
    known = "water_clearance" in zones.columns  # as regions tell it of their points
    first = Window.partitionBy("image_id", "drop_x", "drop_y").orderBy("zone_id")
    z = zones.select("image_id", "zone_id", F.col("drop_x").alias("cx"), F.col("drop_y").alias("cy"), "label", F.row_number().over(first).alias("_nth"), *(["water_clearance"] if known else []))
    state = (zoned_ if known and "x0" in zoned_.columns else as_runs(zoned_, "_wd")).select("image_id", "y", "x0", "x1", "w", "h", "buffer", *([] if known else ["_wd"]), F.col("label").alias("own"))
    reach = cfg.max_radius + cfg.safety_margin + 1
    # only runs within reach of a centre take part; of a run, its nearest pixel. Zones and runs both
    # grow with the images: neither is sent to every task
    near = state.hint("merge").join(z, "image_id").withColumn("x", F.least(F.greatest("x0", "cx"), "x1")).where((F.abs(F.col("x") - F.col("cx")) <= reach) & (F.abs(F.col("y") - F.col("cy")) <= reach))
    valid = F.coalesce((F.col("own") == F.col("label")) & ~F.col("buffer"), F.lit(False))
    d2 = (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))
    bad = F.when(~valid, F.struct(d2.alias("d2"), F.col("y").alias("y"), F.col("x").alias("x"), F.col("buffer").alias("buffer")))
    wet_ = F.col("water_clearance") if known else F.when((F.col("x") == F.col("cx")) & (F.col("y") == F.col("cy")), F.get("_wd", F.col("cx") - F.col("x0")))
    near = near.select("image_id", "zone_id", "cx", "cy", "_nth", "w", "h", bad.alias("bad"), wet_.alias("_wet"))
    limit = near.groupBy("image_id", "zone_id", "cx", "cy", "_nth", "w", "h").agg(F.min("bad").alias("bad"), F.round(F.max("_wet"), 2).alias("water_clearance"))
    border = F.least("cx", "cy", F.col("w") - 1 - F.col("cx"), F.col("h") - 1 - F.col("cy")) + 1
    free = F.sqrt(F.col("bad.d2").cast("double"))
    at_border = F.coalesce(border < free, F.lit(True))
    gap = F.when(at_border, border.cast("double")).otherwise(free)
    sides = F.array(
        F.struct((F.col("cx") + 1).alias("d"), F.lit(0).alias("k"), F.lit(0).alias("x"), F.col("cy").alias("y")),
        F.struct((F.col("cy") + 1).alias("d"), F.lit(1).alias("k"), F.col("cx").alias("x"), F.lit(0).alias("y")),
        F.struct((F.col("w") - F.col("cx")).alias("d"), F.lit(2).alias("k"), (F.col("w") - 1).alias("x"), F.col("cy").alias("y")),
        F.struct((F.col("h") - F.col("cy")).alias("d"), F.lit(3).alias("k"), F.col("cx").alias("x"), (F.col("h") - 1).alias("y")),
    )
    raw = F.ceil(gap).cast("int") - 1 - cfg.safety_margin
    radius = F.greatest(F.lit(0), F.least(raw, F.lit(cfg.max_radius)))
    capped = raw > cfg.max_radius
    side = F.array_min(sides)
    inside = F.coalesce(F.col("bad.d2") > 0, F.lit(True))
    factor = F.when(~inside, "center_invalid").when(capped, "max_radius").when(at_border, "image_boundary").when(F.col("bad.buffer"), "water_buffer").otherwise("candidate_boundary")
    reason = F.when(F.col("_nth") > 1, "duplicate_center").when(~inside, "center_in_excluded_area").when(radius < cfg.min_radius, "radius_below_minimum")
    return limit.select(
        "image_id", "zone_id", "cx", "cy", F.when(inside, radius).otherwise(F.lit(0)).alias("radius"), factor.alias("limiting_factor"),
        F.round(F.when(inside, gap).otherwise(F.lit(0.0)), 2).alias("limiting_distance"),
        F.when(capped & inside, F.lit(None)).when(at_border & inside, side["x"]).otherwise(F.col("bad.x")).cast("int").alias("limit_x"),
        F.when(capped & inside, F.lit(None)).when(at_border & inside, side["y"]).otherwise(F.col("bad.y")).cast("int").alias("limit_y"),
        "water_clearance", reason.alias("not_viable"),
    )


def disks_valid(circles: DataFrame, zoned_: DataFrame) -> DataFrame:
    """(image_id, zone_id, disk_pixels, valid_pixels, all_valid): whether every pixel of each
    viable circle is in the image, in the zone's component and outside the buffer.

    ``circles``: image_id, zone_id, cx, cy, radius, label; a few an image."""
    r = F.col("radius")
    line = lambda dy: (2 * F.floor(F.sqrt((r * r - dy * dy).cast("double"))) + 1).cast("long")
    size = F.aggregate(F.sequence(-r, r), F.lit(0).cast("long"), lambda total, dy: total + line(dy))
    state = as_runs(zoned_).select("image_id", "y", "x0", "x1", "buffer", F.col("label").alias("own"))
    dy = F.col("y") - F.col("cy")
    inside = state.hint("merge").join(circles, "image_id").where(F.abs(dy) <= r)
    half = F.floor(F.sqrt((r * r - dy * dy).cast("double")))
    n = F.greatest(F.least(F.col("x1"), F.col("cx") + half) - F.greatest(F.col("x0"), F.col("cx") - half) + 1, F.lit(0))
    inside = inside.select("image_id", "zone_id", "radius", n.alias("_n"), F.coalesce((F.col("own") == F.col("label")) & ~F.col("buffer"), F.lit(False)).alias("_ok")).where("_n > 0")
    good = F.sum(F.when(F.col("_ok"), F.col("_n")).otherwise(0)).cast("long")
    out = inside.groupBy("image_id", "zone_id", "radius").agg(good.alias("valid_pixels")).withColumn("disk_pixels", size)
    return out.select("image_id", "zone_id", "disk_pixels", "valid_pixels", (F.col("disk_pixels") == F.col("valid_pixels")).alias("all_valid"))


def ring_radii(radius: Column, step: int, clearance: int, margin: int) -> Column:
    """Radii of the sampling rings, widest first, without repeats."""
    top = F.least(radius - 1, radius + margin - clearance)
    rest = F.when(top >= step, F.sequence(top, F.lit(step), F.lit(-step))).otherwise(F.array().cast("array<int>"))
    outer = F.when(radius - 1 >= step, F.array(radius - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_union(outer, rest)


def ring_samples(zones: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Distinct sample points on the rings of viable sensor zones: ring, index, x, y."""
    step = max(cfg.drop_step, 2 * cfg.drop_clearance)
    rings = zones.where("not_viable is null").select("image_id", "zone_id", "cx", "cy", "radius", F.posexplode(ring_radii(F.col("radius"), step, cfg.drop_clearance, cfg.safety_margin)).alias("ring", "r"))
    n = F.greatest(F.lit(6), F.floor(2 * math.pi * F.col("r") / step).cast("int"))
    points = rings.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    angle = 2 * math.pi * F.col("i") / F.col("n") + F.when(F.col("ring") % 2 == 1, math.pi / F.col("n")).otherwise(0.0)
    x, y = F.bround(F.col("cx") + F.col("r") * F.cos(angle)).cast("int"), F.bround(F.col("cy") + F.col("r") * F.sin(angle)).cast("int")
    out = points.select("image_id", "zone_id", "cx", "cy", "radius", "ring", F.col("i").alias("index"), x.alias("x"), y.alias("y"))
    return out.withColumn("_n", rank([F.col("ring"), F.col("index")], "_n", "image_id", "zone_id", "x", "y")).where("_n = 1").drop("_n")


def drop_samples(samples: DataFrame, zones: DataFrame, zoned_: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Samples with the first reason against them, or their scores.

    Of a zone's pixels the nearest that is not valid there is never one of another
    component, since these are apart; so one distance serves all zones of an image."""
    label = zones.select("image_id", "zone_id", F.col("label").alias("_label"))
    state = as_runs(zoned_, "_free2", "_wd").select("image_id", "y", "x0", "x1", "w", "water", "buffer", F.col("label").alias("own"), "_free2", "_wd")
    state = state.withColumnsRenamed({"image_id": "_image", "y": "_line"})
    mine = (F.col("image_id") == F.col("_image")) & (F.col("y") == F.col("_line")) & F.col("x").between(F.col("x0"), F.col("x1"))
    joined = samples.join(label, ["image_id", "zone_id"]).join(state.hint("merge"), mine, "left")
    joined = joined.withColumns({c: F.get(c, F.col("x") - F.col("x0")) for c in ("_free2", "_wd")})
    inside = F.coalesce(F.col("own") == F.col("_label"), F.lit(False))
    away = F.sqrt(((F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))).cast("double"))
    clear = F.sqrt(F.col("_free2").cast("double"))
    reason = (
        F.when(F.col("w").isNull(), "outside_image").when(away > F.col("radius"), "outside_storage_zone").when(F.col("water"), "water").when(F.col("buffer"), "water_buffer")
        .when(~inside, "outside_candidate_region").when(clear < cfg.drop_clearance, "insufficient_clearance")
    )
    parts = scores.drop_parts(clear, F.col("_wd"), away, F.col("radius"), cfg.clearance_full)
    score = F.round(scores.drop_score(*parts), 1)
    named = zip(("clearance_score", "water_clearance_score", "proximity_score"), parts, strict=True)
    return joined.select(
        "image_id", "zone_id", "cx", "cy", "ring", "index", "x", "y", reason.alias("reason"), F.when(reason.isNull(), score).alias("score"),
        F.round(clear, 2).alias("clearance"), F.round("_wd", 2).alias("water_clearance"), F.round(away, 2).alias("distance"), *[F.round(100.0 * p, 1).alias(n) for n, p in named],
    )


def spaced(samples: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Greedy choice by score of points at least a step from the centre and each other, at
    most ``drop_max`` a zone; a zone's samples are bounded by its radius."""
    step, most = max(cfg.drop_step, 2 * cfg.drop_clearance), cfg.drop_max
    good = samples.where("reason is null").drop("reason").withColumn("drop_id", F.lit(0))

    def choose(table: pa.Table) -> pa.Table:
        x, y, cx, cy = (table.column(c).to_numpy() for c in ("x", "y", "cx", "cy"))
        number = np.zeros(table.num_rows, np.int32)
        bounds = whole.groups(table.column("image_id"), table.column("zone_id"))
        for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            taken = [(cx[start], cy[start])]
            for i in range(start, end):
                if len(taken) <= most and all(math.hypot(x[i] - a, y[i] - b) >= step for a, b in taken):
                    number[i] = len(taken)
                    taken.append((x[i], y[i]))
        at = table.schema.get_field_index("drop_id")
        return table.set_column(at, "drop_id", pa.array(number)).filter(pa.array(number > 0))

    out = whole.stream(good, ["zone_id", F.desc("score"), "ring", "index"], choose, good.schema)
    return out.select("image_id", "zone_id", "drop_id", "x", "y", "score", scores.classify_zone(F.col("score")).alias("classification"), "clearance", "water_clearance", "distance", "clearance_score", "water_clearance_score", "proximity_score")
