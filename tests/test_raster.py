"""Raster operators against brute force and the published behaviour of the analysis."""

import math
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pixelloom.config import Config, mini
from pixelloom.functions import colour, scores
from pixelloom.operators import components as cc
from pixelloom.operators import detect, stages, whole, windows
from pixelloom.plans import analysis
from pixelloom.sources import images, views

CFG = Config()


def frame(spark, **masks):
    """A pixel table of equally large arrays, all of image 1."""
    h, w = next(iter(masks.values())).shape
    y, x = np.divmod(np.arange(h * w), w)
    data = {"image_id": 1, "y": y, "x": x, "w": w, "h": h} | {k: np.asarray(v).ravel() for k, v in masks.items()}
    df = spark.createDataFrame(pd.DataFrame(data))
    return df.select(*[F.col(c).cast("int").alias(c) if c in "yxwh" else F.col(c) for c in df.columns])


def array(df, col, shape, kind=bool):
    out = np.zeros(shape, kind)
    for r in df.select("y", "x", col).collect():
        out[r.y, r.x] = r[col] if r[col] is not None else -1
    return out


def disc(h, w, cx, cy, r):
    y, x = np.mgrid[:h, :w]
    return (x - cx) ** 2 + (y - cy) ** 2 <= r * r


def brute_labels(mask):
    out = -np.ones(mask.shape, int)
    for y, x in zip(*np.nonzero(mask), strict=True):
        if out[y, x] >= 0:
            continue
        todo, out[y, x] = [(y, x)], y * whole.LINE + x
        while todo:
            a, b = todo.pop()
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    p, q = a + dy, b + dx
                    if 0 <= p < mask.shape[0] and 0 <= q < mask.shape[1] and mask[p, q] and out[p, q] < 0:
                        out[p, q] = y * whole.LINE + x
                        todo.append((p, q))
    return out


@pytest.mark.parametrize("share", [0.3, 0.5, 0.7])
def test_components(spark, share):
    mask = np.random.default_rng(int(share * 10)).random((40, 33)) < share
    got = cc.labelled(frame(spark, m=mask), "m").persist()
    want = brute_labels(mask)
    assert {(r.y, r.x): r.label for r in got.where("label is not null").collect()} == {(y, x): want[y, x] for y, x in zip(*np.nonzero(mask), strict=True)}
    stat = {r.label: r for r in cc.stats(got).collect()}
    got.unpersist()
    for label in np.unique(want[want >= 0]):
        y, x = np.nonzero(want == label)
        s = stat[label]
        assert (s.area, s.left, s.top, s.width, s.height) == (len(y), x.min(), y.min(), np.ptp(x) + 1, np.ptp(y) + 1)
        assert math.isclose(s.cx, x.mean()) and math.isclose(s.cy, y.mean())


def walked(mask):
    """Length of the outer boundary, walked pixel by pixel with the background on the left."""
    steps = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))  # clockwise from the east
    inside = set(zip(*(a.tolist() for a in np.nonzero(mask)), strict=True))
    at, heading, length, first = min(inside), 0, 0.0, None
    while True:
        for turn in range(8):
            d = (heading + 6 + turn) % 8
            nxt = (at[0] + steps[d][0], at[1] + steps[d][1])
            if nxt in inside:
                break
        else:
            return 0.0
        if first is None:
            first = (at, d)
        elif (at, d) == first:
            return length
        length += 1.0 if d % 2 == 0 else 2**0.5
        at, heading = nxt, d


def test_perimeters(spark):
    mask = np.zeros((12, 30), bool)
    mask[1, 1] = mask[3:6, 3:7] = True
    mask[9, 2:9] = True  # a line is walked there and back
    mask[2:5, 20:23] = True
    mask[3, 21] = False  # a hole does not count
    rows = whole.add(frame(spark, m=mask), p=whole.perimeters("m")).where("p is not null").select("y", "x", "p").collect()
    got = {(r.y, r.x): r.p for r in rows}
    assert (got[1, 1], got[3, 3], got[9, 5], got[4, 22]) == (0.0, 10.0, 12.0, 8.0) and len(got) == mask.sum()


def test_outlines_are_the_walk():
    rng = np.random.default_rng(8)
    for share in (0.3, 0.45, 0.6, 0.8):
        for _ in range(40):
            found = whole.label((rng.random((9, 11)) < share)[None])[0]
            for number in np.unique(found[found >= 0]):
                part = found == number
                assert math.isclose(whole.outline_length(part), walked(part), abs_tol=1e-9)


def test_four_neighbours():
    mask = np.array([[1, 0, 1], [0, 1, 0], [1, 1, 0]], bool)
    assert whole.label(mask[None], reach=0)[0].tolist() == [[0, -1, 2], [-1, 4, -1], [4, 4, -1]]
    assert whole.label(mask[None], reach=1)[0].tolist() == [[0, -1, 0], [-1, 0, -1], [0, 0, -1]]


def test_images_must_be_whole(spark):
    px = frame(spark, m=np.ones((3, 4), bool)).where("not (y = 1 and x = 2)")
    with pytest.raises(Exception, match="full rectangle"):
        whole.add(px, label=whole.labels("m")).collect()


def test_images_of_all_shapes_at_once(spark):
    rng = np.random.default_rng(2)
    masks = {i: rng.random((rng.integers(1, 9), rng.integers(1, 12))) < 0.5 for i in range(30)}
    px = frame(spark, m=masks[0]).where("false")
    for i, m in masks.items():
        px = px.union(frame(spark, m=m).withColumn("image_id", F.lit(i)))
    out = whole.add(px, label=whole.labels("m"), d=whole.squared("m", padded=True)).groupBy("image_id").agg(F.count_distinct("label").alias("n"), F.sum("d").alias("d"))
    got = {r.image_id: (r.n, r.d) for r in out.collect()}
    for i, m in masks.items():
        labels = brute_labels(m)
        zy, zx = np.nonzero(~np.pad(m, 1, constant_values=False))
        y, x = np.nonzero(np.ones(m.shape))
        d = ((y[:, None] + 1 - zy) ** 2 + (x[:, None] + 1 - zx) ** 2).min(axis=1)
        assert got[i] == (len(np.unique(labels[labels >= 0])), d.sum())


@pytest.mark.parametrize("padded", [True, False])
def test_distance(spark, padded):
    mask = np.random.default_rng(7).random((23, 31)) < 0.93
    got = array(whole.add(frame(spark, m=mask), d=whole.squared("m", padded)), "d", mask.shape, int)
    big = np.pad(mask, 1, constant_values=not padded)
    zy, zx = np.nonzero(~big)
    y, x = np.mgrid[1:24, 1:32]
    want = ((y[..., None] - zy) ** 2 + (x[..., None] - zx) ** 2).min(axis=2)
    assert (got == want).all()


def test_distance_without_water(spark):
    out = whole.add(frame(spark, water=np.zeros((6, 8), bool)), d=whole.distance_to("water"))
    assert {r.d for r in out.collect()} == {10.0}


@pytest.mark.parametrize("k", [3, 5, 7])
def test_morphology(spark, k):
    mask = np.random.default_rng(k).random((20, 25)) < 0.2
    widths = windows.ellipse(k)
    r = k // 2
    want = np.zeros_like(mask)
    for y, x in np.ndindex(mask.shape):
        want[y, x] = any(mask[y + dy, x + dx] for dy in range(-r, r + 1) for dx in range(-widths[dy + r], widths[dy + r] + 1) if 0 <= y + dy < 20 and 0 <= x + dx < 25)
    df = frame(spark, m=mask)
    assert (array(windows.dilate(df, "m", k), "m", mask.shape) == want).all()
    assert (array(windows.erode(df.withColumn("m", ~F.col("m")), "m", k), "m", mask.shape) == ~want).all()


def test_filters_mirror_the_edge(spark):
    v = np.random.default_rng(1).integers(0, 255, (17, 19))
    big = np.pad(v, 4, mode="reflect").astype(float)
    df = frame(spark, v=v)
    got = array(windows.local_std(windows.box_mean(df, "v", 9, "m"), "v", 9, "s").withColumn("m", F.round("m", 6)), "m", v.shape, float)
    std = array(windows.local_std(df, "v", 9, "s"), "s", v.shape, float)
    for y, x in np.ndindex(v.shape):
        part = big[y : y + 9, x : x + 9]
        assert math.isclose(got[y, x], part.mean(), abs_tol=1e-5) and math.isclose(std[y, x], part.std(), abs_tol=1e-6)


def test_edges(spark):
    v = np.zeros((20, 20), int)
    v[:, 10:] = 200
    out = windows.edges(frame(spark, v=v), "v", 60, 150)
    strong = array(out, "edge_strong", v.shape)
    assert strong[:, 9:11].any(axis=1).all() and not strong[:, :9].any() and not strong[:, 11:].any()
    assert strong.sum(axis=1).max() == 1


def test_holes(spark):
    mask = np.ones((20, 20), bool)
    mask[5:7, 5:8] = mask[0:2, 10] = mask[12:16, 12:16] = False
    out = array(whole.add(frame(spark, m=mask), f=whole.filled("m", 6)), "f", mask.shape)
    assert out[5:7, 5:8].all() and not out[0:2, 10].any() and not out[12:16, 12:16].any()


def zoned(spark, cfg=CFG, **masks):
    water = np.zeros(next(iter(masks.values())).shape, bool)
    return stages.zoned(frame(spark, **({"water": water} | masks)), cfg)


def sensor(spark, valid, cx, cy, cfg=CFG):
    px = zoned(spark, cfg, candidate=valid, buffer=np.zeros_like(valid))
    label = [r.label for r in px.where(f"y = {cy} and x = {cx} and label is not null").collect()] or [-1]
    zones = spark.createDataFrame([(1, 1, cx, cy, label[0])], "image_id int, zone_id int, drop_x int, drop_y int, label long")
    return stages.sensor_zones(zones, px, cfg).first()


def test_radius_border_and_cap(spark):
    s = sensor(spark, np.ones((300, 300), bool), 150, 149)
    assert (s.radius, s.limiting_factor, s.limiting_distance) == (150 - 1 - 4, "image_boundary", 150.0)
    s = sensor(spark, np.ones((400, 400), bool), 200, 200)
    assert (s.radius, s.limiting_factor, s.limit_x) == (180, "max_radius", None)


def test_radius_near_invalid(spark):
    valid = np.ones((100, 100), bool)
    valid[50, 53] = False
    s = sensor(spark, valid, 50, 50)
    assert (s.radius, s.limiting_distance, s.limit_x, s.limit_y, s.not_viable) == (0, 3.0, 53, 50, "radius_below_minimum")
    valid[50, 50] = False
    assert sensor(spark, valid, 50, 50).not_viable == "center_in_excluded_area"


def test_radius_is_brute_force(spark):
    valid = np.zeros((300, 300), bool)
    valid[20:280, 20:90] = valid[210:280, 20:280] = True
    s = sensor(spark, valid, 55, 245)
    y, x = np.nonzero(~valid)
    d = math.sqrt(((x - 55) ** 2 + (y - 245) ** 2).min())
    assert s.radius == math.ceil(d) - 5 and abs(s.limiting_distance - d) < 0.006
    assert valid[disc(300, 300, 55, 245, s.radius)].all()


def test_buffer_limits(spark):
    water = disc(400, 400, 200, 110, 10) | disc(400, 400, 330, 200, 10)
    px = stages.zoned(stages.candidate_mask(frame(spark, water=water, canopy=np.zeros_like(water)), CFG), CFG)
    found = px.where("y = 200 and x = 200").first().label
    zones = spark.createDataFrame([(1, 1, 200, 200, found), (1, 2, 200, 200, found)], "image_id int, zone_id int, drop_x int, drop_y int, label long")
    got = {r.zone_id: r for r in stages.sensor_zones(zones, px, CFG).collect()}
    assert got[1].limiting_factor == "water_buffer" and got[1].limit_y < 200 and got[2].not_viable == "duplicate_center"


def test_water_keeps_its_distance(spark):
    water = np.zeros((200, 300), bool)
    water[:, :110] = True
    px = stages.zoned(stages.candidate_mask(frame(spark, water=water, canopy=np.zeros_like(water)), CFG), CFG)
    zones = stages.top_zones(stages.scored(stages.regions(px, CFG), CFG), CFG)
    circle = stages.sensor_zones(zones, px, CFG).first()
    assert circle.cx - circle.radius > 110 + 17


def test_ring_radii(spark):
    got = [spark.range(1).select(stages.ring_radii(F.lit(r), 28, 10, 4).alias("r")).first().r for r in (128, 39, 28, 30)]
    assert got == [[127, 122, 94, 66, 38], [38, 33], [], [29]]


def test_drop_points(spark):
    water = np.zeros((220, 220), bool)
    water[:, :20] = True
    px = stages.zoned(stages.candidate_mask(frame(spark, water=water, canopy=np.zeros_like(water)), CFG), CFG)
    zones = stages.top_zones(stages.scored(stages.regions(px, CFG), CFG), CFG)
    circles = stages.sensor_zones(zones, px, CFG)
    samples = stages.ring_samples(circles, CFG)
    assert samples.count() == samples.select("image_id", "zone_id", "x", "y").distinct().count() > 20
    judged = stages.drop_samples(samples, zones, px, CFG)
    points = stages.spaced(judged, CFG).orderBy("drop_id").collect()
    c = circles.first()
    for p in points:
        assert abs(p.score - (0.4 * p.clearance_score + 0.3 * p.water_clearance_score + 0.3 * p.proximity_score)) <= 0.11
    # one distance for all zones is each zone's own
    valid = array(px.where(f"label = {zones.first().label}"), "label", water.shape, int) > 0
    valid &= ~array(px, "buffer", water.shape)
    zy, zx = np.nonzero(~np.pad(valid, 1))
    for p in points:
        assert abs(p.clearance - math.sqrt(((zx - 1 - p.x) ** 2 + (zy - 1 - p.y) ** 2).min())) < 0.006
    assert 2 <= len(points) <= 8
    assert [p.score for p in points] == sorted((p.score for p in points), reverse=True)
    at = [(c.cx, c.cy)] + [(p.x, p.y) for p in points]
    assert all(math.dist(a, b) >= 28 for i, a in enumerate(at) for b in at[:i])
    assert all(math.dist(at[0], p) <= c.radius for p in at)


def test_supply_band(spark):
    water = disc(150, 200, 100, 75, 30)
    canopy = np.zeros_like(water)
    canopy[:, 150:] = True
    px = frame(spark, water=water, canopy=canopy)
    band = stages.supply_band(px, CFG)
    inside = array(band, "band", water.shape)
    zy, zx = np.nonzero(water)
    y, x = np.nonzero(inside)
    d = np.sqrt(((y[:, None] - zy) ** 2 + (x[:, None] - zx) ** 2).min(axis=1))
    assert len(d) and d.min() > 18 and d.max() <= 60 and not (inside & (water | canopy)).any()
    seg = stages.supply_segments(band, CFG).collect()
    assert [s.segment_id for s in seg] == [1] and inside[seg[0].anchor_y, seg[0].anchor_x]
    assert not array(stages.supply_band(frame(spark, water=np.zeros_like(water), canopy=canopy), CFG), "band", water.shape).any()


def test_all_water(spark):
    water = np.ones((70, 70), bool)
    made = analysis.of_masks(frame(spark, water=water, canopy=~water), CFG)
    row = made.summary.first()
    assert (row.regions, row.zones, row.sensors, row.segments, row.isolated, row.water_pct) == (0, 0, 0, 0, 0, 100.0)


def test_published_arithmetic(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert round(one(scores.final_score(F.lit(100.0), F.lit(100.0), F.lit(34.4))), 1) == 86.9
    assert round(one(scores.isolation_score(F.lit(1.0), F.lit(33.97), F.lit(1 - 0.9837), 120.0)), 1) == 74.6
    assert one(scores.classify_zone(F.lit(79.999))) == "MODERATE POTENTIAL" and one(scores.classify_isolation(F.lit(50.0))) == "MODERATE ISOLATION"


def test_colour_spaces(spark):
    rows = [(0, 0, 255), (255, 0, 0), (0, 255, 0), (255, 255, 255), (0, 0, 0), (110, 120, 60)]
    b, g, r = (F.col(c) for c in "bgr")
    light, a, bb = colour.lab(b, g, r)
    out = spark.createDataFrame(rows, "b int, g int, r int").select(colour.hue(b, g, r), colour.saturation(b, g, r), colour.value(b, g, r), colour.gray(b, g, r), light, a, bb).collect()
    assert [o[0] for o in out[:5]] == [0, 120, 60, 0, 0] and [o[1] for o in out[:5]] == [255, 255, 255, 0, 0] and [o[3] for o in out[:5]] == [76, 29, 150, 255, 0]
    assert abs(out[0][4] - 53.24) < 0.1 and abs(out[0][5] - 80.09) < 0.2 and abs(out[0][6] - 67.20) < 0.2


def test_textured_canopy(spark):
    rng = np.random.default_rng(3)
    img = np.zeros((90, 120, 3))
    img[:, :60] = (50, 120, 60) + rng.normal(0, 40, (90, 60, 3))
    img[:, 60:] = (60, 150, 90) + rng.normal(0, 3, (90, 60, 3))
    img = img.clip(0, 255).astype(int)
    px = frame(spark, b=img[..., 0], g=img[..., 1], r=img[..., 2], water=np.zeros((90, 120), bool))
    out = array(stages.canopy_mask(px, CFG), "canopy", (90, 120))
    assert out[:, :55].mean() > 0.8 and out[:, 68:].mean() < 0.1


def test_muddy_water(spark):
    rng = np.random.default_rng(5)
    img = np.tile(np.array([55, 85, 105]), (100, 150, 1)) + rng.normal(0, 3, (100, 150, 3))
    img[35:70, 50:105] = (165, 195, 212) + rng.normal(0, 3, (35, 55, 3))
    img = img.clip(0, 255).astype(int)
    planes = dict(zip("bgr", (img[..., 0], img[..., 1], img[..., 2]), strict=True))
    seen, model = stages.detect_water(frame(spark, **planes, **{f"a{c}": v for c, v in planes.items()}), CFG)
    water = array(seen, "water", (100, 150))
    outside = np.ones((100, 150), bool)
    outside[30:75, 45:110] = False
    assert water[outside].mean() > 0.95 and water[42:63, 57:98].mean() < 0.05
    assert model.first().scene_model is True and model.first().rejected > 0


def test_scene_colours_by_hand():
    cfg = CFG
    #               the largest   near, a bit lighter   near, much lighter   through the second   blue     far
    centres = np.array([[30.0, 0, 10], [38.0, 8, 18], [42.0, 1, 10], [20.0, 14, 25], [50.0, 20, -9], [30.0, 40, 40]])
    share = np.array([0.4, 0.1, 0.1, 0.1, 0.1, 0.25])
    # 8 / 0.6 = 13.3 lighter is near enough, 12 / 0.6 = 20 is not; a fifth of the seeds alone is no reason
    assert stages.accepted_clusters(centres, share, cfg).tolist() == [True, True, False, True, True, False]


def test_no_model_without_seeds(spark):
    rng = np.random.default_rng(1)
    img = (60, 150, 90) + rng.normal(0, 30, (40, 50, 3))
    planes = dict(zip("bgr", (img.clip(0, 255).astype(int)[..., i] for i in range(3)), strict=True))
    seen, model = stages.detect_water(frame(spark, **planes, **{f"a{c}": v for c, v in planes.items()}), CFG)
    assert not array(seen, "water", (40, 50)).any() and model.first().scene_model is False


def test_primary_share(spark):
    # six equal clusters: none has a fifth of the seeds
    rows = [(1, i, c, 60.0 * c + (i % 3) * 0.01, 0.0, 0.0) for c in range(6) for i in range(100)]
    seeds = spark.createDataFrame(rows, "image_id int, y int, x int, cl double, ca double, cb double")
    assert stages.scene_clusters(seeds).count() == 0
    assert stages.scene_clusters(seeds.union(seeds.where("x = 2").withColumn("y", F.col("y") + 500))).count() > 0


def test_canopy_over_water_counts_whole(spark):
    """A stand is judged by its size before the water is taken off."""
    rng = np.random.default_rng(3)
    img = np.clip((50, 120, 60) + rng.normal(0, 40, (60, 60, 3)), 0, 255).astype(int)
    img[:, 30:] = (200, 200, 200)
    water = np.zeros((60, 60), bool)
    water[:, :20] = True
    px = frame(spark, b=img[..., 0], g=img[..., 1], r=img[..., 2], water=water)
    from dataclasses import replace

    out = array(stages.canopy_mask(px, replace(CFG, canopy_min_area=1200)), "canopy", (60, 60))
    assert out[:, 22:26].mean() > 0.8 and not out[:, :20].any()


def test_contrast():
    rng = np.random.default_rng(4)
    v = np.clip(rng.normal(90, 8, (1, 64, 80)), 0, 255).astype(np.int64)
    out = whole.equalised("v").values(lambda c: v)
    th, tw = 8, 10
    most = max(1, int(2.0 * th * tw / 256))

    def curve(tile):
        counts = [0] * 256
        for p in tile.ravel():
            counts[p] += 1
        excess = sum(max(0, n - most) for n in counts)
        counts = [min(n, most) + excess // 256 for n in counts]
        left = excess % 256
        step = max(256 // max(left, 1), 1)
        for b in range(0, 256, step):
            if left == 0:
                break
            counts[b] += 1
            left -= 1
        total, table = 0, []
        for n in counts:
            total += n
            table.append(min(255, math.floor(total * 255 / (th * tw) + 0.5)))
        return table

    curves = [[curve(v[0, i * th : (i + 1) * th, j * tw : (j + 1) * tw]) for j in range(8)] for i in range(8)]
    clamp = lambda i: min(7, max(0, i))
    for y in range(0, 64, 5):
        for x in range(0, 80, 7):
            fy, fx = y / th - 0.5, x / tw - 0.5
            i, j = math.floor(fy), math.floor(fx)
            fy, fx = fy - i, fx - j
            at = lambda a, b: curves[clamp(a)][clamp(b)][v[0, y, x]]  # noqa: B023, E731
            want = (at(i, j) * (1 - fx) + at(i, j + 1) * fx) * (1 - fy) + (at(i + 1, j) * (1 - fx) + at(i + 1, j + 1) * fx) * fy
            assert abs(out[0, y, x] - want) <= 0.5 + 1e-9


def test_lab_and_back(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([tuple(int(x) for x in row) for row in rng.integers(0, 256, (200, 3))], "b int, g int, r int")
    back = colour.from_lab8(*colour.lab8(F.col("b"), F.col("g"), F.col("r")))
    rows = df.select("b", "g", "r", *[c.alias(n) for c, n in zip(back, ("b2", "g2", "r2"), strict=True)]).collect()
    assert max(abs(x - y) for r in rows for x, y in zip(r[:3], r[3:], strict=True)) <= 20  # dark blues are coarse in 8 bits
    assert sum(abs(x - y) for r in rows for x, y in zip(r[:3], r[3:], strict=True)) / len(rows) < 5


def test_suppression(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(60):
        x, y, w, h = rng.integers(0, 60), rng.integers(0, 60), rng.integers(5, 30), rng.integers(5, 30)
        rows.append((1, i, int(i % 2), "c", round(float(rng.random()), 2), float(x), float(y), float(x + w), float(y + h)))
        if i % 3 == 0:  # a box of the same class almost on top of it
            rows.append((1, 100 + i, int(i % 2), "c", round(float(rng.random()), 2), float(x + 0.5), float(y), float(x + w + 0.5), float(y + h)))
    boxes = spark.createDataFrame(rows, "image_id int, anchor_id int, class_id int, label string, confidence double, x1 double, y1 double, x2 double, y2 double")
    got = {r.anchor_id for r in detect.suppressed(boxes, CFG).collect()}

    def iou(a, b):
        w, h = min(a[7], b[7]) - max(a[5], b[5]), min(a[8], b[8]) - max(a[6], b[6])
        both = max(0, w) * max(0, h)
        return both / ((a[7] - a[5]) * (a[8] - a[6]) + (b[7] - b[5]) * (b[8] - b[6]) - both)

    want = []
    for r in sorted(rows, key=lambda r: (-r[4], r[1])):
        if all(k[2] != r[2] or iou(k, r) <= CFG.nms_iou for k in want):
            want.append(r)
    assert got == {r[1] for r in want} and len(got) < len(rows)


def test_class_names(spark):
    df = spark.createDataFrame([("{0: 'person', 2: 'car'}",), ("nonsense",), (None,)], "m string")
    got = [r.n for r in df.select(detect.class_names(F.col("m")).alias("n")).collect()]
    assert got[0] == {"0": "person", "2": "car"} and got[1] == got[2] and got[1]["8"] == "boat"


def write_png(path, img):
    path.write_bytes(images.png(img))


def test_image_source(spark, tmp_path):
    rng = np.random.default_rng(0)
    img = rng.integers(0, 255, (70, 90, 3)).astype(np.uint8)
    write_png(tmp_path / "good.png", img)
    write_png(tmp_path / "tiny.png", img[:32, :32])
    (tmp_path / "corrupt.jpg").write_bytes(rng.bytes(4096))
    (tmp_path / "empty.png").write_bytes(b"")
    (tmp_path / "notes.txt").write_text("text")
    rows = images.decoded_images(spark, str(tmp_path))
    got = {r.image_id.rsplit("/", 1)[1]: r.status for r in rows.collect()}
    assert got == {"good.png": "OK", "tiny.png": "IMAGE_TOO_SMALL", "corrupt.jpg": "CORRUPT_IMAGE", "empty.png": "EMPTY_FILE", "notes.txt": "UNSUPPORTED_FILE_TYPE"}
    px = images.pixels(rows)
    assert (np.stack([array(px, c, (70, 90), int) for c in "bgr"], axis=2) == img).all()
    back = images.pngs(px).first().png
    assert zlib.decompress(bytes(back)[41:-16][: struct.unpack(">I", bytes(back)[33:37])[0]])[1:4] == bytes(img[0, 0, ::-1])


def test_downscale(spark):
    img = np.random.default_rng(1).integers(0, 255, (64, 128, 3)).astype(np.uint8)
    rows = spark.createDataFrame([("a", "OK", 128, 64, 3, bytearray(img.tobytes()))], "image_id string, status string, w int, h int, channels int, data binary")
    px = images.pixels(rows, Config(max_side=64))
    want = np.floor(img.reshape(32, 2, 64, 2, 3).mean(axis=(1, 3)) + 0.5)
    assert (np.stack([array(px, c, (32, 64), int) for c in "bgr"], axis=2) == want).all()


def test_views(spark):
    px = frame(spark, b=np.full((4, 4), 100), g=np.full((4, 4), 100), r=np.full((4, 4), 100), m=np.eye(4, dtype=bool))
    out = images.tint(images.dimmed(px), "m", (0, 0, 255), 0.5)
    assert array(out, "r", (4, 4), int)[0].tolist() == [155, 55, 55, 55]


def test_report(spark):
    import json

    water = disc(48, 64, 30, 20, 6)
    cfg = mini()
    made = analysis.of_masks(frame(spark, water=water, canopy=np.zeros_like(water)), cfg)
    found = spark.createDataFrame([(1, 1, "car", 0.5, 1, 2, 3, 4)], "image_id int, n int, label string, confidence double, x1 int, y1 int, x2 int, y2 int")
    counts = spark.createDataFrame([(1, {"car": 1})], "image_id int, counts map<string,int>")
    from pixelloom.operators import report

    doc = json.loads(report.report(made.summary, made.zones, made.sensors, made.segments, made.isolated, cfg, found, counts).first().doc)
    assert len(doc["zones"]) == doc["metrics"]["candidate_regions"] == 1 and doc["isolated_regions"] == [] and doc["warnings"] == ["No isolated land region was found."]
    zone, circle, supply = doc["zones"][0], doc["sensor_zones"][0], doc["supply_zone"]
    assert circle["zone_id"] == zone["id"] == 1 and circle["score"] == zone["score"] and circle["center"] == zone["max_clearance_point"]
    assert doc["sensor_analysis"] == {"evaluated": 1, "viable": 1, "not_viable": []}
    assert supply["pixel_area"] == sum(x["pixel_area"] for x in supply["segments"]) and abs(sum(x["share_of_band"] for x in supply["segments"]) - 100) < 1
    assert doc["ai"] == {"status": "active", "detections": [{"label": "car", "confidence": 0.5, "bbox": {"x1": 1, "y1": 2, "x2": 3, "y2": 4}, "n": 1}], "counts": {"car": 1}}
    assert doc["parameters"]["scene_colour_model"] is False and doc["metrics"]["water_percentage"] == round(100 * water.sum() / water.size, 2)


def test_files_to_reports(spark, tmp_path):
    """Image files in, one row each out: reports with drawings, or the reason why not."""
    import base64
    import json

    rng = np.random.default_rng(7)
    img = np.clip((60, 110, 70) + rng.normal(0, 18, (96, 128, 3)), 0, 255)
    img[40:60] = (58, 96, 128) + rng.normal(0, 2, (20, 128, 3))
    write_png(tmp_path / "river.png", img.clip(0, 255).astype(np.uint8))
    write_png(tmp_path / "tiny.png", img[:32, :32].astype(np.uint8))
    from dataclasses import replace

    cfg = replace(mini(), water_open=3, water_close=3)
    out = analysis.analyse(spark, str(tmp_path), cfg, drawn=("water_mask", "final_analysis"))
    rows = {r.image_id.rsplit("/", 1)[1]: r for r in out.collect()}
    assert {n: r.status for n, r in rows.items()} == {"river.png": "OK", "tiny.png": "IMAGE_TOO_SMALL"}
    assert rows["tiny.png"].doc is None and rows["tiny.png"].water_mask is None
    doc = json.loads(rows["river.png"].doc)
    assert doc["image_info"] == {"original_width": 128, "original_height": 96, "processed_width": 128, "processed_height": 96, "scale": 1.0}
    assert 10 < doc["metrics"]["water_percentage"] < 35
    for name in ("water_mask", "final_analysis"):
        assert base64.b64decode(rows["river.png"][name]).startswith(b"\x89PNG")


def test_lines(spark):
    mask = np.zeros((20, 30), bool)
    mask[5:15, 6:26] = True
    mask[0:4, 0:4] = True  # along the frame
    px = frame(spark, m=mask, b=np.zeros((20, 30)), g=np.zeros((20, 30)), r=np.zeros((20, 30)))
    line = array(views.line_layer(px, "m", "l"), "l", mask.shape)
    want = np.zeros_like(mask)
    want[5:15, 6:26] = True
    want[6:14, 7:25] = False
    want[2, 3] = want[3, 2:4] = True
    assert (line == want).all()
    dashed = array(views.line_layer(px, "m", "l", dash=2), "l", mask.shape)
    y, x = np.mgrid[:20, :30]
    assert (dashed == (want & ((y // 2 + x // 2) % 2 == 0))).all()
    drawn = views.stroke(views.line_layer(px, "m", "l"), "l", (1, 2, 3))
    assert array(drawn, "r", mask.shape, int)[5, 10] == 3 and array(drawn, "r", mask.shape, int)[4, 10] == views.OUTLINE[2]


def test_boxes_and_circles(spark):
    zero = np.zeros((20, 30))
    px = frame(spark, b=zero, g=zero, r=zero)
    found = spark.createDataFrame([(1, "car", 5, 6, 15, 12)], "image_id int, label string, x1 int, y1 int, x2 int, y2 int")
    red = array(views.detection_view(px, found), "r", (20, 30), int)
    assert red[6, 10] == red[11, 5] == 255 and red[9, 10] == 0 and red[3, 10] == 0
    rings = spark.createDataFrame([(1, 15, 10, 6, None), (1, 2, 2, 2, "duplicate_center")], "image_id int, cx int, cy int, radius int, not_viable string")
    out = views.circles(px, rings)
    red = array(out, "r", (20, 30), int)
    assert red[10, 21] == views.SENSOR[2] and 0 < red[10, 15] < views.SENSOR[2] and red[2, 2] == 0 and red[10, 29] == 0


def test_detector_input(spark):
    from pixelloom.config import from_env

    assert [from_env({"DETECTOR_INPUT": v}).detector_input for v in (" 500 ", "9", "5000", "x", "")] == [480, 320, 1280, 640, 640]
    img = np.full((32, 64, 3), 7, np.uint8)
    rows = spark.createDataFrame([("a", "OK", 64, 32, 3, bytearray(img.tobytes()))], "image_id string, status string, w int, h int, channels int, data binary")
    out = images.letterboxed(rows, 32).persist()
    assert (array(out, "g", (32, 32), int) == np.repeat([[114], [7], [114]], [8, 16, 8], axis=0)).all()
    assert out.first().pad_y == 8 and out.first().ratio == 0.5


def test_object_context(spark):
    score = [0.0] * 10
    anchors = [(1, 0, 320.0, 320.0, 64.0, 64.0, [*score[:2], 0.9, *score[3:]]), (1, 1, 322.0, 320.0, 64.0, 64.0, [*score[:2], 0.8, *score[3:]]), (1, 2, 100.0, 300.0, 20.0, 20.0, [0.5, *score[1:]])]
    df = spark.createDataFrame(anchors, "image_id int, anchor_id int, cx double, cy double, bw double, bh double, scores array<double>")
    found, counts = detect.context(df, spark.createDataFrame([(1, 640, 640), (2, 64, 64)], "image_id int, w int, h int"))
    assert [(r.label, r.x1, r.y1, r.x2, r.y2) for r in found.orderBy("n").collect()] == [("car", 288, 288, 352, 352), ("person", 90, 290, 110, 310)]
    maps = {r.image_id: r.counts for r in counts.collect()}
    assert maps[1]["car"] == maps[1]["person"] == 1 and sum(maps[2].values()) == 0 and len(maps[2]) == 7


def test_scaling_up():
    a = np.zeros((2, 2, 3), np.uint8)
    a[:, 1] = 100
    assert images.resized(a, 2, 4)[0, :, 0].tolist() == [0, 25, 75, 100]


def test_stream(spark, tmp_path):
    from pixelloom.streaming import directory

    (tmp_path / "in").mkdir()
    write_png(tmp_path / "in" / "a.png", np.full((64, 64, 3), 90, np.uint8))
    run = directory.watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), lambda px: px.groupBy("image_id").agg(F.avg("b").alias("b")))
    run.awaitTermination(120)
    assert [r.b for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [90.0]
