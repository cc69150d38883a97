"""Masks as runs, the chamfer metric and contours, against pixels, shortest paths and squares."""

import heapq
import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.config import mini
from pixelloom.functions import outlines
from pixelloom.operators import runs, stages, whole, windows
from pixelloom.store import cut

SHAPES = {1: (7, 9), 2: (12, 5), 3: (1, 1), 4: (9, 16)}


def masks(seed, density=0.5):
    rng = np.random.default_rng(seed)
    return {i: rng.random(shape) < density for i, shape in SHAPES.items()}


def table(spark, **named):
    rows = []
    for i, (h, w) in SHAPES.items():
        rows += [(i, y, x, w, h, *(bool(m[i][y, x]) for m in named.values())) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "image_id long, y int, x int, w int, h int, " + ", ".join(f"{n} boolean" for n in named))


def images(spark):
    return spark.createDataFrame([(i, w, h) for i, (h, w) in SHAPES.items()], "image_id long, w int, h int")


def back(runs_):
    """Runs as arrays; they must be disjoint, apart, and inside."""
    out = {i: np.zeros(shape, bool) for i, shape in SHAPES.items()}
    last = {}
    for r in sorted(runs_.collect()):
        assert 0 <= r.x0 <= r.x1 < out[r.image_id].shape[1] and r.x0 > last.get((r.image_id, r.y), -5) + 1
        last[r.image_id, r.y] = r.x1
        out[r.image_id][r.y, r.x0 : r.x1 + 1] = True
    return out


def same(runs_, want):
    got = back(runs_)
    return all((got[i] == want[i]).all() for i in SHAPES)


def test_set_operations(spark):
    a, b, c = masks(1), masks(2), masks(3, 0.2)
    px = cut(table(spark, a=a, b=b, c=c), "px")
    ra, rb, rc = (runs.of_mask(px, n) for n in "abc")
    assert same(ra, a)
    assert same(runs.union(ra, rb, rc), {i: a[i] | b[i] | c[i] for i in a})
    assert same(runs.intersection(ra, rb), {i: a[i] & b[i] for i in a})
    assert same(runs.difference(ra, rb), {i: a[i] & ~b[i] for i in a})
    assert same(runs.combined("(a <> b) or c", a=ra, b=rb, c=rc), {i: (a[i] ^ b[i]) | c[i] for i in a})
    assert same(runs.complement(ra, images(spark)), {i: ~a[i] for i in a})
    assert same(runs.intersection(ra, rb.where("false")), {i: a[i] & False for i in a})
    assert sorted(runs.pixels(ra).select("image_id", "y", "x").collect()) == sorted(px.where("a").select("image_id", "y", "x").collect())


@pytest.mark.parametrize("k", [1, 3, 5, 7])
def test_growth_is_that_of_pixels(spark, k):
    a = masks(k, 0.15 if k > 3 else 0.4)
    px = cut(table(spark, a=a), "px")
    r, frame = runs.of_mask(px, "a"), images(spark)
    for on_runs, on_pixels in ((runs.grown, windows.dilate), (runs.shrunk, windows.erode), (runs.closed, windows.closed)):
        want = {i: np.zeros(s, bool) for i, s in SHAPES.items()}
        for p in on_pixels(px, "a", k).where("a").collect():
            want[p.image_id][p.y, p.x] = True
        assert same(on_runs(r, frame, k), want)


def test_components_of_runs(spark):
    a = masks(9, 0.45)
    px = cut(table(spark, a=a), "px")
    got = runs.pixels(runs.labelled(runs.of_mask(px, "a"))).select("image_id", "y", "x", "label")
    want = whole.add(px, label=whole.labels("a")).where("label is not null").select("image_id", "y", "x", "label")
    assert sorted(got.collect()) == sorted(want.collect())
    stats = {(r.image_id, r.label): (r.area, r.left, r.top, r.width, r.height, round(r.cx, 9), round(r.cy, 9)) for r in runs.stats(runs.labelled(runs.of_mask(px, "a"))).collect()}
    for (i, label), s in stats.items():
        at = np.array([(p.y, p.x) for p in got.where(f"image_id = {i} and label = {label}").collect()])
        y, x = at.T
        assert s == (len(at), x.min(), y.min(), np.ptp(x) + 1, np.ptp(y) + 1, round(x.mean(), 9), round(y.mean(), 9))
    assert runs.labelled(runs.of_mask(px, "a").where("false")).count() == 0


def test_stored_as_runs_and_read_back(spark):
    px = table(spark, a=masks(4), b=masks(5, 0.1)).withColumn("label", F.when(F.col("a"), F.col("y").cast("long"))).withColumn("d", F.when(F.col("x") % 3 > 0, F.col("x") * 1.5))
    rows = cut(runs.packed(px, ["d"]), "packed")
    assert rows.count() < px.count()
    out = runs.unpacked(rows, ["d"])
    assert sorted(map(str, out.select(px.columns).collect())) == sorted(map(str, px.collect()))
    # only the arrays that are asked for are read
    plan = out.select("image_id", "a")._jdf.queryExecution().executedPlan().toString()
    assert "d:array" not in plan.split("ReadSchema")[-1]


# --- the chamfer metric ------------------------------------------------------------------


def shortest(mask, padded):
    """Dijkstra over neighbours, diagonals and knight's moves."""
    h, w = mask.shape
    steps = [(dy, dx, {1: 10_000, 2: 14_000, 5: 21_969}[dy * dy + dx * dx]) for dy in range(-2, 3) for dx in range(-2, 3) if dy * dy + dx * dx in (1, 2, 5)]
    lo, hi = (-1, 1) if padded else (0, 0)
    best = {(y, x): 0 for y in range(lo, h + hi) for x in range(lo, w + hi) if not (0 <= y < h and 0 <= x < w and mask[y, x])}
    heap = [(0, *p) for p in best]
    while heap:
        d, y, x = heapq.heappop(heap)
        if d > best[y, x]:
            continue
        for dy, dx, cost in steps:
            p = (y + dy, x + dx)
            if lo <= p[0] < h + hi and lo <= p[1] < w + hi and d + cost < best.get(p, 1 << 60):
                best[p] = d + cost
                heapq.heappush(heap, (d + cost, *p))
    return np.array([[best.get((y, x), whole.FAR) for x in range(w)] for y in range(h)])


@pytest.mark.parametrize("padded", [False, True])
@pytest.mark.parametrize("density", [0.5, 0.9, 0.99, 1.0])
def test_chamfer_is_the_shortest_path(padded, density):
    rng = np.random.default_rng(int(density * 100))
    stack = rng.random((4, 17, 23)) < density
    got = whole.chamfer_distance(stack, padded)
    for mask, d in zip(stack, got, strict=True):
        want = shortest(mask, padded)
        assert (np.where(want >= whole.FAR, whole.FAR, d) == want).all() and ((d >= whole.FAR) == (want >= whole.FAR)).all()


def test_metric_is_a_switch(spark):
    y, x = np.mgrid[:48, :64]
    px = spark.createDataFrame([(1, int(b), int(a), 64, 48, bool((a - 20) ** 2 + (b - 20) ** 2 < 60), False) for b, a in zip(y.ravel(), x.ravel(), strict=True)], "image_id long, y int, x int, w int, h int, water boolean, canopy boolean")
    found = {}
    for metric in ("exact", "chamfer5"):
        cfg = replace(mini(), metric=metric)
        zoned = stages.zoned(stages.candidate_mask(px, cfg), cfg)
        found[metric] = stages.regions(zoned, cfg).collect()[0]
        # circles are exact under either metric
        zones = stages.top_zones(stages.scored(stages.regions(zoned, cfg), cfg), cfg)
        assert stages.sensor_zones(zones, zoned, cfg).count() == 1
    a, b = found["exact"], found["chamfer5"]
    assert a.clearance != b.clearance and abs(a.clearance - b.clearance) < 0.03 * a.clearance + 0.01
    with pytest.raises(ValueError, match="metric"):
        whole.clearance("water", padded=False, metric="city").values(lambda c: np.ones((1, 2, 2), bool))


# --- contours ----------------------------------------------------------------------------


def test_contours_are_the_outlines(spark):
    shapes = masks(31, 0.6)
    shapes[4][:] = False
    shapes[4][2:7, 3:12] = True
    shapes[4][4, 5:8] = False  # a hole has no contour
    px = cut(table(spark, a=shapes), "px")
    labelled = whole.add(px, label=whole.labels("a"))
    found = whole.borders(labelled).select("*", outlines.closed_length(F.col("points")).alias("length"), outlines.enclosed_area(F.col("points")).alias("enclosed")).collect()
    pixels = {}
    for p in labelled.where("label is not null").collect():
        pixels.setdefault((p.image_id, p.label), []).append((p.y, p.x))
    assert {(r.image_id, r.label) for r in found} == set(pixels)
    for r in found:
        box = np.zeros(SHAPES[r.image_id], bool)
        box[tuple(np.array(pixels[r.image_id, r.label]).T)] = True
        assert math.isclose(r.length, whole.outline_length(box))
        f = np.pad(whole.label(~np.pad(box, 1)[None], reach=0)[0] != 0, 1).astype(int)
        n = f[:-1, :-1] + f[:-1, 1:] + f[1:, :-1] + f[1:, 1:]
        assert r.enclosed == (n == 4).sum() + 0.5 * (n == 3).sum()
        points = [(p.y, p.x) for p in r.points]
        assert all(box[p] for p in points) and points[0] == min(points) or len(points) > 1
        # no point lies on a straight run between its neighbours
        for a, b, c in zip(points[-1:] + points[:-1], points, points[1:] + points[:1], strict=True):
            if len(points) > 2:
                way = lambda p, q: (np.sign(q[0] - p[0]), np.sign(q[1] - p[1]))
                assert way(a, b) != way(b, c)


def test_contour_of_a_rectangle_and_a_line():
    assert whole.outer_border(np.ones((3, 4), bool)).tolist() == [[0, 0], [0, 3], [2, 3], [2, 0]]
    assert whole.outer_border(np.ones((1, 5), bool)).tolist() == [[0, 0], [0, 4]]
    assert whole.outer_border(np.ones((1, 1), bool)).tolist() == [[0, 0]]
