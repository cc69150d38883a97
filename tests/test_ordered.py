"""Neighbourhoods of whole images against windows, pixels in order, and stages on runs."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom import store
from pixelloom.config import mini
from pixelloom.operators import around, stages, whole, windows
from pixelloom.plans import registry
from pixelloom.plans import scenes as sc

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_neighbourhoods_are_those_of_windows(spark):
    px = sc.colour_pixels(spark, SF).where("image_id < 3").withColumn("m", F.expr("(x * 7 + y * 3 + image_id) % 5 < 2")).withColumn("g", F.col("g").cast("long"))
    added = {"d": around.dilated("m", 5), "e": around.eroded("m", 5), "o": around.opened("m", 3), "c": around.closed("m", 3), "mean": around.mean("g", 9), "std": around.deviation("g", 9), "soft": around.blurred("g", 5), "grade": around.edge_grade("b", 60, 150)}
    got = whole.add(px, ordered=True, **added)
    want = windows.erode(windows.dilate(px, "m", 5, "d"), "m", 5, "e")
    want = windows.closed(windows.opened(want.withColumns({"o": F.col("m"), "c": F.col("m")}), "o", 3), "c", 3)
    want = windows.local_std(windows.box_mean(want, "g", 9, "mean"), "g", 9, "std")
    want = windows.edges(windows.gaussian(want.withColumn("soft", F.col("g")), ["soft"], 5), "b", 60, 150).withColumn("grade", F.col("edge_weak").cast("int") + F.col("edge_strong").cast("int"))
    columns = ["image_id", "y", "x", *added]
    rows = [sorted(map(tuple, df.select(*columns).collect())) for df in (got, want)]
    assert rows[0] == rows[1] and len(rows[0]) == px.select("image_id").distinct().count() * sc.W * sc.H > 0


def test_pixels_out_of_order_are_refused(spark):
    px = sc.scene_pixels(spark, SF)
    for wrong in (px.sortWithinPartitions("image_id", "x", "y"), px.where("y > 0")):
        with pytest.raises(Exception, match="not in order|full rectangle"):
            whole.add(wrong, ordered=True, label=whole.labels("water")).collect()


def test_no_pixels_are_shuffled(spark):
    """Bands, texture and scene colours take their pixels as they are dealt."""
    for name in ("canny_edges", "texture_support", "morphology", "sure_water", "scene_colours"):
        text = plan(registry.queries()[name](spark, SF))
        assert "REPARTITION_BY_COL" not in text and "Sort [" not in text


def test_pixels_are_not_broadcast(spark):
    """Circles meet the scenes' runs by a shuffle, however small their file is."""
    zones, zoned = registry._zones(spark, SF)
    circles = stages.sensor_zones(zones, zoned, mini()).where("not_viable is null")
    text = plan(stages.disks_valid(circles.join(zones.select("image_id", "zone_id", "label"), ["image_id", "zone_id"]), zoned))
    tables = [line for line in text.splitlines() if "Join" in line and "image_id" in line]
    assert sum("SortMergeJoin" in line for line in tables) >= 2


def test_short_lines_are_as_long_ones(spark, monkeypatch):
    mask = np.random.default_rng(3).random((4, 30, 50)) < 0.97
    found = {}
    for short in (128, 0):
        monkeypatch.setattr(whole, "SHORT", short)
        found[short] = [whole.squared_distance(mask, padded) for padded in (False, True)]
    assert all((a == b).all() for a, b in zip(found[128], found[0], strict=True))


def test_batches_of_pixels_are_not_weighed(spark):
    """Spark measures no batch of pixels after each row, and the session's own limit is back afterwards."""
    limit = spark.conf.get(store.WEIGHED, None)
    for name in ("canny_edges", "texture_support", "morphology", "sure_water", "scene_colours"):
        text = plan(registry.queries()[name].__wrapped__(spark, SF))  # before its result is stored
        assert "MapInArrow" in text and "REPARTITION_BY_COL" not in text and "Sort [" not in text
        assert "MapInArrow" not in plan(registry.queries()[name](spark, SF))
    with store.small_rows(spark):
        assert spark.conf.get(store.WEIGHED) == str(2**31 - 1)
        with pytest.raises(ValueError), store.small_rows(spark):
            raise ValueError
    assert spark.conf.get(store.WEIGHED, None) == limit


def test_candidate_land_is_one_pass(spark):
    """Masks and what is measured on them come of one pass, with the values of two."""
    px = sc.scene_pixels(spark, SF).where("image_id < 3")
    one = stages.zoned_rows(px, mini(), True)
    two = stages.zoned_rows(stages.candidate_mask(px, mini(), True), mini(), True).select(*one.columns)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_images_are_clustered_together_as_alone(monkeypatch):
    rng = np.random.default_rng(5)
    seeds = [np.round(rng.normal(size=(n, 3)) * spread, 1) for n, spread in ((1, 9), (40, 0), (700, 20), (3, 5), (2500, 30), (90, 1))]
    seeds += [np.repeat([[1.0, 2.0, 3.0], [40.0, 0.0, 9.0]], 30, axis=0)]
    alone = [stages.clustered([s])[0] for s in seeds]
    for together in (1, 2000, 1 << 20):
        monkeypatch.setattr(stages, "TOGETHER", together)
        for a, b in zip(alone, stages.clustered(seeds), strict=True):
            assert (a is None) == (b is None) and (a is None or all(np.array_equal(x, y) for x, y in zip(a, b, strict=True)))
    centres, share, _ = alone[-1]
    assert sorted(map(tuple, centres)) == [(1.0, 2.0, 3.0), (40.0, 0.0, 9.0)] and set(share) == {0.5}


def test_isolated_land_is_counted_by_stretches(spark):
    """No pixel comes back from the pass: its rows are stretches of lines, of which there are few."""
    px = sc.scene_pixels(spark, SF).where("image_id < 3")
    assert "x0" in plan(stages.isolated_regions(px, mini(), True))


def test_images_of_several_shapes_are_as_alone(spark):
    px = sc.scene_pixels(spark, SF).where("image_id < 4")
    cut = px.where("image_id % 2 = 0 or (y < 20 and x < 30)").withColumns({"w": F.expr("if(image_id % 2 = 0, w, 30)"), "h": F.expr("if(image_id % 2 = 0, h, 20)")}).coalesce(1)
    added = {"label": whole.labels("water"), "d": whole.clearance("water", padded=False)}
    rows = lambda df: sorted(map(str, df.collect()))
    alone = [rows(whole.add(cut.where(f"image_id = {i}"), ordered=True, **added)) for i in range(4)]
    assert rows(whole.add(cut, ordered=True, **added)) == sorted(sum(alone, [])) and alone[1]


def test_outlines_are_measured_together(monkeypatch):
    """Of all components of a stack in a few labellings, also of those inside of another's hole."""
    mask = np.random.default_rng(5).random((6, 24, 40)) < 0.55
    mask[0] = False
    mask[0, 2:20, 3:30] = True
    mask[0, 6:14, 8:20] = False
    mask[0, 8:11, 11:16] = True
    found, calls = whole.label(mask), []
    plain = whole.label
    monkeypatch.setattr(whole, "label", lambda *a, **k: calls.append(1) or plain(*a, **k))
    for strip in (1 << 20, 1200, 1):
        calls.clear()
        monkeypatch.setattr(whole, "STRIP", strip)
        got, null = whole.perimeters("m", 4).values(lambda _: mask)
        assert (null == ~mask).all() and (strip < 1 << 20 or len(calls) == 2)
        for image, lengths in zip(found, got, strict=True):
            for number in np.unique(image[image >= 0]):
                part = image == number
                assert set(lengths[part]) == {whole.outline_length(part) if part.sum() >= 4 else 0.0}


@pytest.mark.parametrize("metric", ["exact", "chamfer5"])
def test_regions_read_no_distances_of_pixels(spark, metric):
    """A run tells its point of most clearance; regions are those of the pixels' distances."""
    assert not [c for c, kind in registry._zoned(spark, SF).dtypes if kind.startswith("array")]
    cfg = replace(mini(), metric=metric)
    px = sc.scene_pixels(spark, SF).where("image_id < 4")
    want = sorted(map(tuple, stages.regions(stages.zoned_rows(px, cfg, True), cfg).collect()))
    for keep in ((), ("water", "buffer")):
        assert sorted(map(tuple, stages.regions(stages.zone_rows(px, cfg, True, keep), cfg).collect())) == want != []


def test_contours_take_one_join(spark):
    """A zone's number goes with its runs, so that contours need not be joined to zones again."""
    px = sc.scene_pixels(spark, SF).where("image_id < 4")
    rows = store.cut(stages.zone_rows(px, mini(), True), "rows")
    zones = store.cut(stages.regions(rows, mini()).select("image_id", F.col("region_id").alias("zone_id"), "label"), "zones")
    found = stages.zone_contours(zones, rows)
    assert "label" in found.columns and plan(found).split("Initial Plan")[0].count("Join ") == 1
    assert sorted((r.image_id, r.zone_id, r.label) for r in found.collect()) == sorted(map(tuple, zones.collect()))


def test_borders_are_the_walk():
    """Of each component, through all of its border's pixels, from the first one on, to the right hand."""
    assert whole.outer_border(np.array([[1, 1, 1], [1, 0, 1], [1, 1, 1]], bool)).tolist() == [[0, 0], [0, 2], [2, 2], [2, 0]]
    assert whole.outer_border(np.array([[0, 0, 1], [1, 1, 0]], bool)).tolist() == [[0, 2], [1, 1], [1, 0], [1, 1]]
    assert whole.outer_border(np.ones((1, 1), bool)).tolist() == [[0, 0]] and whole.ONWARD[4] == 8


def test_seeds_come_back_as_runs(spark):
    px = sc.colour_pixels(spark, SF).withColumnsRenamed({c: f"a{c}" for c in "bgr"})
    for share in (0.0, 0.02, 0.03):
        cfg = replace(mini(), seed_share=share, seed_support=0.5)
        seeds = stages.evidence(px, True).groupBy("image_id").agg(F.count_if(stages.wet(px, cfg) & (F.col("support") >= 0.5)).alias("n"), F.count("*").alias("all"))
        want = seeds.where(f"n > 0 and n >= {share} * all").select("image_id", "n").collect()
        assert sorted(map(tuple, stages.seed_counts(px, cfg, True).collect())) == sorted(map(tuple, want)) != []


def test_drop_points_read_distances_on_candidate_land_alone(spark):
    zones, rows = registry._zones(spark, SF, ("water", "buffer"), ("_free2", "_wd"))
    assert rows.where("label is null").count() and not rows.where("label is null and (_free2 is not null or _wd is not null)").count()
    full = stages.zoned_rows(sc.scene_pixels(spark, SF), mini(), True)
    want = stages.spaced(stages.drop_samples(stages.ring_samples(stages.sensor_zones(zones, full, mini()), mini()), zones, full, mini()), mini())
    assert sorted(map(tuple, registry.queries()["drop_points"](spark, SF).collect())) == sorted(map(tuple, want.collect())) != []
