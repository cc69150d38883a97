"""Label places, streams that lose nothing, batch inference, and reports that are read back."""

import json
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.config import Config, mini
from pixelloom.operators import detect, inference, placement, report
from pixelloom.plans import analysis, detail_queries
from pixelloom.sources import images, views
from pixelloom.streaming import directory

# --- label places ------------------------------------------------------------------------


def plain_places(labels, w, h, taken, font, below_first):
    """The fold, in loops."""
    out, taken = {}, list(taken)
    for n, text, x, top, bottom in sorted(labels):
        tw = font.advance * len(text)
        lines = [top - font.below - 6, bottom + font.height + 8]
        best = None
        for y in lines[::-1] if below_first else lines:
            for dx in (-((tw + 1) // 2), -tw - 8, 8):
                tx, ty = max(2, min(x + dx, w - tw - 4)), max(font.height + 4, min(y, h - 4))
                box = (tx - 3, ty - font.height - 4, tx + tw + 3, ty + font.below + 1)
                cost = sum(max(0, min(box[2], b[2]) - max(box[0], b[0])) * max(0, min(box[3], b[3]) - max(box[1], b[1])) for b in taken)
                if best is None or cost < best[0]:
                    best = (cost, tx, ty, box)
        taken.append(best[3])
        out[n] = (best[1], best[2], *best[3], best[0])
    return out


@pytest.mark.parametrize("below_first", [False, True])
def test_places(spark, below_first):
    rng, font = random.Random(1), placement.Font(3, 5, 2)
    size = {i: (rng.randint(20, 120), rng.randint(20, 90)) for i in range(12)}
    labels = [(i, n, "x" * rng.randint(0, 20), rng.randint(0, size[i][0]), (t := rng.randint(0, size[i][1])), t + rng.randint(0, 20)) for i in size for n in range(rng.randint(1, 7))]
    boxes = [(i, x, y, x + rng.randint(1, 40), y + rng.randint(1, 40)) for i in size for _ in range(rng.randint(0, 4)) for x, y in [(rng.randint(0, 60), rng.randint(0, 60))]]
    got = placement.placed(
        spark.createDataFrame(labels, "image_id int, n int, text string, x int, top int, bottom int"), spark.createDataFrame([(i, *s) for i, s in size.items()], "image_id int, w int, h int"),
        spark.createDataFrame(boxes, "image_id int, x1 int, y1 int, x2 int, y2 int"), font, below_first,
    )
    rows = {(r.image_id, r.n): (r.text_x, r.text_y, r.x1, r.y1, r.x2, r.y2, r.overlap) for r in got.collect()}
    want = {(i, n): v for i, (w, h) in size.items() for n, v in plain_places([x[1:] for x in labels if x[0] == i], w, h, [b[1:] for b in boxes if b[0] == i], font, below_first).items()}
    assert rows == want


def test_annotations_have_places(spark):
    y, x = np.mgrid[:48, :64]
    water = (x - 30) ** 2 + (y - 20) ** 2 <= 36
    px = spark.createDataFrame([(1, int(b), int(a), 64, 48, bool(water[b, a]), False) for b in range(48) for a in range(64)], "image_id int, y int, x int, w int, h int, water boolean, canopy boolean")
    made = analysis.of_masks(px, mini())
    rows = views.annotations(made).collect()
    assert {r.view for r in rows} == {"sensor_zones", "supply_zones", "final_analysis"}
    assert all(r.x1 == r.text_x - 3 and r.y1 == r.text_y - 15 and r.x2 > r.x1 for r in rows)
    final = [r for r in rows if r.view == "final_analysis"]
    assert {r.text.split()[0] for r in final} == {"Sensor", "Supply"}


# --- streams -----------------------------------------------------------------------------


def write_files(folder):
    folder.mkdir()
    for name, size, level in (("a.png", (64, 64), 90), ("b.png", (70, 80), 10), ("small.png", (32, 80), 1)):
        (folder / name).write_bytes(images.png(np.full((*size, 3), level, np.uint8)))
    (folder / "corrupt.jpg").write_bytes(b"\x01\x02" * 2000)
    (folder / "notes.txt").write_text("no picture")


CODES = {"small.png": "IMAGE_TOO_SMALL", "corrupt.jpg": "CORRUPT_IMAGE", "notes.txt": "UNSUPPORTED_FILE_TYPE"}


def brightness(px):
    return px.groupBy("image_id").agg(F.avg("b").alias("b"))


def name(path):
    return path.rsplit("/", 1)[1]


def test_every_file_of_a_stream_has_a_row(spark, tmp_path):
    write_files(tmp_path / "in")
    where = {k: str(tmp_path / k) for k in ("in", "out", "ck", "out-refused")}
    for _ in range(2):  # the second run finds nothing new
        directory.watch(spark, where["in"], where["out"], where["ck"], brightness, files=2).awaitTermination(120)
    good, bad = spark.read.parquet(where["out"]), spark.read.parquet(where["out-refused"])
    assert {name(r.image_id): r.b for r in good.collect()} == {"a.png": 90.0, "b.png": 10.0} and good.count() == 2
    assert {name(r.image_id): r.status for r in bad.collect()} == CODES and bad.count() == 3
    assert good.select("batch").distinct().count() + bad.select("batch").distinct().count() >= 3
    (tmp_path / "in" / "c.png").write_bytes(images.png(np.full((64, 64, 3), 30, np.uint8)))
    directory.watch(spark, where["in"], where["out"], where["ck"], brightness, files=2).awaitTermination(120)
    assert sorted(r.b for r in spark.read.parquet(where["out"]).collect()) == [10.0, 30.0, 90.0]


def test_a_replayed_batch_is_written_once(spark, tmp_path):
    write_files(tmp_path / "in")
    rows = images.decoded(spark.read.format("image").option("dropInvalid", False).load(str(tmp_path / "in")))
    out, refused = str(tmp_path / "out"), str(tmp_path / "refused")

    def stops(px):
        raise RuntimeError("the driver was lost")

    with pytest.raises(RuntimeError):
        directory.store_batch(rows, 7, out, refused, stops)
    for _ in range(2):
        directory.store_batch(rows, 7, out, refused, brightness)
    directory.store_batch(rows.where("false"), 8, out, refused, brightness)
    assert sorted(r.b for r in spark.read.parquet(out).collect()) == [10.0, 90.0]
    assert {name(r.image_id): r.status for r in spark.read.parquet(refused).collect()} == CODES


def test_one_scan_tells_all(spark, tmp_path):
    write_files(tmp_path / "in")
    (tmp_path / "in" / "empty.png").write_bytes(b"")
    rows = images.decoded_images(spark, str(tmp_path / "in"), replace(Config(), max_bytes=3900)).collect()
    assert {name(r.image_id): r.status for r in rows} == CODES | {"a.png": "OK", "b.png": "OK", "empty.png": "EMPTY_FILE", "corrupt.jpg": "FILE_TOO_LARGE"}
    assert all((r.data is not None) == (r.status == "OK") for r in rows)
    assert {name(r.image_id): (r.w, r.h) for r in rows}["b.png"] == (80, 70)


# --- inference ---------------------------------------------------------------------------


def pictures(spark, n=5, level=7):
    px = [(i, y, x, 64, 48, (level * i + x) % 256, y, 5) for i in range(n) for y in range(48) for x in range(64)]
    return images.from_pixels(spark.createDataFrame(px, "image_id int, y int, x int, w int, h int, b int, g int, r int"))


def test_pixels_to_pictures_and_tensors(spark):
    rows = pictures(spark, 2).collect()
    for r in rows:
        a = np.frombuffer(r.data, np.uint8).reshape(48, 64, 3)
        assert a[3, 10].tolist() == [7 * r.image_id + 10, 3, 5] and (r.status, r.channels) == ("OK", 3)
    t = inference.tensor([np.full((4, 4, 3), (0, 51, 255), np.uint8)] * 3)
    assert t.shape == (3, 3, 4, 4) and t.dtype == np.float32 and t[0, :, 1, 2].tolist() == [1.0, np.float32(0.2), 0.0]


@pytest.mark.parametrize("batch", [1, 2, 8])
def test_failures_are_statuses(spark, batch):
    cfg = replace(mini(), detector_input=64)

    def fragile():
        good = detail_queries.cell_model()

        def predict(x):
            first = np.rint(x[:, 2, 8, 0] * 255)  # of the blue channel, the image's number times seven
            if (first == 7).any():
                raise ValueError("not this one")
            if (first == 14).any():
                raise MemoryError
            return good(x)

        return predict

    got = {r.image_id: r for r in inference.predicted(pictures(spark), fragile, cfg, batch).collect()}
    assert {i: r.ai_status for i, r in got.items()} == {0: "active", 1: "failed", 2: "skipped", 3: "active", 4: "active"}
    assert got[1].anchors == [] and len(got[3].anchors) > 0 and all(max(a.scores) >= cfg.confidence for a in got[3].anchors)

    def missing():
        raise FileNotFoundError("no weights")

    assert {r.ai_status for r in inference.predicted(pictures(spark, 2), missing, cfg, batch).collect()} == {"unavailable"}
    assert {r.ai_status for r in inference.predicted(pictures(spark, 2), lambda: lambda x: np.zeros((1, 2)), cfg, batch).collect()} == {"failed"}


def test_objects_reach_the_report(spark, tmp_path):
    rng = np.random.default_rng(0)
    (tmp_path / "in").mkdir()
    for i in range(2):
        scene = np.full((64, 96, 3), (60, 110, 70), np.uint8) + rng.integers(0, 30, (64, 96, 3)).astype(np.uint8)
        (tmp_path / "in" / f"{i}.png").write_bytes(images.png(scene))
    cfg = replace(mini(), detector_input=64)
    docs = {r.image_id: json.loads(r.doc) for r in analysis.analyse(spark, str(tmp_path / "in"), cfg, detector=detail_queries.cell_model).collect()}
    assert len(docs) == 2
    for d in docs.values():
        ai = d["ai"]
        assert ai["status"] == "active" and d["analysis_mode"]["ai"] and sum(ai["counts"].values()) == len(ai["detections"]) and len(ai["counts"]) == len(detect.CLASSES)
        assert all(0 <= b["bbox"]["x1"] < b["bbox"]["x2"] <= 96 for b in ai["detections"])

    def missing():
        raise OSError

    for r in analysis.analyse(spark, str(tmp_path / "in"), cfg, detector=missing).collect():
        d = json.loads(r.doc)
        assert d["ai"] == {"status": "unavailable", "message": "No detector is available."} and d["success"] and not d["analysis_mode"]["ai"]


# --- reports -----------------------------------------------------------------------------


def test_reports_are_read_back(spark):
    y, x = np.mgrid[:48, :64]
    water = (x - 30) ** 2 + (y - 20) ** 2 <= 36
    px = spark.createDataFrame([(1, int(b), int(a), 64, 48, bool(water[b, a]), False) for b in range(48) for a in range(64)], "image_id int, y int, x int, w int, h int, water boolean, canopy boolean")
    made = analysis.of_masks(px, mini())
    doc = report.report(made.summary, made.zones, made.sensors, made.segments, made.isolated, mini()).first().doc
    whole = json.loads(doc)
    without = lambda *keys: json.dumps({k: v for k, v in whole.items() if k not in keys})
    cases = {
        "OK": [doc, without("warnings", "zones")],
        "EMPTY_RESULT": [without("metrics"), without("success"), json.dumps(whole | {"success": False}), "{}"],
        "INCOMPATIBLE_BACKEND": [without("sensor_zones"), without("supply_zone"), json.dumps(whole | {"parameters": {}})],
        "MALFORMED_RESPONSE": [doc[:-1], doc[: len(doc) // 2], json.dumps(whole | {"sensor_zones": 3}), json.dumps(whole | {"metrics": [1]}), "", None, "report"],
    }
    rows = [(k, d) for k, docs in cases.items() for d in docs]
    got = report.read_back(spark.createDataFrame(rows, "want string, doc string")).collect()
    assert [r.report_status for r in got] == [k for k, _ in rows]
    first = got[0].report
    assert first.metrics.sensor_zones == whole["metrics"]["sensor_zones"] == len(first.sensor_zones) and first.sensor_zones[0].center.x == whole["sensor_zones"][0]["center"]["x"]


# --- rounding, environment, table function, edges ----------------------------------------


def test_rounding_is_pythons(spark):
    from pixelloom.functions.rounding import exact_round

    rng = random.Random(5)
    values = [rng.choice([rng.uniform(-1000, 1000), rng.randrange(-99999, 99999) / 1000, rng.randrange(-9999, 9999) / 8, rng.uniform(0, 1) * 10 ** rng.randint(-9, 15)]) for _ in range(10_000)]
    values += [2.675, 0.125, -0.125, 1.005, 0.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", *[exact_round(F.col("v"), d).alias(f"d{d}") for d in (0, 1, 2, 4)])
    for r in df.collect():
        v = values[r.i]
        assert [r.d0, r.d1, r.d2, r.d4] == [None if v is None else round(v, d) for d in (0, 1, 2, 4)]


def test_environment():
    from pixelloom.config import from_env

    c = from_env({"DETECTOR_ENABLED": " Off ", "DETECTOR_CLASSES": " car, ,boat,", "DISTANCE_METRIC": "Chamfer5", "DETECTOR_INPUT": "500"})
    assert (c.detector_enabled, c.detector_classes, c.metric, c.detector_input) == (False, ("car", "boat"), "chamfer5", 480)
    assert from_env({}) == Config()
    assert [from_env({"DETECTOR_ENABLED": v}).detector_enabled for v in ("1", "true", "yes", "0", "FALSE", "no", "")] == [True, True, True, False, False, False, False]


def test_classes_and_switch_are_used(spark, tmp_path):
    cfg = replace(mini(), detector_input=64)
    seen = inference.predicted(pictures(spark, 3), detail_queries.cell_model, cfg)
    every, some = (inference.object_context(seen, c) for c in (cfg, replace(cfg, detector_classes=("car", "boat"))))
    labels = {r.label for r in every[0].collect()}
    assert {r.label for r in some[0].collect()} == labels & {"car", "boat"} and set(some[1].first().counts) == {"car", "boat"}
    (tmp_path / "a.png").write_bytes(images.png(np.full((64, 96, 3), (60, 110, 70), np.uint8)))
    d = json.loads(analysis.analyse(spark, str(tmp_path), replace(cfg, detector_enabled=False), detector=detail_queries.cell_model).first().doc)
    assert d["ai"] == {"status": "unavailable"}


def test_table_function(spark):
    from pixelloom.operators import tables, whole

    rng = np.random.default_rng(2)
    rows = [(f"i{i}", y, x, bool(rng.random() < 0.6)) for i, (h, w) in enumerate([(5, 9), (1, 4), (12, 3)]) for y in range(h) for x in range(w)]
    px = spark.createDataFrame(rows, "image_id string, y int, x int, mask boolean")
    px.createOrReplaceTempView("some_pixels")
    tables.register(spark, "parts_of_images", kind="string", padded=True)
    got = spark.sql("SELECT * FROM parts_of_images(TABLE(SELECT image_id, y, x, mask FROM some_pixels) PARTITION BY image_id ORDER BY (y, x))")
    want = whole.add(px, label=whole.labels("mask"), d2=whole.squared("mask", padded=True)).drop("mask")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select("image_id", "y", "x", "label", "d2").collect()))


def test_places_of_labels_that_know_their_frame(spark):
    """Labels with w and h need no frames, and are read once: what they carry goes along."""
    labels = spark.createDataFrame([(i, n, "x" * (3 * n), 5 * n, 4, 9, f"note {i}{n}", 60 + i, 40) for i in range(3) for n in (1, 2, 5)], "image_id int, n int, text string, x int, top int, bottom int, note string, w int, h int")
    boxes = spark.createDataFrame([(0, 1, 1, 30, 20)], "image_id int, x1 int, y1 int, x2 int, y2 int")
    alone = placement.placed(labels, None, boxes)
    want = placement.placed(labels.drop("w", "h"), labels.select("image_id", "w", "h").distinct(), boxes)
    assert sorted(map(tuple, alone.drop("w", "h").collect())) == sorted(map(tuple, want.collect())) and alone.count() == 9
    assert alone._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
