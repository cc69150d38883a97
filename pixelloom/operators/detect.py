"""Decoding of raw object-detector output: one row for each anchor."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from . import whole

#: The reported classes by their ids in the detector's 80-class list (fixed values).
CLASSES = {0: "person", 1: "bicycle", 2: "car", 3: "motorcycle", 5: "bus", 7: "truck", 8: "boat"}


def letterbox(images: DataFrame, size: int) -> DataFrame:
    """Adds ratio, new_w, new_h, pad_x, pad_y for images (w, h) fitted into size x size."""
    ratio = F.least(F.lit(float(size)) / F.col("h"), F.lit(float(size)) / F.col("w"))
    side = lambda c: F.greatest(F.lit(1), F.bround(F.col(c) * F.col("ratio")).cast("int"))
    out = images.withColumn("ratio", ratio).withColumn("new_w", side("w")).withColumn("new_h", side("h"))
    return out.withColumn("pad_x", F.expr(f"({size} - new_w) div 2").cast("int")).withColumn("pad_y", F.expr(f"({size} - new_h) div 2").cast("int"))


def candidates(anchors: DataFrame, images: DataFrame, classes: dict[int, str] = CLASSES, cfg: Config = Config()) -> DataFrame:
    """Confident anchors of the reported classes with boxes in image pixels.

    ``anchors``: image_id, anchor_id, cx, cy, bw, bh, scores (array); ``images``: image_id,
    w, h and the letterbox columns, one small row an image."""
    best = F.array_max("scores")
    out = anchors.select("image_id", "anchor_id", "cx", "cy", "bw", "bh", best.alias("confidence"), (F.array_position("scores", best) - 1).cast("int").alias("class_id"))
    names = F.create_map(*[x for k, v in classes.items() for x in (F.lit(k), F.lit(v))])
    out = out.where((F.col("confidence") >= cfg.confidence) & F.col("class_id").isin(*classes)).withColumn("label", names[F.col("class_id")]).join(images, "image_id")
    edge = lambda c, d, sign, pad, most: F.least(F.greatest((F.col(c) + sign * F.col(d) / 2.0 - F.col(pad)) / F.col("ratio"), F.lit(0.0)), F.col(most).cast("double"))
    return out.select(
        "image_id", "anchor_id", "class_id", "label", "confidence",
        edge("cx", "bw", -1, "pad_x", "w").alias("x1"), edge("cy", "bh", -1, "pad_y", "h").alias("y1"), edge("cx", "bw", 1, "pad_x", "w").alias("x2"), edge("cy", "bh", 1, "pad_y", "h").alias("y2"),
    )


def suppressed(boxes: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Greedy non-maximum suppression within each class of an image; an image's anchors are a few thousand."""
    iou = cfg.nms_iou

    def keep(table: pa.Table) -> pa.Table:
        x1, y1, x2, y2 = (table.column(c).to_numpy() for c in ("x1", "y1", "x2", "y2"))
        area = (x2 - x1) * (y2 - y1)
        alive = np.ones(table.num_rows, bool)
        bounds = whole.groups(table.column("image_id"), table.column("class_id"))
        for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            for i in range(start, end - 1):  # the most confident first
                if alive[i]:
                    j = np.s_[i + 1 : end]
                    w = np.minimum(x2[i], x2[j]) - np.maximum(x1[i], x1[j])
                    h = np.minimum(y2[i], y2[j]) - np.maximum(y1[i], y1[j])
                    both = np.maximum(w, 0) * np.maximum(h, 0)
                    alive[j] &= ~((both > 0) & (both > iou * (area[i] + area[j] - both)))
        return table.filter(pa.array(alive))

    return whole.stream(boxes, ["class_id", F.desc("confidence"), "anchor_id"], keep, boxes.schema)


def detections(boxes: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Whole-pixel boxes, most confident first, at most ``max_detections`` an image."""
    whole = [F.bround(c).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")]
    out = boxes.select("image_id", "anchor_id", "class_id", "label", F.round("confidence", 4).alias("confidence"), *whole).where("x2 > x1 and y2 > y1")
    by = Window.partitionBy("image_id").orderBy(F.desc("confidence"), "class_id", "anchor_id")
    return out.withColumn("n", F.row_number().over(by)).where(F.col("n") <= cfg.max_detections)


def class_counts(found: DataFrame, images: DataFrame, classes: dict[int, str] = CLASSES) -> DataFrame:
    """Detections of every class in every image, zeros included."""
    labels = F.explode(F.array(*[F.lit(v) for v in classes.values()])).alias("label")
    n = found.groupBy("image_id", "label").agg(F.count("*").alias("n"))
    return images.select("image_id", labels).join(n, ["image_id", "label"], "left").select("image_id", "label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def counts_map(counts: DataFrame) -> DataFrame:
    return counts.groupBy("image_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("counts"))


def context(anchors: DataFrame, images: DataFrame, cfg: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """What a detector saw: (whole-pixel boxes after suppression, counts by class in a map for
    every image), from raw anchors and images (image_id, w, h)."""
    sized = letterbox(images.select("image_id", "w", "h"), cfg.detector_input)
    found = detections(suppressed(candidates(anchors, sized, cfg=cfg), cfg), cfg)
    return found, counts_map(class_counts(found, sized))


def class_names(metadata: Column) -> Column:
    """The id -> name map of a model's metadata string, or the known classes where it can't be read."""
    # the string is a literal of a dictionary: {0: 'person', 1: "bicycle"}
    quoted = F.regexp_replace(F.regexp_replace(metadata, "'", '"'), r"(\d+)\s*:", '"$1":')
    names = F.from_json(quoted, "map<string,string>", {"mode": "PERMISSIVE"})
    known = F.create_map(*[x for k, v in CLASSES.items() for x in (F.lit(str(k)), F.lit(v))])
    return F.coalesce(F.when(F.size(names) > 0, names), known)
