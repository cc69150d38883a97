"""A detector over many images: fixed-shape tensors in, anchors out.

The model is the user's: a function without arguments that loads it (once a task, in the
worker) and returns ``predict(tensors) -> raw``, with tensors of shape (n, 3, size, size), R, G, B
from 0 to 1, and raw output of shape (n, 4 + classes, anchors): boxes as centre and size in the
tensor's pixels, then a score for each class.

Nothing is raised for an image that the model cannot take: a batch that fails is tried again
image by image, and what still fails has a status in place of anchors, as has every image
where no model could be loaded. Images are few rows of megabytes, so a batch is a stated
number of images, and of the anchors only those go on that could be reported.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..sources.images import fitted
from . import detect

Predict = Callable[[np.ndarray], np.ndarray]
#: Statuses, and what the report says of them.
ACTIVE, UNAVAILABLE, FAILED, SKIPPED = "active", "unavailable", "failed", "skipped"
MESSAGES = {
    ACTIVE: "Objects a detector saw, for context only; they take no part in the analysis.",
    UNAVAILABLE: "No detector is available.",
    FAILED: "The detector failed on this image.",
    SKIPPED: "This image was left out, as memory did not suffice.",
}


def tensor(pictures: list[np.ndarray]) -> np.ndarray:
    """(n, 3, size, size) of R, G, B in 0 to 1 from pictures of B, G, R by line and pixel."""
    stack = np.stack(pictures)[:, :, :, ::-1].transpose(0, 3, 1, 2)
    return np.ascontiguousarray(stack, dtype=np.float32) / np.float32(255)


def _outcomes(predict: Predict, pictures: list[np.ndarray]) -> Iterator[tuple[str, np.ndarray | None]]:
    """Status and raw output of each picture."""
    try:
        raw = np.asarray(predict(tensor(pictures)))
        if len(raw) != len(pictures) or raw.ndim != 3 or raw.shape[1] < 5:
            raise ValueError(f"a detector returned {raw.shape}")
        yield from ((ACTIVE, r) for r in raw)
    except Exception as e:  # noqa: BLE001  whatever a model does, the analysis goes on
        if len(pictures) == 1:
            yield (SKIPPED if isinstance(e, MemoryError) else FAILED), None
        else:
            for p in pictures:
                yield from _outcomes(predict, [p])


def predicted(images: DataFrame, model: Callable[[], Predict], cfg: Config = Config(), batch: int = 8) -> DataFrame:
    """(image_id, w, h, ratio, new_w, new_h, pad_x, pad_y, ai_status, anchors) of images (image_id, status, w,
    h, channels, data) that are OK; anchors: anchor_id, cx, cy, bw, bh and scores of those whose best score
    reaches the configured confidence."""
    size, least = cfg.detector_input, cfg.confidence
    sized = detect.letterbox(images.where("status = 'OK'").select("image_id", "w", "h", "channels", "data"), size)
    kept = ["image_id", "w", "h", "ratio", "new_w", "new_h", "pad_x", "pad_y"]
    anchor = pa.list_(pa.struct([("anchor_id", pa.int32()), *[(c, pa.float64()) for c in ("cx", "cy", "bw", "bh")], ("scores", pa.list_(pa.float64()))]))

    def confident(raw: np.ndarray | None) -> list[dict]:
        if raw is None:
            return []
        scores = raw[4:].T.astype(float)
        return [{"anchor_id": int(i), **dict(zip(("cx", "cy", "bw", "bh"), raw[:4, i].astype(float).tolist(), strict=True)), "scores": scores[i].tolist()} for i in np.flatnonzero(scores.max(axis=1) >= least)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = None
        try:
            predict = model()
        except Exception:  # noqa: BLE001
            pass
        for record in batches:
            for at in range(0, record.num_rows, batch):
                some = record.slice(at, batch)
                rows: list = list(pd.DataFrame({c: some.column(c).to_pylist() for c in some.schema.names}).itertuples())
                found = [(UNAVAILABLE, None)] * len(rows) if predict is None else list(_outcomes(predict, [fitted(r, size) for r in rows]))
                columns = [some.column(c) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([s for s, _ in found]), pa.array([confident(r) for _, r in found], anchor)], [*kept, "ai_status", "anchors"])

    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in (sized.schema[c] for c in kept))
    return sized.mapInArrow(run, f"{own}, ai_status string, anchors array<struct<anchor_id:int,cx:double,cy:double,bw:double,bh:double,scores:array<double>>>")


def anchors(predicted_: DataFrame) -> DataFrame:
    """Anchors as rows, for ``detect.candidates``."""
    return predicted_.select("image_id", F.inline("anchors"))


def object_context(predicted_: DataFrame, cfg: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """What the report tells: (boxes after suppression, (image_id, ai_status, ai_message, counts) of every
    image). ``predicted_`` should be stored."""
    sized = predicted_.drop("anchors", "ai_status")
    classes = {k: v for k, v in detect.CLASSES.items() if not cfg.detector_classes or v in cfg.detector_classes}
    found = detect.detections(detect.suppressed(detect.candidates(anchors(predicted_), sized, classes, cfg), cfg), cfg)
    counts = detect.counts_map(detect.class_counts(found, sized, classes))
    said = F.create_map(*[F.lit(v) for kv in MESSAGES.items() for v in kv])
    return found, predicted_.select("image_id", "ai_status", said[F.col("ai_status")].alias("ai_message")).join(counts, "image_id")
