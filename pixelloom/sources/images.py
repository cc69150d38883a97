"""Image files in, pixel tables out; and PNG bytes back.

Decoding is Spark's own image source, so any file system that Spark reads will
do. Files that cannot be used keep a row with an error code.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import whole

PIXELS = "image_id string, y int, x int, w int, h int, b short, g short, r short"


def extension_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def upload_status(name: Column, mime: Column, length: Column, cfg: Config = Config()) -> Column:
    """OK, or the first reason to refuse an upload."""
    kind = F.lower(F.trim(F.split(F.coalesce(mime, F.lit("")), ";")[0]))
    return (
        F.when(~extension_of(name).isin(*cfg.extensions), "UNSUPPORTED_FILE_TYPE")
        .when((kind != "") & ~kind.isin(*cfg.mime_types), "UNSUPPORTED_MEDIA_TYPE")
        .when(length == 0, "EMPTY_FILE")
        .when(length > cfg.max_bytes, "FILE_TOO_LARGE")
        .otherwise("OK")
    )


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "file:/")


def image_files(spark: SparkSession, path: str, cfg: Config = Config(), manifest: DataFrame | None = None) -> DataFrame:
    """(image_id, status, bytes) of the files under ``path``; file contents are not read.

    Scans pass over empty files. A ``manifest`` (image_id, bytes) of what was uploaded tells
    of these, and of files that are missing; without one, the names that Spark has listed
    for the scan do, which the driver holds anyway."""
    source = spark.read.format("binaryFile").load(path)
    files = source.select(F.col("path").alias("image_id"), F.col("length").alias("bytes"))
    if manifest is None:
        listed = spark.createDataFrame([(f,) for f in source.inputFiles()], "name string").select(F.url_decode(F.replace("name", F.lit("+"), F.lit("%2B"))).alias("image_id"))
        manifest = listed.select("image_id", F.lit(0).cast("long").alias("bytes"))
    absent = manifest.select(_plain(F.col("image_id")).alias("image_id"), F.lit(0).cast("long").alias("bytes")).join(files.select(_plain(F.col("image_id")).alias("image_id")), "image_id", "left_anti")
    files = files.unionByName(absent)
    return files.withColumn("status", upload_status(F.col("image_id"), F.lit(""), F.col("bytes"), cfg))


def decoded(raw: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(image_id, bytes, status, w, h, channels, data) of a scan of Spark's image source that keeps
    what is invalid: name, size and picture come from one reading. Refused pictures have no data."""
    seen = raw.select(_plain(F.col("image.origin")).alias("image_id"), F.col("_metadata.file_size").alias("bytes"), "image.height", "image.width", "image.nChannels", "image.data")
    first = upload_status(F.col("image_id"), F.lit(""), F.col("bytes"), cfg)
    status = F.when(first != "OK", first).when(F.coalesce(F.col("height"), F.lit(-1)) <= 0, "CORRUPT_IMAGE").when(F.least("height", "width") < cfg.min_side, "IMAGE_TOO_SMALL").otherwise("OK")
    out = seen.withColumn("status", status)
    known = lambda c: F.when(F.col(c) > 0, F.col(c))
    return out.select("image_id", "bytes", "status", known("width").alias("w"), known("height").alias("h"), known("nChannels").alias("channels"), F.when(F.col("status") == "OK", F.col("data")).alias("data"))


def decoded_images(spark: SparkSession, path: str, cfg: Config = Config(), manifest: DataFrame | None = None) -> DataFrame:
    """``decoded`` of all files under ``path``, and rows for those that scans pass over."""
    found = decoded(spark.read.format("image").option("dropInvalid", False).load(path), cfg)
    absent = image_files(spark, path, cfg, manifest).where("bytes = 0").select(_plain(F.col("image_id")).alias("image_id"), "bytes", "status")
    return found.unionByName(absent, allowMissingColumns=True)


def processed_size(images: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Adds scale, new_w, new_h: the longest side at most ``max_side``."""
    scale = F.least(F.lit(1.0), F.lit(float(cfg.max_side)) / F.greatest("w", "h"))
    side = lambda c: F.greatest(F.lit(1), F.bround(F.col(c) * F.col("scale")).cast("int"))
    return images.withColumn("scale", scale).withColumn("new_w", side("w")).withColumn("new_h", side("h"))


def area_weights(n: int, m: int) -> np.ndarray:
    """m x n matrix: the share of each source pixel in each target pixel."""
    at = np.arange(m) * n / m
    upto = (np.arange(m) + 1) * n / m
    k = np.arange(n)
    overlap = np.clip(np.minimum(upto[:, None], k[None] + 1) - np.maximum(at[:, None], k[None]), 0, None)
    return overlap * m / n


def linear_weights(n: int, m: int) -> np.ndarray:
    """m x n matrix of linear interpolation between pixel centres, for scaling up."""
    at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
    low = np.floor(at).astype(int)
    out = np.zeros((m, n))
    out[np.arange(m), low] = 1 - (at - low)
    out[np.arange(m), np.minimum(low + 1, n - 1)] += at - low
    return out


def resized(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """An H x W x 3 array at another size: by area where it shrinks, linear where it grows."""
    weights = [(area_weights if m <= n else linear_weights)(n, m) for n, m in zip(a.shape[:2], (h, w), strict=True)]
    rows = np.tensordot(weights[0], a.astype(float), axes=(1, 0))
    return np.floor(np.tensordot(weights[1], rows, axes=(1, 1)).transpose(1, 0, 2) + 0.5).astype(np.uint8)


def pixels(images: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Pixel rows of the images that are OK, scaled down by area to at most ``max_side``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                a = np.frombuffer(row.data, np.uint8).reshape(row.h, row.w, row.channels)[:, :, :3]
                a = np.repeat(a, 3, axis=2) if row.channels == 1 else a
                if (row.new_h, row.new_w) != (row.h, row.w):
                    a = resized(a, row.new_h, row.new_w)
                y, x = np.divmod(np.arange(row.new_h * row.new_w), row.new_w)
                flat = a.reshape(-1, 3).astype(np.int16)
                yield pd.DataFrame({"image_id": row.image_id, "y": y.astype(np.int32), "x": x.astype(np.int32), "w": np.int32(row.new_w), "h": np.int32(row.new_h), "b": flat[:, 0], "g": flat[:, 1], "r": flat[:, 2]})

    return processed_size(images.where("status = 'OK'"), cfg).mapInPandas(run, PIXELS).repartition("image_id")


def from_pixels(px: DataFrame) -> DataFrame:
    """Images (image_id, status, w, h, channels, data) from pixel rows b, g, r again."""
    kind = px.schema["image_id"].dataType.simpleString()

    def work(table: pa.Table) -> pa.Table:
        bounds = whole.groups(table.column("image_id"))
        flat = np.stack([table.column(c).to_numpy() for c in "bgr"], axis=1).astype(np.uint8)
        first = table.take(pa.array(bounds[:-1]))
        n = len(bounds) - 1
        data = [flat[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        size = [pa.array(first.column(c).to_numpy().astype(np.int32)) for c in ("w", "h")]
        return pa.table([first.column("image_id"), pa.array(["OK"] * n), *size, pa.array([3] * n, pa.int32()), pa.array(data, pa.binary())], ["image_id", "status", "w", "h", "channels", "data"])

    return whole.stream(px.select("image_id", "y", "x", "w", "h", *"bgr"), ["y", "x"], work, f"image_id {kind}, status string, w int, h int, channels int, data binary")


def fitted(row, size: int) -> np.ndarray:
    """The picture of a row of ``letterbox``, within a square of grey (114): B, G, R by line and pixel."""
    a = np.frombuffer(row.data, np.uint8).reshape(row.h, row.w, row.channels)[:, :, :3]
    a = np.repeat(a, 3, axis=2) if row.channels == 1 else a
    canvas = np.full((size, size, 3), 114, np.uint8)
    canvas[row.pad_y : row.pad_y + row.new_h, row.pad_x : row.pad_x + row.new_w] = a if (row.new_h, row.new_w) == a.shape[:2] else resized(a, row.new_h, row.new_w)
    return canvas


def letterboxed(images: DataFrame, size: int) -> DataFrame:
    """Pixel rows of the images that are OK, each fitted into size x size between grey borders
    (114), with ratio and pads: the detector's input."""
    from ..operators.detect import letterbox

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        y, x = np.divmod(np.arange(size * size, dtype=np.int32), size)
        for frame in frames:
            for row in frame.itertuples():
                flat = fitted(row, size).reshape(-1, 3).astype(np.int16)
                yield pd.DataFrame({"image_id": row.image_id, "y": y, "x": x, "b": flat[:, 0], "g": flat[:, 1], "r": flat[:, 2], "ratio": row.ratio, "pad_x": row.pad_x, "pad_y": row.pad_y})

    sized = letterbox(images.where("status = 'OK'"), size)
    return sized.mapInPandas(run, "image_id string, y int, x int, b short, g short, r short, ratio double, pad_x int, pad_y int")


def png(pixels_: np.ndarray) -> bytes:
    """A PNG file of an H x W x 3 array of B, G, R."""
    h, w, _ = pixels_.shape
    rgb = pixels_[:, :, ::-1].astype(np.uint8)
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rgb.reshape(h, w * 3)], axis=1).tobytes()
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw, 6)) + part(b"IEND", b"")


def pngs(px: DataFrame) -> DataFrame:
    """(image_id, png) from pixel rows b, g, r; several images (of at most a million pixels) to a batch."""

    def draw(table: pa.Table) -> pa.Table:
        bounds = whole.groups(table.column("image_id"))
        flat = np.stack([table.column(c).to_numpy() for c in "bgr"], axis=1)
        y, x = (table.column(c).to_numpy() for c in ("y", "x"))
        files = [png(flat[a:b].reshape(y[b - 1] + 1, x[b - 1] + 1, 3)) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        return pa.table([table.column("image_id").take(pa.array(bounds[:-1])), pa.array(files, pa.binary())], ["image_id", "png"])

    rows = px.select(F.col("image_id").cast("string").alias("image_id"), "y", "x", "b", "g", "r")
    return whole.stream(rows, ["y", "x"], draw, "image_id string, png binary")


# --- views: per-pixel drawing --------------------------------------------------------


def tint(px: DataFrame, mask: str, bgr: tuple[int, int, int], alpha: float) -> DataFrame:
    """Blend a colour over the pixels of a mask."""
    mixed = {c: F.when(F.col(mask), F.floor((1 - alpha) * F.col(c) + alpha * v + 0.5)).otherwise(F.col(c)).cast("short") for c, v in zip("bgr", bgr, strict=True)}
    return px.withColumns(mixed)


def dimmed(px: DataFrame) -> DataFrame:
    """Darkened grey copy, the ground of every view."""
    from ..functions.colour import gray

    level = F.floor(0.55 * gray(F.col("b"), F.col("g"), F.col("r")) + 0.5).cast("short")
    return px.withColumns({c: level for c in "bgr"})
