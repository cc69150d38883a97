"""Whole-image operators as table functions, for users of SQL:

    SELECT * FROM image_components(TABLE(SELECT image_id, y, x, water AS mask FROM px) PARTITION BY image_id ORDER BY (y, x))

The function gets the pixels of one image at a time, in Arrow batches, and gives a row for
each: its component's label (null off the mask) and its squared distance to the nearest
pixel off the mask (null if there is none). Images are full rectangles of at most a
million pixels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import whole


def components_function(kind: str = "bigint", padded: bool = False):
    """The table function for image ids of a type; ``padded``: all outside of the image is off the mask."""

    class Components:
        def __init__(self) -> None:
            self.held: list[pa.RecordBatch] = []

        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
            self.held.append(rows)
            return iter(())

        def terminate(self) -> Iterator[pa.Table]:
            if not self.held:
                return
            table = pa.Table.from_batches(self.held).combine_chunks()
            ids, y, x, mask = (table.column(c) for c in range(4))
            h, w = int(y[-1].as_py() - y[0].as_py() + 1), int(x[-1].as_py() - x[0].as_py() + 1)
            if h * w != table.num_rows:
                raise ValueError("the pixels of an image are not a full rectangle in order")
            on = mask.to_numpy().reshape(1, h, w)
            found, d = whole.label(on).ravel(), whole.squared_distance(on, padded).ravel()
            at = pa.array(found // w * whole.LINE + found % w, mask=found < 0)
            yield pa.table([ids, y, x, at, pa.array(d.astype(np.int64), mask=d >= whole.FAR)], ["image_id", "y", "x", "label", "d2"])

    return F.arrow_udtf(Components, returnType=f"image_id {kind}, y int, x int, label bigint, d2 bigint")


def register(spark: SparkSession, name: str = "image_components", **options) -> None:
    spark.udtf.register(name, components_function(**options))
