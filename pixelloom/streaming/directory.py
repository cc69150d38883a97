"""Images as they arrive in a directory: the batch stages on each micro-batch.

Images are independent, so there is no state and no watermark. Every file of a batch has
a row in one of two tables: what the analysis gives, or the quarantine with an error code.
Both are kept by batch number and written anew when Spark replays a batch, so no file is
lost and none counts twice, whenever the stream is stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..sources import images
from ..store import scope


def store_batch(rows: DataFrame, number: int, out: str, refused: str, analyse: Callable[[DataFrame], DataFrame], cfg: Config = Config()) -> None:
    """Write one batch (of ``images.decoded`` rows) in place of what an earlier attempt at it has
    written. What the analysis stores on its way goes at the end."""
    spark = rows.sparkSession
    with scope(spark):
        rows = rows.persist()  # both tables come from one reading; lost parts are decoded again
        try:
            codes = rows.where("status <> 'OK'").select("image_id", "status", "bytes")
            codes.write.mode("overwrite").parquet(f"{refused}/batch={number}")
            analyse(images.pixels(rows, cfg)).write.mode("overwrite").parquet(f"{out}/batch={number}")
        finally:
            rows.unpersist()


def watch(spark: SparkSession, path: str, out: str, checkpoint: str, analyse: Callable[[DataFrame], DataFrame], cfg: Config = Config(), refused: str | None = None, files: int = 1000) -> StreamingQuery:
    """``analyse(pixels)`` of every new file under ``path`` as Parquet at ``out``, and (image_id, status,
    bytes) of the files that are refused at ``refused`` (beside ``out`` if not given), both with a
    folder for each batch of at most ``files`` files.

    Scans pass over empty files, in streams as in batches; ``images.image_files`` tells of those."""
    schema = spark.read.format("image").option("dropInvalid", False).load(path).schema
    raw = spark.readStream.format("image").schema(schema).option("dropInvalid", False).option("maxFilesPerTrigger", files).load(path)
    quarantine = refused or f"{out.rstrip('/')}-refused"

    def each(batch: DataFrame, number: int) -> None:
        store_batch(batch, number, out, quarantine, analyse, cfg)

    return images.decoded(raw, cfg).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
