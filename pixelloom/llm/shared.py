"""Helpers that several corpus operators use: row keys, boxed rows and skewed joins."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import cut, delete, folder, fresh_path, scope

__all__ = ["NOT_SPACE", "SPACE", "boxed", "cut", "delete", "documents", "field", "folder", "fresh_path", "join_side", "lean", "named", "others", "scope", "unboxed", "with_row"]

#: Whitespace of every contract: the space and \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def with_row(df: DataFrame, name: str = "_row") -> DataFrame:
    """Add a unique row key. It is the same in every scan of the same files, and
    in every attempt of a task, as it counts rows within a file split. A frame
    that comes from a shuffle must be ``cut`` first.

    Spark derives the size of splits from the cores it has at the time; the number
    is pinned here, so that splits stay as they are if executors come or go."""
    spark, pin = df.sparkSession, "spark.sql.files.minPartitionNum"
    if spark.conf.get(pin, None) is None:
        spark.conf.set(pin, str(spark.sparkContext.defaultParallelism))
    return df.withColumn(name, F.monotonically_increasing_id())


def named(column: str) -> Column:
    """A column of the user's, whose name may hold anything."""
    return F.col("`" + column.replace("`", "``") + "`")


def others(columns: Sequence[str], without: Sequence[str]) -> list[str]:
    """``columns`` but for those named like ``without``; Spark takes no note of case."""
    gone = {c.casefold() for c in without}
    return [c for c in columns if c.casefold() not in gone]


def boxed(df: DataFrame) -> DataFrame:
    """(_row, _doc): the row key and all columns of ``df`` in one struct, so that no
    helper column can clash with a column of the user's."""
    return with_row(df.select(F.struct(*[named(c) for c in df.columns]).alias("_doc")))


def field(name: str) -> Column:
    """A column of the user's within ``boxed`` rows."""
    return F.col("_doc").getField(name)


def unboxed(columns: Sequence[str], without: Sequence[str] = ()) -> list[Column]:
    """The user's columns again, in order, but for those that are replaced."""
    return [field(c).alias(c) for c in others(columns, without)]


def join_side(rows: DataFrame, side: DataFrame, keys: list[str], n: str, total: int, heavy: int = 1000) -> DataFrame:
    """``rows`` joined to ``side``, which has one row for each key and in ``n`` how many of
    ``rows`` (``total`` in all) have it. Keys with more than total / heavy rows, fewer than
    ``heavy`` of them, are broadcast, so their rows stay where they are; the others shuffle."""
    hot = F.broadcast(side.where(F.col(n) * heavy > total))
    cool = side.where(F.col(n) * heavy <= total)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cool, keys))


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` for ``mapInArrow``, after which the worker gives back the memory it has freed:
    workers wait for their next task beside those that run, and would hold on to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return run
