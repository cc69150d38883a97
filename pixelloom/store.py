"""Intermediate tables in the folder that driver and executors share.

``cut`` writes a table there and reads it back: the lineage ends, a lost executor
costs no more than one stage, and what several later steps read is computed once.
The tables written inside a ``scope`` are deleted at its end, and no others; those
written outside of any scope serve lazy results and stay until the application ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)
_unscoped: list[str] = []


@lru_cache
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="pixelloom-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where that is unset and Spark
    runs in this one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{_own_folder()}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, owned by the current scope."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    owned = _scope.get()
    (_unscoped if owned is None else owned).append(path)
    return path


def cut(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df``, written and read back."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Spark weighs an Arrow batch after each row against this limit, which costs more than to write a pixel.
WEIGHED = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_rows(spark: SparkSession) -> Iterator[None]:
    """Batches that go to Python are bounded by their number of rows alone. For jobs that run inside
    and whose rows are pixels or runs; not for such as send whole images or texts."""
    before = spark.conf.get(WEIGHED, None)
    spark.conf.set(WEIGHED, str(2**31 - 1))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(WEIGHED)
        else:
            spark.conf.set(WEIGHED, before)


def delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables written inside when it ends. Results that read them must
    be stored before; results made elsewhere are not touched."""
    owned: list[str] = []
    mark = _scope.set(owned)
    try:
        yield
    finally:
        _scope.reset(mark)
        for path in owned:
            delete(spark, path)


class Successive:
    """Scratch of steps that each store their result before the next begins: when one
    begins, what the one before wrote goes. Inside a ``scope``, that scope owns it all."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    @contextmanager
    def step(self, spark: SparkSession) -> Iterator[None]:
        if _scope.get() is not None:
            yield
            return
        while self.paths:
            delete(spark, self.paths.pop())
        mark = _scope.set(self.paths)
        try:
            yield
        finally:
            _scope.reset(mark)


@atexit.register
def _at_exit() -> None:
    """Tables of lazy results go with the application, if its session still runs."""
    try:
        session = SparkSession.getActiveSession() if _unscoped else None
        for path in _unscoped if session else ():
            delete(session, path)
    except Exception:  # noqa: BLE001  the session has ended: what is left goes with the folder
        return
