"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# bytes that a result may have to be kept by the driver
HELD_BYTES = 8 * 1024 * 1024


def checkpoint_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as named in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="corpusqa-"))
    return context.getCheckpointDir().rstrip("/")


_scope: ContextVar[list[str] | None] = ContextVar("scratch scope", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a table written by this application."""
    path = f"{checkpoint_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if (held := _scope.get()) is not None:
        held.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread writes to the scratch folder inside the scope are removed at its end, also after an error.

    Results have to be written elsewhere before: frames that read such a table are of no use afterwards.
    """
    paths: list[str] = []
    token = _scope.set(paths)
    try:
        yield
    finally:
        _scope.reset(token)
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_cleaning = [0, "false"]  # threads that are at it, the session's setting before
_cleaning_lock = threading.Lock()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written inside removes its shuffle files when it is done: else they take disk until the driver happens to collect its garbage."""
    with _cleaning_lock:
        if not _cleaning[0]:
            _cleaning[1] = spark.conf.get(_CLEAN_UP)
        _cleaning[0] += 1
        spark.conf.set(_CLEAN_UP, "true")
    try:
        yield
    finally:
        with _cleaning_lock:
            _cleaning[0] -= 1
            if not _cleaning[0]:
                spark.conf.set(_CLEAN_UP, _cleaning[1])


def materialise(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage is cut, its size is known. ``codec``: of the files, if not the session's."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_removed(spark):
        (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hold(df: DataFrame, name: str, most_bytes: int) -> DataFrame:
    """``df``, worked out once: kept by the driver if it has a few bytes at most (``most_bytes``, known beforehand), else written (``materialise``)."""
    if most_bytes > HELD_BYTES:
        return materialise(df, name)
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal the rows out for heavy work on each, as where a table comes in few large files; costs a shuffle of the rows."""
    return df.repartition(*keys)
