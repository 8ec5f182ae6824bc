"""Cutting lineage between the steps of a job, by tables in a folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_left: dict[str, SparkSession] = {}
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
_writing: dict[str, tuple[int, str | None]] = {}  # session -> writers at work, and the setting before the first


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only where none is set and Spark is one local process, an own temporary one; a cluster without a setting is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="docloom-")
    spark.sparkContext.setCheckpointDir(own)
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


def new_folder(spark: SparkSession) -> str:
    """A folder of the shared one for tables that a job writes itself; it goes when the driver ends."""
    path = f"{shared_folder(spark)}/docloom-{uuid.uuid4().hex}"
    _left[path] = spark
    return path


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go at the end of the jobs inside; writers of one session that overlap set this once and put it back once."""
    key = spark._jsparkSession.sessionUUID()
    with _lock:
        n, before = _writing.get(key, (0, spark.conf.get(_CLEAN, None)))
        _writing[key] = (n + 1, before)
        spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        with _lock:
            n, before = _writing[key]
            _writing[key] = (n - 1, before)
            if n == 1:
                del _writing[key]
                spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)


def cut_lineage(rows: DataFrame) -> DataFrame:
    """The rows, written as a table to the shared folder and read back; the shuffle files of the job that made them go at its end.

    A lost executor costs nothing of what was written. release() removes the table; what is left goes when the driver ends.
    """
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/docloom-{uuid.uuid4().hex}"
    with cleaned(spark):
        rows.write.parquet(path)
    out = spark.read.schema(rows.schema).parquet(path)
    out._cut_path = path
    _left[path] = spark
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def release(*tables: DataFrame) -> None:
    """Removes the files of tables that cut_lineage() wrote. Nothing that is still to be computed may read them."""
    for rows in tables:
        _delete(_left.pop(rows._cut_path), rows._cut_path)


@atexit.register
def _end() -> None:
    for path, spark in _left.items():
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)
