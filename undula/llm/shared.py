"""What operators keep in the shared folder of the cluster."""

from __future__ import annotations

import contextlib
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..shared import fresh


#: In each thread, what the operators that now run have written, innermost last.
_own = threading.local()


def _scopes() -> list[list[str]]:
    if not hasattr(_own, "scopes"):
        _own.scopes = []
    return _own.scopes


def passing(path: str, stays: bool = False) -> str:
    """Notes a path that goes with the `scratch` around it (or the one around that, if it stays)."""
    scopes = _scopes()[:-1] if stays else _scopes()
    if scopes:
        scopes[-1].append(path)
    return path


def kept(spark: SparkSession, df: DataFrame, name: str, stays: bool = False, schema: StructType | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it again: later jobs start from the files, whatever
    executors are lost meanwhile.  Within `scratch` the table goes at its end, unless it stays."""
    path = passing(fresh(spark, name), stays)
    df.write.parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes the tables kept inside, but for those that stay (which go with an outer scratch)."""
    _scopes().append([])
    try:
        yield
    finally:
        for path in _scopes().pop():
            delete(spark, path)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name in df.columns:
        name += "_"
    return name


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Jobs that run inside hand Python tasks that many rows at once: for rows of several texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Bytes of a batch that Python tasks are handed at once; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> SparkSession:
    """The session; its jobs hand Python tasks batches of at most BATCH_BYTES from now on, since 10,000
    texts at once are tens of megabytes, held by Python, by the executor and on the way back.  It stays set, as results are lazy."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return spark


def open_store(path: str):
    """(file system, path in it) of a path of the shared folder, inside a task or the driver."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)
