"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent a folder is made here, on one machine only; on a cluster it must be set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="barwright-"))
    return context.getCheckpointDir().rstrip("/")


def staged_path(spark: SparkSession, name: str) -> str:
    """A new path in the session's own folder, which ``clear`` or the driver's end empties."""
    atexit.register(clear, spark)
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/barwright/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this session has staged. Results still to be read from them are lost."""
    atexit.unregister(clear)
    if spark.sparkContext._jsc is not None:
        try:
            _delete(spark, _own(spark))
        except (Py4JError, OSError):  # the session ended before the driver did
            pass


class Staged:
    """A table written to the shared folder, which cuts lineage and survives lost executors."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = staged_path(self.spark, name)
        df.write.parquet(self.path)
        self.schema = df.schema

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        _delete(self.spark, self.path)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs started herein hand Arrow batches of at most so many rows to Python. A smaller number already set stays, and so does the setting afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(name, None)
    if own is None or not 0 < int(own) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(name) if own is None else spark.conf.set(name, own)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def either_case(words: str) -> str:
    """A pattern whose letters match in either case, spelled out for any regex engine."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in words)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
