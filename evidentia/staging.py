"""Intermediate tables in the folder that the driver and all executors share.

``spark.checkpoint.dir`` names that folder.  ``cut`` writes a table there as Parquet and reads it
back: the work before it runs once, and later jobs do not depend on an executor that may be lost.
A ``scope`` removes the tables that were cut in it when it ends, but for those that were cut with
``keep``; these belong to the scope around it, or go with the session.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("evidentia_scopes", default=())


class NoSharedFolder(RuntimeError):
    """A cluster without a folder that its executors share."""


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; only where none is set and all runs on this machine, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise NoSharedFolder("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="evidentia-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def fresh_dir(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path in the shared folder, removed with its scope and at the latest when the session's JVM ends."""
    path = f"{shared_dir(spark)}/evidentia/{name}-{uuid.uuid4().hex}"
    fs, target = _file_system(spark, path)
    fs.mkdirs(target)
    fs.deleteOnExit(target)
    scopes = _OPEN.get()
    if keep:
        scopes = scopes[:-1]
    if scopes:
        scopes[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    fs, target = _file_system(spark, path)
    fs.delete(target, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Remove what is cut inside, unless kept, when the block ends."""
    made: list[str] = []
    token = _OPEN.set((*_OPEN.get(), made))
    try:
        yield
    finally:
        _OPEN.reset(token)
        for path in made:
            remove(spark, path)


def cut(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and return it as read from there."""
    path = fresh_dir(df.sparkSession, name, keep) + "/t"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
