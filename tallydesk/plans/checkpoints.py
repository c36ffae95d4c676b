"""Cutting lineage on storage that outlives an executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="tallydesk-stages-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``, which all executors share.

    A session whose tasks all run in its own process may do without; it gets a folder that goes
    when the process ends. Any other session fails.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return _own_folder()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies; one that is not there is no error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


# Of the scopes that are open, the paths written in each, in order.
_scopes: list[list[str]] = []


@contextmanager
def passing_stages(spark: SparkSession) -> Iterator[None]:
    """All tables checkpointed inside go at the end, but for the last one, which is the result."""
    written: list[str] = []
    _scopes.append(written)
    try:
        yield
    finally:
        _scopes.remove(written)
        for path in written[:-1]:
            remove_folder(spark, path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def releasing_shuffles(spark: SparkSession) -> Iterator[None]:
    """The files that a write inside shuffles go when it ends, not when the driver happens to collect its garbage.

    For writes whose plan is not run again: one that is would shuffle anew.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def parquet_checkpoint(df: DataFrame, name: str) -> DataFrame:
    """Write a table that is read more than once to the shared folder, and read it from there.

    It has no lineage, keeps its columns apart and outlives any executor.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    return parquet_checkpoint(df, "stage")


checkpoint_stage = parquet_checkpoint
