"""Saved intermediate tables for results that several steps read."""

from __future__ import annotations

import contextlib
import re
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from sparktape.schema import TapeError

_local = threading.local()  # every thread deletes what it wrote itself


def _scopes() -> list[list[str]]:
    if not hasattr(_local, "scopes"):
        _local.scopes = []
    return _local.scopes


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else one below the warehouse.

    A warehouse on a machine's own disk is shared on a local master only; elsewhere executors would each write to their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    named = bool(folder)
    if not named:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/sparktape-saved"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    one_machine = re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master)
    if not named and path.startswith("file:") and not one_machine:
        raise TapeError(f"set spark.checkpoint.dir to a folder that all machines share; {path} is on each machine's own disk")
    return path


def fresh_path(spark: SparkSession, kind: str = "table") -> str:
    """A new path in the shared folder, removed at the end of the surrounding ``scratch`` scope, if there is one."""
    path = f"{shared_folder(spark)}/sparktape-{kind}-{uuid.uuid4().hex}"
    if _scopes():
        _scopes()[-1].append(path)
    return path


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later steps then start from files that outlive lost executors, and their plans stay small.
    """
    spark = df.sparkSession
    path = fresh_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete what ``saved`` writes inside the scope when it ends; write the run's result before leaving it."""
    _scopes().append([])
    try:
        yield
    finally:
        for path in _scopes().pop():
            delete(spark, path)
