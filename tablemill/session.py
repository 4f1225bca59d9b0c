"""Session helpers: the shared working folder and its paths."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: the one ``spark.checkpoint.dir`` names.

    Where the session names none, work goes beside the tables, under ``spark.sql.warehouse.dir``,
    which every executor must reach as well.
    """
    path = spark.conf.get(CHECKPOINT_DIR, None) or spark.conf.get("spark.sql.warehouse.dir")
    return path.rstrip("/")


_scope: ContextVar[str] = ContextVar("tablemill-scope", default="")


def work_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/tablemill/{_scope.get()}{label}-{uuid.uuid4().hex}"


@contextmanager
def work_scope(spark: SparkSession) -> Iterator[str]:
    """A scope whose working data is deleted at its end.

    Frames that operators return may read it, so write or collect them inside the scope.
    Tables and results written elsewhere stay.
    """
    name = f"{_scope.get()}scope-{uuid.uuid4().hex}/"
    token = _scope.set(name)
    path = f"{shared_dir(spark)}/tablemill/{name}"
    try:
        yield path
    finally:
        _scope.reset(token)
        delete_path(spark, path)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the length of one action; ``insertInto`` takes no options."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def staged(df: DataFrame, label: str = "staged") -> DataFrame:
    """``df`` written once under the shared folder and read back.

    For a frame that a plan reads more than once: it is computed once, gives the
    same rows each time, and survives the loss of an executor.
    """
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a path this library wrote, on whatever file system holds it."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def list_path(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(child path, modification time) of a folder; empty if it isn't there."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jpath):
        return []
    return [(s.getPath().toString(), s.getModificationTime()) for s in fs.listStatus(jpath)]
