"""The shared work folder, and tables written there to cut lineage.

Tables are Parquet below ``spark.checkpoint.dir`` (read from the session), in a
folder named after the application.  Every executor can reread them, so a lost
executor costs only the tasks it was running.  The folder is deleted when the
driver's JVM ends, or before by ``release`` or at the end of ``scratch``.
"""

from __future__ import annotations

import contextlib
import functools
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="tamarack-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a master inside this process (tests, a local shell) uses a
    temporary folder, as there is one machine only; any other master is an error.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    return _own_dir()


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def app_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}"


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in this application's own folder, which goes when the JVM does."""
    fs, where = _fs(spark, app_dir(spark))
    if not fs.exists(where):
        fs.mkdirs(where)
        fs.deleteOnExit(where)
    return f"{app_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` as a table in the shared folder: computed once, reread by others."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def _inside(spark: SparkSession) -> set[str]:
    fs, where = _fs(spark, app_dir(spark))
    return {str(s.getPath()) for s in fs.listStatus(where)} if fs.exists(where) else set()


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def release(spark: SparkSession) -> None:
    """Delete the tables this application wrote; results not yet stored are lost."""
    delete(spark, app_dir(spark))


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside go at its end.  Store or collect results before."""
    before = _inside(spark)
    try:
        yield
    finally:
        for path in _inside(spark) - before:
            delete(spark, path)
