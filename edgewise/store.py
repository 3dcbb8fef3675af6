"""Tables written to the folder that all executors share.

An iterative operator cuts its lineage by writing each round's state as a
Parquet table there and reading it back: the state then survives the loss of
any executor, is columnar and compressed, and the next round's plan starts at
a scan. Tables that are no longer needed are dropped at once; those that a
result still reads lie in the session's own folder, which goes when the
session's JVM ends, or at the end of ``working_tables``.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_folders: set[str] = set()
_watched: list[list[str]] = []
#: The shuffle files of a write leave the executors' disks when it has ended, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Only where that is unset, and
    all tasks run in this process' machine, a temporary folder is made; on a
    cluster without the setting this raises."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _own:
        _own[key] = tempfile.mkdtemp(prefix="edgewise-")
        atexit.register(shutil.rmtree, _own[key], ignore_errors=True)
    return f"file://{_own[key]}"


def hadoop_path(spark: SparkSession, path: str):
    """The path, and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def session_dir(spark: SparkSession) -> str:
    """This session's folder in the shared one; removed when its JVM ends."""
    folder = f"{shared_dir(spark)}/edgewise/{spark.sparkContext.applicationId}"
    if folder not in _folders:
        p, fs = hadoop_path(spark, folder)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _folders.add(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in _watched:
        paths.append(path)
    return path


@contextmanager
def working_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what operators wrote inside. Results are computed
    lazily, so write or collect them inside, too."""
    paths: list[str] = []
    _watched.append(paths)
    try:
        yield
    finally:
        _watched.remove(paths)
        for path in paths:
            delete(spark, path)


@contextmanager
def _files_cleaned(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def write_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table; the returned frame reads it."""
    return append_table(df, new_path(df.sparkSession, name))


def append_table(df: DataFrame, path: str) -> DataFrame:
    """Adds the rows of ``df`` to the table at ``path``; the returned frame
    reads the whole table as it is now."""
    spark = df.sparkSession
    with _files_cleaned(spark):
        df.write.mode("append").option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._edgewise_path = path
    return table


def path_of(table: DataFrame) -> str | None:
    return getattr(table, "_edgewise_path", None)


def delete(spark: SparkSession, path: str) -> None:
    p, fs = hadoop_path(spark, path)
    fs.delete(p, True)


def drop(*tables: DataFrame | None) -> None:
    """Deletes written tables; frames that weren't written are left alone."""
    for table in tables:
        if table is not None and (path := path_of(table)):
            delete(table.sparkSession, path)
