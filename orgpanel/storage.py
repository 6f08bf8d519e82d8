"""Shared scratch storage: every intermediate table lives where all executors see it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which all executors and the driver see."""
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if found:
        return found.rstrip("/")
    # one machine sees its own folders, a cluster does not
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError(f"set {SETTING} to a folder that all executors see")
    folder = tempfile.mkdtemp(prefix="orgpanel-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set(SETTING, f"file://{folder}")
    return f"file://{folder}"


#: Paths of the tables written since each open block began.
_open: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialized within the block go when it ends, but for those marked ``keep``."""
    _open.append(paths := [])
    try:
        yield
    finally:
        _open.remove(paths)
        for path in paths:
            remove(spark, path)


def clear_scratch(spark: SparkSession) -> None:
    """Remove all tables that this application has left in the shared folder; results that still read them are lost."""
    if spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING):
        remove(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, small: bool = False, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    ``small`` is for tables of a few integers a row: at most two files for each core, as a file costs more than its rows.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    if _open and not keep:
        _open[-1].append(path)
    (df.coalesce(2 * spark.sparkContext.defaultParallelism) if small else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def put_file(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file of the driver's, in any store that Spark writes to."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def list_files(spark: SparkSession, path: str, globs: tuple[str, ...] = ("*",)) -> list[str]:
    """Paths of the files in a folder whose names match a pattern, sorted by name; a path that is a file stands for itself."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    if not fs.getFileStatus(top).isDirectory():
        return [path]
    found = [f.getPath() for f in fs.listStatus(top) if f.isFile()]
    return sorted({str(f.toString()) for f in found if any(fnmatch(f.getName(), g) for g in globs)}, key=lambda f: f.rsplit("/", 1)[-1])


def exists(spark: SparkSession, path: str) -> bool:
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    return top.getFileSystem(spark._jsc.hadoopConfiguration()).exists(top)


def remove(spark: SparkSession, path: str) -> None:
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    top.getFileSystem(spark._jsc.hadoopConfiguration()).delete(top, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that no later step reads."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(spark, name)
