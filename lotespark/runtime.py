"""Shared scratch storage, and making this package importable where Spark runs Python."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ready(df: DataFrame) -> DataFrame:
    """df itself, after sending the package's sources to the executors if they can't be expected to have it.

    They have it if the session was given Python files, or if they run on this
    machine with the package on PYTHONPATH or in the working folder.
    """
    context = df.sparkSession.sparkContext
    if context.applicationId in _SHIPPED:
        return df
    _SHIPPED.add(context.applicationId)
    package = os.path.dirname(os.path.abspath(__file__))
    home = os.path.dirname(package)
    near = [os.path.abspath(p) for p in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)) if p]
    if context.getConf().get("spark.submit.pyFiles", "") or (context.master.startswith("local") and home in near):
        return df
    path = os.path.join(tempfile.mkdtemp(), "lotespark.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, home))
    context.addPyFile(path)
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one is set where none is named and all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='lotespark-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if it comes in fewer partitions than there are: before costly work on rows of few files. Large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Tables of the temporary() blocks that are open, innermost last.
_OPEN: list[list[DataFrame]] = []


@contextmanager
def temporary() -> Iterator[None]:
    """Tables stored within are deleted at the block's end, however it ends, but for those stored with keep."""
    _OPEN.append([])
    try:
        yield
    finally:
        for df in _OPEN.pop():
            forget(df)


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: later steps survive lost executors and don't redo it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if _OPEN and not keep:
        _OPEN[-1].append(out)
    elif len(_OPEN) > 1:
        _OPEN[-2].append(out)
    return out


def forget(df: DataFrame | None) -> None:
    """Delete the files behind a stored() table that no later step reads."""
    if df is None:
        return
    spark = df.sparkSession
    base = shared_dir(spark)
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if not folder.removeprefix("file:").lstrip("/").startswith(base.removeprefix("file:").lstrip("/")):
            continue
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of steps that are written and done, now and not at some later collection."""
    spark._jvm.System.gc()
