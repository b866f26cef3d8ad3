"""The folder that driver and executors share, for tables between stages and for streams' state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Where a local session without a setting keeps them.
LOCAL_SHARED = "file:///tmp/tidemark-shared"
_made: set[str] = set()
_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, else the directory of ``SparkContext.setCheckpointDir``. Only a local session
    may name neither: on a cluster a machine's own folder would lose tables with its executor."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = LOCAL_SHARED
    return named.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path in the application's own part of the shared folder, which goes when the driver's JVM ends."""
    folder = f"{shared_dir(spark)}/tidemark-{spark.sparkContext.applicationId}"
    if folder not in _made:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(where)
        files.deleteOnExit(where)
        _made.add(folder)
    return f"{_scratch.get() or folder}/{what}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A part of the shared folder for the tables of what is run within: they go when the block ends, so its results must have been
    read or written elsewhere by then. A driver that lives long runs each query in one."""
    path = fresh_path(spark, "scratch")
    token = _scratch.set(path)
    try:
        yield path
    finally:
        _scratch.reset(token)
        remove(spark, path)


def materialize(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: lineage ends in files that outlive executors."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing will read again."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
