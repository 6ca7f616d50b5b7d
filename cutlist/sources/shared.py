"""Written tables in the folder that driver and executors share: they cut the lineage of tables that are used often."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_scopes: list[list[str]] = []


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    and driver and executors are one process, as in tests, a temporary folder of
    this process takes its place; it goes when the process ends. On a cluster
    without the setting every executor would write to its own disk, so that is
    an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder, and driver and executors share no other")
    if not _local:
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        _local.append(tempfile.mkdtemp(prefix="cutlist-", dir="/tmp/checkpoints"))
        atexit.register(shutil.rmtree, _local[0], True)
    return "file://" + _local[0]


def shared_dir(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    path = f"{shared_base(spark)}/{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path that ``shared_dir`` gave, in whatever store it is."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are removed at the end: what is built from them must be written elsewhere by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go as soon as it is written, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to ``path`` and read it again; what was shuffled on the way is removed."""
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    This cuts the lineage: a lost executor costs the tasks that read these
    files, not the work that made them.
    """
    return write_table(df, shared_dir(df.sparkSession))
