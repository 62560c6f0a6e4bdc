"""Cut lineage with tables in the cluster's shared checkpoint folder.

Iterative operators grow a plan with every round.  ``cut`` writes a DataFrame once, as Parquet, below the folder
named by ``spark.checkpoint.dir`` and returns a reader of it; the files outlive any executor.  ``release`` deletes a
table as soon as a later one has replaced it.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_tables: dict[str, SparkSession] = {}
_fallback: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only where that is unset and the master is local (tests, a notebook) a
    folder of our own.  On a cluster such a folder would lie on each executor's own disk, so there it must be set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _fallback:
        _fallback.append("file://" + tempfile.mkdtemp(prefix="quernel-"))
    return _fallback[0]


#: Has Spark delete the shuffle files of a query when it ends (since 4.1; unknown to earlier versions, and harmless).
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffle_files_removed(spark: SparkSession) -> Iterator[None]:
    """A table that is written once reads its shuffles once: they need not stay until the driver collects garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """``df``, written once and read back: later plans start from the files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quernel-{uuid.uuid4().hex}"
    with _shuffle_files_removed(spark):
        df.write.parquet(path)
    _tables[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._quernel_path = path  # noqa: SLF001
    return out


def own_folder(spark: SparkSession) -> str:
    """A new folder in the shared one for tables that are written by and by; deleted when the driver ends."""
    path = f"{shared_dir(spark)}/quernel-{uuid.uuid4().hex}"
    _tables[path] = spark
    return path


def release(*frames: DataFrame | None) -> None:
    """Delete the tables behind frames made by ``cut``; others are left alone."""
    for df in frames:
        path = getattr(df, "_quernel_path", None)
        if path and _tables.pop(path, None):
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm  # noqa: SLF001
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)  # noqa: SLF001


@atexit.register
def _sweep() -> None:
    for path, spark in list(_tables.items()):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001, S110 - the session is gone; the folder is the cluster's to clean
            pass
