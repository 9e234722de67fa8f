"""Intermediate tables in the folder that driver and executors share.

A staged table cuts the lineage: what follows survives the loss of executors without running the
steps before it again, and it is read with column pruning like any other Parquet table.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"
#: Folders of our own, by application; the setting itself can't be changed in a running session.
_own: dict[str, str] = {}
#: Paths staged within the outermost passing() of a thread.
_passing = threading.local()
#: Rows of keys that are sent to all tasks at most.
SMALL = 200_000
#: Removes the shuffle files of a job once it is done; without it they stay until the driver collects its garbage.
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by the session. Only in local mode (tests), where it is unset, one of our
    own; on a cluster a folder of this machine would be no shared one, so that is an error."""
    folder = spark.conf.get(CHECKPOINT_SETTING, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_SETTING} must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="spark-searchspark-", dir="/tmp")
        folder = _own[app]
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write df to the shared folder and return the table as read back. Within passing() it goes at its end, but for
    those to keep."""
    path = new_path(df.sparkSession, label)
    paths = getattr(_passing, "paths", None)
    (df.write if paths is None else df.write.option("compression", "zstd")).parquet(path)
    if paths is not None and not keep:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(*sessions: SparkSession) -> Iterator[None]:
    """Tables staged within are compressed more and removed at the end, and so are shuffle files after each job: nothing
    that is read after it may rest on them. One within another ends with the outer one. A micro-batch has a session of its
    own, so there may be two."""
    if getattr(_passing, "paths", None) is not None:
        yield
        return
    _passing.paths, before = [], [s.conf.get(CLEANUP_SETTING, "false") for s in sessions]
    for s in sessions:
        s.conf.set(CLEANUP_SETTING, "true")
    try:
        yield
    finally:
        for s, old in zip(sessions, before, strict=True):
            s.conf.set(CLEANUP_SETTING, old)
        paths, _passing.paths = _passing.paths, None
        for path in paths:
            remove(sessions[0], path)


def release(df: DataFrame) -> None:
    """Remove a table staged within passing() before its end."""
    for path in getattr(_passing, "paths", None) or ():
        if any(f"/{path.rpartition('/')[2]}/" in f for f in df.inputFiles()[:1]):
            remove(df.sparkSession, path)
            _passing.paths.remove(path)
            return


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder, wherever it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def few(keys: DataFrame) -> DataFrame:
    """Keys for a join: sent to all tasks where they are counted and few, else left to Spark."""
    return F.broadcast(keys) if keys.limit(SMALL + 1).count() <= SMALL else keys


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
