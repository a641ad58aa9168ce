"""A folder that all machines of the cluster share, for tables that outlive one job."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or for local sessions that leave it unset a temporary folder of their own."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="docloom-")
        atexit.register(shutil.rmtree, _own[app], True)
    return f"file://{_own[app]}"


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # noqa: BLE001  the JVM is gone already
        return


def new_dir(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/docloom-{name}-{uuid.uuid4().hex}"
    atexit.register(_delete_at_exit, spark, path)
    return path


def file_state(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Number, bytes and newest time of the files of a table, by Spark's file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files = list(fs.listStatus(at)) if fs.exists(at) else []
    return len(files), sum(f.getLen() for f in files), max((f.getModificationTime() for f in files), default=0)


#: Shuffle files of the writes inside are deleted when they end, else they stay until the driver's JVM happens to collect its garbage.
SHUFFLES_DROPPED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the jobs that run inside."""
    before = {name: spark.conf.get(name) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


#: Bytes of a file that one task works on, where rows cost much more than their reading.
DEAL_BYTES = 4 << 20


def largest_file(spark: SparkSession, path: str) -> int:
    """Bytes of the largest file of a table."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return max((f.getLen() for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)), default=0)


def dealt(rows: DataFrame, path: str, key: str) -> DataFrame:
    """Rows of the table at path by their keys in tasks of about DEAL_BYTES: a file of one row group is read by one task, whatever its size."""
    spark = rows.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(file_state(spark, path)[1] / DEAL_BYTES))
    return rows.repartition(tasks, key)
