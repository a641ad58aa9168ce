"""Intermediate tables in the folder that all machines of the cluster share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or for local sessions that leave it unset a temporary folder."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="docloom-")
        atexit.register(shutil.rmtree, _own[app], True)
    return f"file://{_own[app]}"


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # noqa: BLE001  the JVM is gone already
        return


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """For the writes that run inside: their shuffle files are deleted when they end, else they stay until the driver's JVM happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Tables written once and reread: lineage ends there, and a lost executor costs no recomputation.

    An operator drops what its result doesn't read before it returns; the rest goes when the driver ends."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/docloom-{uuid.uuid4().hex}"
        self._paths: list[str] = []
        atexit.register(_delete_at_exit, spark, self.root)

    def keep(self, df: DataFrame) -> DataFrame:
        """Write df and return the written table. Its shuffle files go as soon as it is written."""
        path = f"{self.root}/{len(self._paths) + 1}"
        with shuffles_dropped(self.spark):
            df.write.parquet(path)
        self._paths.append(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables made by keep() that nothing reads any more."""
        for df in tables:
            _delete(self.spark, df._scratch_path)  # type: ignore[attr-defined]

    def only(self, *tables: DataFrame) -> None:
        """Delete all tables but these."""
        held = {t._scratch_path for t in tables}  # type: ignore[attr-defined]
        for path in self._paths:
            if path not in held:
                _delete(self.spark, path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Rows of an Arrow batch for the jobs that run inside, where rows are large: a task's Python and the JVM beside it each hold a batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: A side may be broadcast up to so many rows and, by the sizes of its values, so many bytes.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 24 << 20


def _value_bytes(name: str, kind: DataType) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, (ArrayType, MapType, StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16
    return F.lit(8)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count of rows and bytes proves it small; else df as it is, for a shuffled join."""
    size = reduce(add, (_value_bytes(f.name, f.dataType) for f in df.schema))
    n, held = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and held <= BROADCAST_BYTES else df
