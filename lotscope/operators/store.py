"""Where intermediate tables go: the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}
#: Shuffles that led to a written table are of no more use: executors delete their files once it's written.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession) -> str:
    """One folder for each application under spark.checkpoint.dir, removed when the driver ends.

    Where the setting is absent on one machine, as in tests, a temporary folder stands in for it; a cluster must name a shared one.
    """
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        top = spark.conf.get("spark.checkpoint.dir", None)
        if not top:
            if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            top = "file://" + tempfile.mkdtemp(prefix="lotscope-")
            spark.conf.set("spark.checkpoint.dir", top)
        _FOLDERS[app] = f"{top.rstrip('/')}/lotscope-{uuid.uuid4().hex}"
        atexit.register(remove, spark, _FOLDERS[app])
    return _FOLDERS[app]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system; a stopped session has nothing left to delete with."""
    sc = spark.sparkContext
    if sc._jsc is None:
        return
    try:
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the gateway may already be closed at exit
        return


class Table:
    """A DataFrame written as Parquet to the shared folder: short lineage that outlives lost executors."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{scratch(self.spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.append(df)

    def append(self, df: DataFrame) -> None:
        """Write more rows of the same columns beside those that are there."""
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.mode("append").parquet(self.path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` cut from its lineage by a written table."""
    return Table(df, name).df


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run`, after which the Python worker, which lives on for other tasks, gives its free memory back to the system."""

    def lean_run(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return lean_run
