"""Session helpers shared by every operator: worker imports and tables written to the shared folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
#: Rows and bytes of one batch between the JVM and Python, where the session names none: both sides hold a few at once.
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
#: Of our own tables alone, in new folders. Where they lie on a local file system, Hadoop spawns `chmod` for each file and
#: checksum file, a process that shares all of the executor's memory until it runs: pages carry the checksums instead.
_WRITE = {
    "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false",
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem",
    "fs.file.impl.disable.cache": "true",
    "parquet.page.write-checksum.enabled": "true",
}
_READ = {"parquet.page.verify-checksum.enabled": "true"}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[tuple[SparkSession, str]] = []
_shipped: set[str] = set()
_cleanup_lock = threading.Lock()
_cleaning, _before = 0, ["false"]


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package wherever they run, and keep their batches small.

    The package travels as one archive that Spark sends to every executor, once a session.
    """
    for key, value in _BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        folder = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        archive = os.path.join(folder, "corpusloom.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for at, _, names in os.walk(os.path.join(ROOT, "corpusloom")):
                for name in sorted(n for n in names if n.endswith(".py")):
                    full = os.path.join(at, name)
                    out.write(full, os.path.relpath(full, ROOT))
        context.addPyFile(archive)
    return spark


def spread(df: DataFrame, by: str) -> DataFrame:
    """A table that is scanned in fewer partitions than there are cores, dealt out over all of them by a column, for work
    that is much dearer than moving its rows; any larger table as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, by)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where it is unset, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


@contextmanager
def _no_leftovers(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go with the query that wrote them, while any thread is in here."""
    global _cleaning
    with _cleanup_lock:
        if not _cleaning:
            _before[0] = spark.conf.get(_CLEANUP, "false")
        _cleaning += 1
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _cleanup_lock:
            _cleaning -= 1
            if not _cleaning:
                spark.conf.set(_CLEANUP, _before[0])


def scratch(spark: SparkSession) -> str:
    """A path of our own in the shared folder that goes with the process."""
    path = f"{shared_folder(spark)}/corpusloom-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_sweep)
    _written.append((spark, path))
    return path


class Table:
    """A DataFrame written as Parquet to the shared folder: a short lineage that outlives lost executors."""

    def __init__(self, df: DataFrame) -> None:
        self.spark = df.sparkSession
        self.path = scratch(self.spark)
        # Once the rows are written nobody reads the shuffle files that led to them.
        with _no_leftovers(self.spark):
            df.write.options(**_WRITE).parquet(self.path)
        self.schema = df.schema

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).options(**_READ).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; only when no plan that is still to run reads them."""
        _delete(self.spark, self.path)
        if (self.spark, self.path) in _written:
            _written.remove((self.spark, self.path))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _sweep() -> None:
    for spark, path in list(_written):
        try:
            if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
                _delete(spark, path)
        except Exception:  # the session is already gone; nothing is left to tidy with
            return
