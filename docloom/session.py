"""Session helpers: the shared working folder and input spreading."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder that every executor can reach.

    It lies under the folder the cluster names in ``spark.checkpoint.dir``.
    Only a local session without that setting gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="docloom-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def remove_dir(spark: SparkSession, path: str) -> None:
    """Remove a working folder, in whatever file system it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(*sessions: SparkSession):
    """Inside, the shuffle files of a query are removed when it ends, not when
    the driver next collects its garbage. For jobs whose DataFrames run once."""
    before = [(s, s.conf.get(SHUFFLE_CLEANUP, None)) for s in sessions]
    try:
        for s in sessions:
            s.conf.set(SHUFFLE_CLEANUP, "true")
        yield
    finally:
        for s, value in before:
            s.conf.unset(SHUFFLE_CLEANUP) if value is None else s.conf.set(SHUFFLE_CLEANUP, value)


def list_dirs(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder that a finished job has written."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place):
        return []
    found = [status.getPath() for status in system.listStatus(place) if status.isDirectory()]
    return [p.getName() for p in found if system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash rows over all cores when the scan has fewer splits than cores.

    A small Parquet file is often one row group and so one task. A large
    input has many more splits than cores and is returned unchanged, so no
    shuffle is added where it would cost something.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)
