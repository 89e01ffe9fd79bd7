"""Tables that are kept beside what they were made from, and made again once that is newer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def modified(spark: SparkSession, path: str) -> int | None:
    """When a file, or the newest file right in a folder, was changed, in milliseconds; None if there is none."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return None
    status = fs.getFileStatus(target)
    if not status.isDirectory():
        return status.getModificationTime()
    return max([f.getModificationTime() for f in fs.listStatus(target)], default=status.getModificationTime())


def kept(spark: SparkSession, path: str, sources: list[str], make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path`` if it is whole and newer than all its sources, else what ``make`` gives, written there."""
    done = modified(spark, f"{path}/_SUCCESS")
    times = [modified(spark, s) for s in sources]
    if done is None or any(t is None or t >= done for t in times):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
