"""Names of folders and files, listed without opening any data."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """Full paths that match a pattern of the file system; none where its folder is absent."""
    path, system = _system(spark, pattern)
    return [found.getPath().toString() for found in system.globStatus(path) or []]


def remove(spark: SparkSession, path: str) -> None:
    found, system = _system(spark, path)
    system.delete(found, True)


def remove_if_empty(spark: SparkSession, path: str) -> None:
    found, system = _system(spark, path)
    if system.exists(found) and not system.listStatus(found):
        system.delete(found, False)


def partition_value(path: str, name: str) -> str:
    """The value that a `name=value` folder on the path carries."""
    return next(part for part in path.split("/") if part.startswith(f"{name}=")).split("=", 1)[1]
