"""Marks and folders on any file system that Spark knows, from the driver."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def is_file(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if it does not exist."""
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def touch(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.create(p, True).close()


def delete(spark: SparkSession, path: str) -> bool:
    """Whether there was something to delete."""
    fs, p = _at(spark, path)
    return fs.delete(p, True)
