"""Folders of a table as the session's file systems see them (any Hadoop URI)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """Names directly under a folder; none if it does not exist."""
    where, fs = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def size(spark: SparkSession, path: str) -> int:
    """Bytes under a path."""
    where, fs = _at(spark, path)
    return int(fs.getContentSummary(where).getLength()) if fs.exists(where) else 0


def remove(spark: SparkSession, path: str) -> None:
    where, fs = _at(spark, path)
    fs.delete(where, True)


def versions(spark: SparkSession, path: str, part: str = "v") -> list[int]:
    """Numbers of the ``v=<n>`` folders under a path, ascending."""
    return sorted(int(n.partition("=")[2]) for n in names(spark, path) if n.startswith(f"{part}="))
