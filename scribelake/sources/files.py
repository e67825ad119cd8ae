"""Files by their path as Spark names it: opened from inside a task, looked for, deleted."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession


def _hadoop_path(spark: SparkSession, path: str) -> tuple[Any, Any]:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), found


def path_exists(spark: SparkSession, path: str) -> bool:
    system, found = _hadoop_path(spark, path)
    return system.exists(found)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder; none if it is not there."""
    system, found = _hadoop_path(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(found)) if system.exists(found) else []


def delete_path(spark: SparkSession, path: str) -> None:
    system, found = _hadoop_path(spark, path)
    system.delete(found, True)


def open_stream(path: str) -> Any:
    """A readable binary stream for a path as Spark reports it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    if path.startswith("/"):
        return fs.LocalFileSystem().open_input_stream(path)
    if path.startswith(("s3a://", "s3n://")):
        path = "s3://" + path.split("://", 1)[1]
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_stream(inner)
