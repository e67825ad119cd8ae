"""Fingerprints of input files."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribelake.sources.files import open_stream

_CHUNK = 1024 * 1024
# Files up to this size are read by Spark as one value; its reader ends at 2 GB.
WHOLE_BYTES = 256 << 20
# Fixed value: hex digits kept.
DIGITS = 16


def _qualified(spark: SparkSession, path: str) -> tuple[str, int | None]:
    """The whole path in its file system, and the size of the file if one is there."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    named = hadoop.Path(path)
    system = named.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    whole = system.makeQualified(named)
    if not system.exists(whole) or not system.getFileStatus(whole).isFile():
        return whole.toString(), None
    return whole.toString(), system.getFileStatus(whole).getLen()


def _as_named(path: str) -> str:
    """The path with every sign escaped that a reader would take for a pattern."""
    return re.sub(r"([\\*?\[\]{},^])", r"\\\1", path)


def _streamed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        sizes, digests = [], []
        for path in frame["whole"]:
            digest, size = hashlib.sha256(), 0
            with open_stream(path) as stream:
                while chunk := stream.read(_CHUNK):
                    digest.update(chunk)
                    size += len(chunk)
            sizes.append(size)
            digests.append(digest.hexdigest())
        yield frame.assign(bytes=sizes, sha256=digests)


def fingerprint(spark: SparkSession, paths: Sequence[str], whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """``path, exists, bytes, sha256`` (first digits) for each path asked for.

    Paths are taken as Hadoop takes them, relative ones and any character in a name
    included; folders do not count as existing, and nothing but the files asked for is
    looked at.  Spark reads and hashes files up to ``whole_bytes``; a larger one, whose hash
    cannot be split either, is streamed by one task.
    """
    known = [(path, *_qualified(spark, path)) for path in dict.fromkeys(paths)]
    asked = spark.createDataFrame(
        [(p, w, size is not None) for p, w, size in known], "path string, whole string, exists boolean"
    )
    small = [w for _, w, size in known if size is not None and size <= whole_bytes]
    large = [(w,) for _, w, size in known if size is not None and size > whole_bytes]
    found = spark.createDataFrame(large, "whole string").repartition(max(1, len(large)), "whole").mapInPandas(
        _streamed, "whole string, bytes long, sha256 string"
    )
    if small:
        files = spark.read.format("binaryFile").load([_as_named(w) for w in dict.fromkeys(small)])
        read = files.select(
            F.col("path").alias("whole"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")
        )
        found = found.unionByName(read) if large else read
    found = found.distinct()
    return asked.join(found, "whole", "left").select(
        "path", "exists", "bytes", F.substring("sha256", 1, DIGITS).alias("sha256")
    )
