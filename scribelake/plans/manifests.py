"""Manifests for several languages and splits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribelake.sources.splits import load_split, manifest, write_manifest


def manifests(
    store: DataFrame,
    splits: Sequence[str] = ("train", "validation", "test"),
    languages: Sequence[str] | None = None,
    *,
    read_bytes: bool = False,
) -> DataFrame:
    """Manifest records of every language and split asked for, in one table."""
    parts = []
    for split in splits:
        rows = load_split(store, split, languages, keep_text=split != "test")
        part = manifest(rows, split, read_bytes=read_bytes)
        parts.append(part if "text" in part.columns else part.withColumn("text", F.lit(None).cast("string")))
    return reduce(DataFrame.unionByName, parts)


def write_manifests(
    store: DataFrame,
    path: str,
    splits: Sequence[str] = ("train", "validation", "test"),
    languages: Sequence[str] | None = None,
    *,
    read_bytes: bool = False,
) -> None:
    """JSON Lines by language and split; a NULL text is simply absent from its record."""
    write_manifest(manifests(store, splits, languages, read_bytes=read_bytes), path)
