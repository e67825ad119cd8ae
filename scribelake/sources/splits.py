"""Recordings stored by language and split, and their join to a label table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribelake.functions.roles import (
    DEFAULT_LANGUAGES,
    audio_pointer,
    languages_or_default,
    need_columns,
    need_role,
    pick,
)
from scribelake.operators import guards
from scribelake.operators.ids import need_each_once
from scribelake.operators.selection import relabel

# Columns a label table must have.
LABEL_COLUMNS = ("id", "transcription", "language", "original_split")


def read_recordings(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """The whole store, laid out as ``language=../split=..``."""
    return spark.read.format(format).load(path)


def load_split(
    store: DataFrame,
    split: str,
    languages: Sequence[str] | None = DEFAULT_LANGUAGES,
    *,
    keep_text: bool = True,
) -> DataFrame:
    """``id, language, audio[, text]`` of one split and any number of languages.

    Both conditions are on partition columns, so other folders are not read, and the
    text column is not read unless kept.
    """
    chosen = guards.in_languages(store, languages_or_default(languages)).where(
        F.col("split") == split
    )
    own = [c for c in store.columns if c not in ("language", "split")]
    columns = [
        (need_role(own, "id"), "id", True),
        ("language", "language", True),
        (need_role(own, "audio"), "audio", False),
    ]
    if keep_text:
        columns.append((need_role(own, "text"), "text", False))
    return pick(chosen, *columns)


def load_labelled_split(
    store: DataFrame,
    labels: DataFrame,
    split: str,
    languages: Sequence[str] | None = DEFAULT_LANGUAGES,
    *,
    checked: bool = True,
) -> DataFrame:
    """Recordings of the labelled ids, their text replaced by the label.

    Raises when labels lack a column, select no rows, lack or repeat an id, or name an
    id (in its own language) that the store does not hold exactly once.
    """
    need_columns(labels.columns, LABEL_COLUMNS, "label table")
    languages = languages_or_default(languages)
    wanted = guards.in_languages(guards.in_split(labels, split), languages).select(
        "language", F.col("id").cast("string").alias("id"), F.col("transcription").alias("label")
    )
    guards.with_rows(wanted, f"split {split!r}, languages {languages}")
    rows = load_split(store, split, languages)
    key = ("language", "id")
    if checked:
        need_each_once(wanted, rows, f"recording in {split}", key=key)
    return relabel(rows, wanted, key=key, checked=not checked)


def manifest(rows: DataFrame, split: str, *, read_bytes: bool = False) -> DataFrame:
    """Manifest records; the text is left out for the test split."""
    record = rows.select(
        F.col("id").cast("string").alias("id"),
        "language",
        F.lit(split).alias("split"),
        audio_pointer(rows, "audio", read_bytes=read_bytes).alias("audio"),
        *([F.col("text")] if "text" in rows.columns and split != "test" else []),
    )
    return record


def write_manifest(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON Lines in one folder per language and split.

    The folder columns are copies, so that each record is complete by itself.  The
    rebalance hint lets adaptive execution size the files and split a dominant
    language over many tasks.
    """
    placed = records.withColumns({"language_": F.col("language"), "split_": F.col("split")})
    (
        placed.hint("rebalance", "language_", "split_")
        .write.mode(mode)
        .partitionBy("language_", "split_")
        .json(path)
    )
