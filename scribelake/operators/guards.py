"""Checks that stop a job with a clear message instead of a wrong number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribelake.functions.roles import need_columns


class EmptyInputError(ValueError):
    """A selection that must hold rows holds none."""


class MixedValueError(ValueError):
    """A group that must share one value holds several."""


def with_columns_required(df: DataFrame, required: Sequence[str], table: str = "table") -> DataFrame:
    need_columns(df.columns, required, table)
    return df


def with_rows(df: DataFrame, what: str) -> DataFrame:
    """Raise when the selection is empty; reads no more than one row."""
    if df.isEmpty():
        raise EmptyInputError(f"no rows for {what}")
    return df


def in_split(df: DataFrame, split: str, column: str = "original_split") -> DataFrame:
    """Rows of one split; a table without the split column passes unchanged."""
    return df.where(F.col(column) == split) if column in df.columns else df


def in_languages(df: DataFrame, languages: Sequence[str], column: str = "language") -> DataFrame:
    return df.where(F.col(column).isin(list(languages)))


def mixed_groups(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Groups whose ``value`` is not uniform, with the number of distinct values."""
    return (
        df.groupBy(*group)
        .agg(F.count_distinct(value).alias("distinct_values"), F.count(F.lit(1)).alias("rows"))
        .where(F.col("distinct_values") > 1)
    )


def with_uniform(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    offenders = mixed_groups(df, group, value).orderBy(*group).limit(5).collect()
    if offenders:
        named = [tuple(row[g] for g in group) for row in offenders]
        raise MixedValueError(f"{value} is mixed within {list(group)} {named}")
    return df
