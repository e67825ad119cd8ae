"""Id bookkeeping across tables: completeness, overlap, duplicates.

Every comparison of id sets is one shuffle of ids alone.  Tables are stacked and
grouped by id with one counter per table, so repeated ids collapse before the
shuffle and one id holding a third of all rows costs one row per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class IncompleteError(ValueError):
    """Ids that must be present are missing, repeated or null."""


def counts_by_id(tables: Mapping[str, DataFrame], key: str | Sequence[str] = "id") -> DataFrame:
    """The key, of one or more columns, and per table how many of its rows carry it."""
    keys = [key] if isinstance(key, str) else list(key)
    stacked = [
        df.select(
            *[F.col(k).cast("string").alias(k) for k in keys],
            *[F.lit(1 if other == name else 0).cast("long").alias(other) for other in tables],
        )
        for name, df in tables.items()
    ]
    return (
        reduce(DataFrame.union, stacked)
        .groupBy(*keys)
        .agg(*[F.sum(name).alias(name) for name in tables])
    )


def repeated(counter: str) -> Column:
    """Rows beyond the first of each value, from the counts of :func:`counts_by_id`."""
    return F.coalesce(F.sum(F.greatest(F.col(counter) - 1, F.lit(0))), F.lit(0))


def how_many(predicate: Column) -> Column:
    return F.count_if(predicate)


def pairing_audit(reference: DataFrame, other: DataFrame, key: str = "id") -> DataFrame:
    """One row: what would go wrong if ``other`` were joined to ``reference``."""
    return audit_of(counts_by_id({"a": reference.select(key), "b": other.select(key)}, key), key)


def audit_of(counted: DataFrame, key: str = "id") -> DataFrame:
    """:func:`pairing_audit` from how often each key is in the two tables, ``a`` and ``b``."""
    known = F.col(key).isNotNull()
    return counted.agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("reference_rows"),
        F.coalesce(F.sum("b"), F.lit(0)).alias("other_rows"),
        how_many(known & (F.col("a") > 0) & (F.col("b") == 0)).alias("missing"),
        how_many(known & (F.col("a") == 0) & (F.col("b") > 0)).alias("extra"),
        F.coalesce(F.sum(F.when(known & (F.col("a") > 1), F.col("a") - 1)), F.lit(0)).alias(
            "repeated_reference"
        ),
        F.coalesce(
            F.sum(F.when(known & (F.col("a") > 0) & (F.col("b") > 1), F.col("b") - 1)), F.lit(0)
        ).alias("repeated_other"),
        F.coalesce(F.sum(F.when(~known, F.col("a"))), F.lit(0)).alias("null_reference"),
        F.coalesce(F.sum(F.when(~known, F.col("b"))), F.lit(0)).alias("null_other"),
    )


def missing_ids(wanted: DataFrame, found: DataFrame, key: str = "id") -> DataFrame:
    """Distinct wanted ids that were not found, NULL never being found."""
    counted = counts_by_id({"wanted": wanted.select(key), "found": found.select(key)}, key)
    absent = (F.col("wanted") > 0) & ((F.col("found") == 0) | F.col(key).isNull())
    return counted.where(absent).select(key)


def first_sorted(df: DataFrame, k: int, key: str = "id") -> DataFrame:
    """The ``k`` smallest keys; each task keeps ``k``, so nothing large is sorted."""
    return df.select(key).orderBy(key).limit(k)


def missing_summary(wanted: DataFrame, found: DataFrame, k: int = 5, key: str = "id") -> DataFrame:
    """One row: number of missing ids and the first ``k`` of them in order.

    The ids are compared once, and each of the 1024 parts they are dealt in keeps its
    ``k`` smallest, so the final list is built from few rows.
    """
    absent = missing_ids(wanted, found, key)
    dealt = absent.withColumn("deal", F.pmod(F.xxhash64(key), F.lit(1024)))
    ranked = dealt.withColumn("r", F.row_number().over(Window.partitionBy("deal").orderBy(key)))
    kept = ranked.groupBy("deal").agg(
        F.count(F.lit(1)).alias("n"),
        F.collect_list(F.when(F.col("r") <= k, F.col(key))).alias("few"),
    )
    return kept.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("missing"),
        F.slice(F.array_sort(F.flatten(F.collect_list("few"))), 1, k).alias("examples"),
    )


def need_all(wanted: DataFrame, found: DataFrame, what: str, k: int = 5, key: str = "id") -> None:
    row = missing_summary(wanted, found, k, key).first()
    if row["missing"]:
        raise IncompleteError(f"{row['missing']} ids have no {what}, first {row['examples']}")


def need_each_once(
    wanted: DataFrame, found: DataFrame, what: str, k: int = 5, key: str | Sequence[str] = "id"
) -> None:
    """Raise unless every wanted key is known and found exactly once, the wanted ones too.

    One shuffle of keys, in which a repeated key costs one row per task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    counted = counts_by_id({"wanted": wanted.select(*keys), "found": found.select(*keys)}, keys)
    asked = counted.where(F.col("wanted") > 0)
    unknown = reduce(Column.__or__, [F.col(c).isNull() for c in keys])
    name = F.concat_ws(" ", *keys)
    problems = {
        "unknown": unknown,
        f"without a {what}": ~unknown & (F.col("found") == 0),
        f"with several of a {what}": ~unknown & (F.col("found") > 1),
        "asked for repeatedly": ~unknown & (F.col("wanted") > 1),
    }
    row = asked.agg(
        *[F.count_if(p).alias(f"n{i}") for i, p in enumerate(problems.values())],
        *[F.min(F.when(p, name)).alias(f"e{i}") for i, p in enumerate(problems.values())],
    ).first()
    found_problems = [
        f"{row[f'n{i}']} ids {problem}, first {row[f'e{i}']!r}"
        for i, problem in enumerate(problems)
        if row[f"n{i}"]
    ]
    if found_problems:
        raise IncompleteError("; ".join(found_problems))


def overlap(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Distinct ids present on both sides, NULL included."""
    counted = counts_by_id({"a": left.select(key), "b": right.select(key)}, key)
    return counted.where((F.col("a") > 0) & (F.col("b") > 0)).select(key)


def difference(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Distinct ids of ``left`` absent from ``right``."""
    return left.select(key).subtract(right.select(key))


def symmetric_difference(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Distinct ids present on exactly one side, and which side that is."""
    counted = counts_by_id({"a": left.select(key), "b": right.select(key)}, key)
    return counted.where((F.col("a") > 0) != (F.col("b") > 0)).select(
        key, F.when(F.col("a") > 0, "left").otherwise("right").alias("side")
    )


def text_digest(text: Column | str) -> Column:
    """32-byte stand-in for a text as a grouping key, so that long texts are not shuffled."""
    return F.unhex(F.sha2(text, 256))


def repeat_count(
    df: DataFrame, column: str | Sequence[str], name: str = "repeated", *, digest: bool = True
) -> DataFrame:
    """One row: rows beyond the first of each distinct value; NULL is a value too.

    Short values such as ids are better grouped as they are, without ``digest``.
    """
    columns = [column] if isinstance(column, str) else list(column)
    types = dict(df.dtypes)
    keys = [
        (text_digest(c) if digest and types[c] == "string" else F.col(c)).alias(f"key{i}")
        for i, c in enumerate(columns)
    ]
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias(name))
