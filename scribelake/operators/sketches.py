"""Theta sketches of id sets: stored once, then compared without reading the ids again.

A sketch keeps the ``2 ** log_size`` smallest hashes of the ids, so it is exact for sets up to
that size and has a relative error of about ``2 ** (-log_size / 2)`` beyond.  Sketches of parts of
a table add up to the sketch of the table.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG_SIZE = 14


def relative_error(log_size: int = LOG_SIZE) -> float:
    """What an estimate of a set or a union stays within, as a share, but for one case in 300."""
    return 3 / 2 ** (log_size / 2)


def id_sketch(df: DataFrame, name: str, key: str = "id", log_size: int = LOG_SIZE) -> DataFrame:
    """``name, rows, sketch``: one row for the distinct ids of a table; NULL is no id."""
    text = F.col(key).cast("string")
    return df.agg(F.count(text).alias("rows"), F.theta_sketch_agg(text, log_size).alias("sketch")).select(
        F.lit(name).alias("name"), "rows", "sketch"
    )


def add_up(sketches: DataFrame, log_size: int = LOG_SIZE) -> DataFrame:
    """``name, rows, sketch`` of parts of tables brought together by name."""
    return sketches.groupBy("name").agg(
        F.sum("rows").alias("rows"), F.theta_union_agg("sketch", log_size).alias("sketch")
    )


def compare(sketches: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``measure, key, estimate, bound``: distinct ids of each table; overlap, union, difference and
    symmetric difference of each pair, all from the sketches.

    ``bound`` is how far an estimate may be off: the relative error times the size of the
    union, as what two sets share is estimated from a sample of their union.
    """
    error = F.lit(relative_error())

    def size(sketch: Column) -> Column:
        return F.theta_sketch_estimate(sketch)

    single = sketches.select(
        F.lit("distinct").alias("measure"), F.col("name").alias("key"), size(F.col("sketch")).alias("estimate"),
        (size(F.col("sketch")) * error).alias("bound"),
    )
    parts = [single]
    for key, (a, b) in pairs.items():
        left = sketches.where(F.col("name") == a).select(F.lit(1).alias("_k"), F.col("sketch").alias("a"))
        right = sketches.where(F.col("name") == b).select(F.lit(1).alias("_k"), F.col("sketch").alias("b"))
        # two rows, a few kilobytes each
        both = left.join(right, "_k")
        union, shared = size(F.theta_union("a", "b", LOG_SIZE)), size(F.theta_intersection("a", "b"))
        measures = {
            "overlap": shared,
            "union": union,
            "difference": size(F.theta_difference("a", "b")),
            "symmetric_difference": size(F.theta_difference("a", "b")) + size(F.theta_difference("b", "a")),
        }
        listed = F.array(*(F.struct(F.lit(m).alias("measure"), v.cast("long").alias("estimate")) for m, v in measures.items()))
        parts.append(
            both.select(F.explode(listed).alias("m"), (union * error).alias("bound")).select(
                "m.measure", F.lit(key).alias("key"), "m.estimate", "bound"
            )
        )
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    # exact where nothing was left out of the sketches
    return found.withColumn("bound", F.when(F.col("bound") < F.lit(3 * 2 ** (LOG_SIZE / 2)), 0.0).otherwise(F.col("bound")))
