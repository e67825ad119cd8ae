"""Tables whose row order matters, stored in many files.

Rows are sorted by range, one file a range, files named in order; beside them stands an
index of the files: name, rows, and the place of the first row, a prefix sum of the counts.
A reader finds every row's place from its file and its number in it, whichever task reads it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scribelake.operators.ordering import By, order_of
from scribelake.sources.tables import POSITION, read_table, write_table

INDEX = "_index"


def _file_name(path: str) -> F.Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def write_ordered(
    df: DataFrame,
    path: str,
    *order: str | By,
    drop: Sequence[str] = (),
    files: int | None = None,
    dialect: str = "backslash",
) -> None:
    """Write ``df`` as delimited files in the given order, without the columns ``drop``.

    ``files`` is how many at most; by default the session's number of shuffle partitions.
    The index is written last: a folder without one is unfinished.
    """
    spark = df.sparkSession
    by = [b.sort() for b in order_of(*order)]
    spread = df.repartitionByRange(files, *by) if files else df.repartitionByRange(*by)
    rows = spread.sortWithinPartitions(*by)
    write_table(rows.drop(*drop), path, dialect=dialect)
    columns = [c for c in df.columns if c not in drop]
    stored = read_table(spark, f"{path}/part-*", dialect=dialect, columns=columns, numbered=True)
    # the place in a file is of the stored rows, so line breaks in fields do not count
    sizes = stored.groupBy(_file_name(POSITION[0]).alias("file")).agg(F.count(F.lit(1)).alias("rows"))
    # one row a file; Spark numbers files by range, so their names are in order
    before = Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    index = sizes.withColumn("first_place", F.sum("rows").over(before) - F.col("rows"))
    index.coalesce(1).write.mode("overwrite").parquet(f"{path}/{INDEX}")


def read_ordered(
    spark: SparkSession,
    path: str,
    *,
    columns: Sequence[str] | None = None,
    place: str = "place",
    dialect: str = "backslash",
) -> DataFrame:
    """The rows of an ordered table, each with its place from 0 on."""
    rows = read_table(spark, f"{path}/part-*", dialect=dialect, columns=columns, numbered=True)
    named = [c for c in rows.columns if c not in POSITION]
    index = spark.read.parquet(f"{path}/{INDEX}")
    # a file is one task, whose ids begin at a multiple of 2^33
    keyed = rows.select(*named, _file_name(POSITION[0]).alias("_name"), F.col(POSITION[1]).alias("_id"))
    firsts = keyed.groupBy("_name").agg(F.min("_id").alias("_first_id"))
    starts = firsts.join(index, F.col("_name") == F.col("file")).select(
        "_name", (F.col("first_place") - F.col("_first_id")).alias("_shift")
    )
    return keyed.join(starts, "_name").select(*named, (F.col("_id") + F.col("_shift")).alias(place))
