"""Places in an order over a whole table: row numbers, and the first n rows for any n.

Both sort by range, so that every task holds its share of the order, and add up the counts
of the parts; no row passes through a single task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scribelake.session import materialise

PART, ROW = "_part", "_nr_in_part"


@dataclass(frozen=True)
class By:
    """One column of an order; NULL comes first when ascending, last when descending."""

    column: str
    descending: bool = False

    def sort(self) -> Column:
        return F.desc_nulls_last(self.column) if self.descending else F.asc_nulls_first(self.column)

    def before(self, other: Column) -> Column:
        """Whether the column's value comes strictly before ``other``."""
        own = F.col(self.column)
        if self.descending:
            return F.coalesce(own > other, own.isNotNull() & other.isNull())
        return F.coalesce(own < other, own.isNull() & other.isNotNull())


def order_of(*names: str | By) -> list[By]:
    return [n if isinstance(n, By) else By(n) for n in names]


def _with_places(df: DataFrame) -> DataFrame:
    """``df`` as stored, with its partition and its number in it."""
    row = F.monotonically_increasing_id()
    placed = df.withColumns({PART: F.shiftright(row, 33), ROW: row.bitwiseAND((1 << 33) - 1)})
    return materialise(placed, "placed")


def _starts(placed: DataFrame) -> DataFrame:
    """(part, n, start): one row a partition, with how many rows lie before it."""
    before = Window.partitionBy(F.lit(0)).orderBy(PART).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    sizes = placed.groupBy(PART).agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn("start", F.sum("n").over(before) - F.col("n"))


def numbered(df: DataFrame, *order: str | By, number: str = "place") -> DataFrame:
    """``df`` with each row's number, from 0, in the given order.

    Rows alike in all columns of the order are numbered in any order among themselves; end
    the order with a key if that matters.  The sorted rows are written once.
    """
    by = [b.sort() for b in order_of(*order)]
    placed = _with_places(df.repartitionByRange(*by).sortWithinPartitions(*by))
    starts = _starts(placed).select(PART, "start")
    return placed.join(starts, PART).select(
        *df.columns, (F.col("start") + F.col(ROW)).alias(number)
    )


def first_rows(df: DataFrame, n: int, *order: str | By) -> DataFrame:
    """The first ``n`` rows in the given order, for any ``n``.

    Only the columns of the order are sorted, by range.  The row in which the first ``n``
    end is found from the counts of the ranges; the table is then filtered by comparison with
    that one row, so its other columns are never shuffled.  Of rows alike in all columns of
    the order as many are kept as fit, counted by partition.
    """
    by = order_of(*order)
    if n <= 0:
        return df.limit(0)
    lean = df.select(*(F.col(b.column).alias(f"_k{i}") for i, b in enumerate(by)))
    keys = [By(f"_k{i}", b.descending).sort() for i, b in enumerate(by)]
    placed = _with_places(lean.repartitionByRange(*keys).sortWithinPartitions(*keys))
    starts = _starts(placed)
    held = starts.where((F.col("start") < n) & (F.col("start") + F.col("n") >= n)).first()
    if held is None:
        return df
    # one row of one partition; its values are columns, so that any type compares as itself
    end = placed.where((F.col(PART) == held[PART]) & (F.col(ROW) == n - 1 - held["start"]))
    end = materialise(end.select(F.lit(1).alias("_one"), *(f"_k{i}" for i in range(len(by)))), "end")
    marked = df.withColumn("_one", F.lit(1)).join(F.broadcast(end), "_one").drop("_one")
    alike = [F.col(b.column).eqNullSafe(F.col(f"_k{i}")) for i, b in enumerate(by)]
    before = reduce(
        lambda found, i: found | (_all(alike[:i]) & by[i].before(F.col(f"_k{i}"))),
        range(len(by)),
        F.lit(False),
    )
    ahead, ties = marked.where(before).select(*df.columns), marked.where(_all(alike)).select(*df.columns)
    # how many rows tie is counted on the sorted keys
    counted = placed.join(F.broadcast(end.drop("_one").withColumnsRenamed(
        {f"_k{i}": f"_e{i}" for i in range(len(by))}
    )), _all([F.col(f"_k{i}").eqNullSafe(F.col(f"_e{i}")) for i in range(len(by))]))
    starts = starts.withColumnRenamed("n", "rows")
    tied = counted.join(starts, PART).agg(
        F.min(F.col("start") + F.col(ROW)).alias("first"), F.count(F.lit(1)).alias("n")
    ).first()
    rest = n - tied["first"]
    if rest == tied["n"]:
        return ahead.unionByName(ties)
    stored = _with_places(ties)
    chosen = stored.join(_starts(stored).select(PART, "start"), PART).where(
        F.col("start") + F.col(ROW) < rest
    )
    return ahead.unionByName(chosen.select(*df.columns))


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
