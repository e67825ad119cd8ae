"""Row selection: id lists, relabelling, limits, repeatable samples, balancing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scribelake.operators.ids import IncompleteError, repeat_count
from scribelake.session import materialise

# Parts that a group is cut in before its first rows are put together.
_PARTS = 1024
# Leading hash digits by which a sample's end is located, in two rounds.
_HASH_DIGITS = 3


def only_ids(df: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose id is wanted; an id wanted often is looked for once."""
    return df.join(wanted.select(key).distinct(), key, "left_semi")


def relabel(
    rows: DataFrame,
    labels: DataFrame,
    *,
    text: str = "text",
    label: str = "label",
    order: str | None = None,
    key: str | Sequence[str] = "id",
    checked: bool = True,
) -> DataFrame:
    """Replace ``text`` by the label of the same id; rows without a label are dropped.

    Repeated label ids are refused, unless ``order`` names the column by which the
    last one wins; that choice is an aggregate, so a hot id is combined in each task.
    A key may have several columns; rows in which one of them is NULL match nothing.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if order is not None:
        labels = labels.groupBy(*keys).agg(F.max_by(label, order).alias(label))
    elif checked:
        again = repeat_count(labels, keys, digest=False).first()["repeated"]
        if again:
            raise IncompleteError(f"{again} label rows repeat an id")
    columns = rows.columns
    joined = rows.drop(text).join(labels.select(*keys, F.col(label).alias(text)), keys)
    return joined.select(*columns)


def override_language(
    rows: DataFrame, languages: DataFrame, key: str = "id", column: str = "language"
) -> DataFrame:
    """Take the language of the id table where it has one for the id.

    An id listed with several languages gets the largest, whatever the row order.
    """
    given = languages.groupBy(key).agg(F.max(column).alias("_given"))
    joined = rows.join(given, key, "left")
    return joined.withColumn(column, F.coalesce("_given", column)).select(*rows.columns)


def first_n(df: DataFrame, n: int, order: str = "id", *, strict: bool = False) -> DataFrame:
    """First ``n`` rows in the given order; ``strict`` refuses a table with fewer."""
    if strict and (have := df.count()) < n:
        raise ValueError(f"asked for {n} rows of {have}")
    return df.orderBy(order).limit(n)


def shown(df: DataFrame, max_rows: int = 20) -> DataFrame:
    """The first rows of a result table, for display; order the table first."""
    return df.limit(max_rows)


def _shuffled(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def _end_of(sizes: DataFrame, rest: Column) -> DataFrame:
    """The one row of ``sizes`` (prefix, n, ...) in which the first ``rest`` rows end.

    There are at most ``16 ** _HASH_DIGITS`` sizes, however large the table.
    """
    so_far = Window.partitionBy("part").orderBy("prefix").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ends = sizes.withColumn("part", F.lit(1)).withColumn("end", F.sum("n").over(so_far))
    before = F.col("end") - F.col("n")
    return ends.where((F.col("end") >= rest) & (before < rest)).select(
        "prefix", (rest - before).alias("rest"), "part"
    )


def sample_n(df: DataFrame, n: int, *, seed: int = 13, key: str = "id") -> DataFrame:
    """A repeatable random sample of ``n`` rows, whatever the partitioning.

    The sample is the first ``n`` rows by a seeded hash of their id.  Where it ends is
    located by counting rows per three leading hash digits, then, inside the digits in
    which it ends, per the next three; only the rows of those six digits are ordered.
    """
    if n <= 0:
        return df.limit(0)
    tagged = df.withColumn("_h", _shuffled(key, seed)).withColumn("_part", F.lit(1))
    sizes = tagged.groupBy(F.substring("_h", 1, _HASH_DIGITS).alias("prefix")).agg(
        F.count(F.lit(1)).alias("n")
    )
    first = materialise(_end_of(sizes, F.lit(n)), "sample-end")
    inside = tagged.join(first, F.col("_part") == F.col("part")).where(
        F.substring("_h", 1, _HASH_DIGITS) == F.col("prefix")
    )
    sizes = inside.groupBy(F.substring("_h", 1, 2 * _HASH_DIGITS).alias("prefix")).agg(
        F.count(F.lit(1)).alias("n"), F.first("rest").alias("wanted")
    )
    end = materialise(_end_of(sizes, F.col("wanted")), "sample-end")
    placed = tagged.join(end, F.col("_part") == F.col("part"), "left")
    digits = F.substring("_h", 1, 2 * _HASH_DIGITS)
    # without an end the table has fewer rows than were asked for
    whole = placed.where(F.col("prefix").isNull() | (digits < F.col("prefix")))
    order = Window.partitionBy("prefix").orderBy("_h", key)
    last = placed.where(digits == F.col("prefix")).withColumn("_r", F.row_number().over(order))
    return whole.select(*df.columns).unionByName(
        last.where(F.col("_r") <= F.col("rest")).select(*df.columns)
    )


def top_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, *, spread: str
) -> DataFrame:
    """First ``n`` rows of each group under ``order``, with their ``rank``.

    Each group is first cut within 1024 parts, by a hash of ``spread``, so the task that
    puts a group together gets at most 1024 times ``n`` rows of it.
    """
    parts = Window.partitionBy(*group, F.pmod(F.xxhash64(spread), F.lit(_PARTS))).orderBy(*order)
    cut = df.withColumn("_r", F.row_number().over(parts)).where(F.col("_r") <= n).drop("_r")
    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col("rank") <= n)


def balance_factors(df: DataFrame, group: str = "language") -> DataFrame:
    """Per group: its rows, and how many copies of it match the largest group."""
    counts = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("rows"))
    largest = counts.agg(F.max("rows").alias("largest")).withColumn("part", F.lit(1))
    return (
        counts.withColumn("part", F.lit(1))
        .join(largest, "part")
        .select(
            group,
            "rows",
            (F.col("largest").cast("double") / F.col("rows").cast("double")).alias("copies"),
        )
    )


def oversample(
    df: DataFrame, *, group: str = "language", key: str = "id", seed: int = 13
) -> DataFrame:
    """Repeat the rows of smaller groups up to about the size of the largest.

    Each row appears ``floor(copies)`` times, plus once more when its seeded hash
    falls below the remaining fraction; ``copy`` numbers the repeats.  The factors,
    one row per group, are written and read back: Spark then knows their size and, as
    it is small, broadcasts them, so the table is not shuffled by its few, uneven groups.
    """
    factors = materialise(balance_factors(df, group).select(group, "copies"), "factors")
    position = F.conv(F.substring(_shuffled(key, seed), 1, 8), 16, 10).cast("double") / F.lit(
        float(16**8)
    )
    whole = F.floor("copies")
    times = whole + (position < F.col("copies") - whole).cast("int")
    joined = df.join(factors, group)
    return joined.select(
        *df.columns, F.explode(F.sequence(F.lit(1), times.cast("int"))).alias("copy")
    )
