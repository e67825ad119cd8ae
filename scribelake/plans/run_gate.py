"""Regression gate: did a slice get worse from one run to the next, and is that certain?"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate
from math import exp, factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scribelake.operators.scoring import EDIT_COLUMNS, combine
from scribelake.session import materialise

# draws of one digest, eight hexadecimal digits each
_DRAWS = 4
# chances that a Poisson draw of mean one is at most 0, 1, ...; beyond lies less than 2^-32
POISSON = tuple(accumulate(exp(-1) / factorial(k) for k in range(12)))


def regressions(history: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Every run and slice with the previous error, the change, and a ``worse`` flag.

    A window holds the runs of one slice, one short row each.
    """
    runs = Window.partitionBy("slice", "value").orderBy("created_at_utc", "experiment_id")
    changed = history.withColumn("previous_error", F.lag("error").over(runs)).withColumn(
        "change", F.col("error") - F.col("previous_error")
    )
    return changed.select(
        "experiment_id",
        "created_at_utc",
        "slice",
        "value",
        "error",
        "previous_error",
        "change",
        F.coalesce(F.col("change") > F.lit(float(tolerance)), F.lit(False)).alias("worse"),
    )


def _share(digits: Column) -> Column:
    """Eight hexadecimal digits as a number from 0 to below 1."""
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 32))


def _times(u: Column) -> Column:
    """How often a row is drawn, from a number from 0 to below 1."""
    return sum(((u >= F.lit(p)).cast("int") for p in POISSON), F.lit(0))


def _poisson(digits: Column) -> Column:
    """How often a row is drawn, from eight hexadecimal digits."""
    return _times(_share(digits))


def bootstrap_changes(
    first: DataFrame,
    second: DataFrame,
    slices: Sequence[str] = ("language",),
    *,
    replicates: int = 100,
    seed: int = 13,
    confidence: float = 0.95,
) -> DataFrame:
    """``slice, value, rows, change, low, high, worse``: the change of the error from the
    ``first`` run to the ``second``, with its interval over paired bootstrap replicates.

    Both are scored tables of the same ids (:func:`scoring.with_edits`).  In a replicate
    every pair of rows counts as often as a Poisson draw of mean one says, which follows from
    seed, id and replicate alone: reruns and both runs agree on it, and rows need not be
    drawn together.  Edits are summed per combination of slice values and replicate, in each
    task first; replicates share digests, four to one.  A slice is ``worse`` if the whole
    interval lies above zero.
    """
    counts = [F.col(c).cast("long") for c in EDIT_COLUMNS]
    own = first.select("id", *slices, *(c.alias(f"a_{n}") for c, n in zip(counts, EDIT_COLUMNS)))
    other = second.select("id", *(c.alias(f"b_{n}") for c, n in zip(counts, EDIT_COLUMNS)))
    names = [f"{side}_{n}" for side in "ab" for n in EDIT_COLUMNS]
    digests = -(-replicates // _DRAWS)
    # read as numbers before they are exploded: each is compared with every chance
    shares = F.slice(F.flatten(F.transform(
        F.sequence(F.lit(0), F.lit(digests - 1)),
        lambda d: F.transform(
            F.array(F.md5(F.concat_ws(":", F.lit(str(seed)), "id", d.cast("string")))),
            lambda h: F.array(*(_share(F.substring(h, 1 + 8 * j, 8)) for j in range(_DRAWS))),
        )[0],
    )), 1, replicates)
    # NULL stands for replicate -1, the rows as they are
    drawn = F.posexplode(F.concat(F.array(F.lit(None).cast("double")), shares)).alias("place", "u")
    times = F.when(F.col("u").isNull(), F.lit(1)).otherwise(_times(F.col("u")))
    told = own.join(other, "id").select("*", drawn).withColumns(
        {"replicate": F.col("place") - 1, "times": times}
    )
    cells = (
        told.where("times > 0")
        .groupBy(*slices, "replicate")
        .agg(F.sum("times").alias("rows"), *(F.sum(F.col(n) * F.col("times")).alias(n) for n in names))
    )
    cells = materialise(cells, "replicates")
    entries = F.array(
        F.struct(F.lit("overall").alias("slice"), F.lit("").alias("value")),
        *(F.struct(F.lit(s).alias("slice"), F.col(s).cast("string").alias("value")) for s in slices),
    )
    sums = (
        cells.select(F.explode(entries).alias("s"), "replicate", "rows", *names).select("s.*", "replicate", "rows", *names)
        .where(F.col("value").isNotNull())
        .groupBy("slice", "value", "replicate")
        .agg(F.sum("rows").alias("rows"), *(F.sum(n).alias(n) for n in names))
    )

    def error(side: str) -> Column:
        wer, cer = (
            F.col(f"{side}_{kind}_edits").cast("double")
            / F.greatest(F.col(f"{side}_{kind}_total"), F.lit(1)).cast("double")
            for kind in ("word", "char")
        )
        return combine(wer, cer)[0]

    changes = sums.withColumn("change", error("b") - error("a"))
    replicate, tail = F.col("replicate") >= 0, (1 - confidence) / 2
    interval = F.percentile(F.when(replicate, F.col("change")), F.array(F.lit(tail), F.lit(1 - tail)))
    found = changes.groupBy("slice", "value").agg(
        F.max(F.when(~replicate, F.col("rows"))).alias("rows"),
        F.max(F.when(~replicate, F.col("change"))).alias("change"),
        interval.alias("interval"),
    )
    low, high = F.col("interval")[0], F.col("interval")[1]
    return found.select(
        "slice", "value", "rows", "change", low.alias("low"), high.alias("high"), (low > 0).alias("worse")
    )
