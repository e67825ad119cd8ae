"""Metrics at several levels at once: overall, by keys and by combinations of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribelake.operators import scoring


def metrics_at(scored: DataFrame, *levels: Sequence[str]) -> DataFrame:
    """``level, keys..., rows, wer, cer, error, score`` for each set of keys in ``levels``.

    One aggregation over the combinations of all keys, then one ``GROUPING SETS`` over
    its few rows.  ``level`` names the keys of a row; the other keys are NULL there.  Rows
    with a NULL in a key of a level are left out of that level.
    """
    keys = list(dict.fromkeys(k for level in levels for k in level))
    cells = scoring.totals(scored, *keys)
    grouped = cells.groupingSets([[F.col(k) for k in level] for level in levels], *keys).agg(
        F.sum("rows").alias("rows"),
        *(F.sum(c).alias(c) for c in scoring.EDIT_COLUMNS),
        *(F.grouping(k).alias(f"_out_{k}") for k in keys),
    )
    inside = [F.when(F.col(f"_out_{k}") == 0, F.lit(k)) for k in keys]
    level = F.concat_ws(",", *inside) if keys else F.lit("")
    known = F.lit(True)
    for k in keys:
        known = known & ((F.col(f"_out_{k}") == 1) | F.col(k).isNotNull())
    named = grouped.where(known).withColumn("level", level)
    return scoring.rates(named, "level", *keys)
