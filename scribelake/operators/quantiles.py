"""Exact quantiles in bounded memory, and slices by buckets that are found from the data.

A KLL sketch per group, merged over all tasks, brackets every quantile; a counting round says
how many values lie below each bracket; only the values inside, a share of the sketch's error,
are put in order, each distinct value once with its count.  While a bracket holds more
distinct values than ``most`` it is bracketed again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scribelake.session import materialise

K = 2048
MOST = 1_000_000


def _alike(by: Sequence[str], other: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{other}{c}")) for c in by], F.lit(True))


def _bracket(p: float, k: int) -> tuple[Column, Column]:
    """Values that, almost certainly, lie on either side of a quantile; few values are all kept."""
    low, high = (F.kll_sketch_get_quantile_double("s", F.lit(min(max(q, 0.0), 1.0))) for q in (p - 6 / k, p + 6 / k))
    few = F.col("n") <= 4 * k
    return F.when(few | F.lit(p <= 6 / k), F.col("least")).otherwise(low), F.when(
        few | F.lit(p >= 1 - 6 / k), F.col("largest")
    ).otherwise(high)


def exact_quantiles(
    df: DataFrame,
    value: str,
    probabilities: Sequence[float],
    by: Sequence[str] = (),
    *,
    k: int = K,
    most: int = MOST,
) -> DataFrame:
    """``by, n, quantiles``: linearly interpolated quantiles of a numeric column per group.

    NULL and NaN values are left out, a group without others has no row; NULL is a group.
    """
    given = [f"_by{i}" for i in range(len(by))]
    base = df.select(
        *(F.col(c).alias(g) for c, g in zip(by, given)), F.col(value).cast("double").alias("v")
    ).where(F.col("v").isNotNull() & ~F.isnan("v"))
    ends = F.min("v").alias("least"), F.max("v").alias("largest")
    groups = base.groupBy(*given).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("v", k).alias("s"), *ends
    ).where("n > 0")
    wide = groups
    for i, p in enumerate(probabilities):
        low, high = (f((F.col("n") - 1) * F.lit(float(p))) for f in (F.floor, F.ceil))
        lo, hi = _bracket(p, k)
        wide = wide.withColumns({f"low{i}": low, f"high{i}": high, f"lo{i}": lo, f"hi{i}": hi})
    # one row a group
    wide = materialise(wide.drop("s", "least", "largest").withColumnsRenamed({g: f"_o{g}" for g in given}), "brackets")
    sets = range(len(probabilities))
    joined = base.join(wide, _alike(given, "_o"))
    below = materialise(
        joined.groupBy(*given).agg(*(F.count_if(F.col("v") < F.col(f"lo{i}")).alias(f"below{i}") for i in sets)),
        "below",
    )
    inside = F.array(*(
        F.when((F.col("v") >= F.col(f"lo{i}")) & (F.col("v") <= F.col(f"hi{i}")), F.lit(i)) for i in sets
    ))
    held = joined.select(*given, "v", F.explode(F.array_compact(inside)).alias("i"))
    held = materialise(held.groupBy(*given, "i", "v").agg(F.count(F.lit(1)).alias("m")), "inside")

    # the ranks asked for, counted from the beginning of each bracket
    ranks = F.array(*(
        F.struct(F.lit(i).alias("i"), (F.col(f"low{i}") - F.col(f"below{i}")).alias("low"),
                 (F.col(f"high{i}") - F.col(f"below{i}")).alias("high"),
                 ((F.col("n") - 1) * F.lit(float(p)) - F.col(f"low{i}")).alias("part"))
        for i, p in enumerate(probabilities)
    ))
    asked = wide.join(below, _alike(given, "_o")).select(*given, "n", F.explode(ranks).alias("r"))
    asked = materialise(asked.select(*given, "n", "r.*"), "ranks")
    keys = [*given, "i"]
    while True:
        sizes = held.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("distinct"), F.sum("m").alias("rows"), F.kll_sketch_agg_double("v", k).alias("s")
        ).withColumnsRenamed({c: f"_o{c}" for c in keys})
        missed = asked.join(sizes, _alike(keys, "_o")).where("low < 0 OR high >= rows")
        if not missed.isEmpty():
            raise RuntimeError("a quantile lies outside its bracket; ask again, with a larger k")
        if sizes.agg(F.max("distinct")).first()[0] is None or sizes.where(F.col("distinct") > most).isEmpty():
            break
        held, asked = _narrowed(held, asked, sizes.where(F.col("distinct") > most), keys, k)
    order = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = held.withColumn("end", F.sum("m").over(order)).withColumnsRenamed({c: f"_o{c}" for c in keys})
    found = asked.join(placed, _alike(keys, "_o")).groupBy(*keys).agg(
        F.first("n").alias("n"), F.first("part").alias("part"),
        F.min(F.when(F.col("end") > F.col("low"), F.col("v"))).alias("a"),
        F.min(F.when(F.col("end") > F.col("high"), F.col("v"))).alias("b"),
    )
    between = F.col("a") + (F.col("b") - F.col("a")) * F.col("part")
    listed = found.groupBy(*given).agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", between.alias("q")))).alias("qs")
    )
    # without groups an aggregate of nothing is a row
    listed = listed.where(F.col("n").isNotNull())
    return listed.select(*(F.col(g).alias(c) for g, c in zip(given, by)), "n", F.col("qs.q").alias("quantiles"))


def _narrowed(
    held: DataFrame, asked: DataFrame, large: DataFrame, keys: list[str], k: int
) -> tuple[DataFrame, DataFrame]:
    """Brackets within brackets of too many distinct values; the sketch counts each value once,
    so the new bracket is sought by the places of the values, found by adding up slices."""
    slices = F.array(*(F.kll_sketch_get_quantile_double(F.col("s"), F.lit(j / 64)) for j in range(1, 64)))
    edges = large.select(*(f"_o{c}" for c in keys), slices.alias("edges"))
    cut = held.join(edges, _alike(keys, "_o"), "left").withColumn(
        "slice", F.coalesce(F.size(F.filter("edges", lambda e: e < F.col("v"))), F.lit(0))
    )
    cut = materialise(cut.select(*keys, "v", "m", "slice"), "slices")
    order = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = cut.groupBy(*keys, "slice").agg(F.sum("m").alias("m")).withColumn("end", F.sum("m").over(order))
    sums = sums.withColumn("start", F.col("end") - F.col("m")).withColumnsRenamed({c: f"_o{c}" for c in keys})
    hit = asked.join(sums, _alike(keys, "_o")).where(
        (F.col("end") > F.col("low")) & (F.col("start") <= F.col("high"))
    )
    kept = materialise(hit.groupBy(*keys).agg(
        F.min("slice").alias("from"), F.max("slice").alias("to"), F.min("start").alias("start")
    ).withColumnsRenamed({c: f"_o{c}" for c in keys}), "kept")
    inside = cut.join(kept, _alike(keys, "_o")).where(F.col("slice").between(F.col("from"), F.col("to")))
    shifted = asked.join(kept, _alike(keys, "_o")).select(
        *keys, "n", (F.col("low") - F.col("start")).alias("low"), (F.col("high") - F.col("start")).alias("high"), "part"
    )
    return materialise(inside.select(*keys, "v", "m"), "inside"), materialise(shifted, "ranks")


def with_quantile_bucket(
    df: DataFrame, value: str, name: str, *, parts: int = 4, by: Sequence[str] = ()
) -> DataFrame:
    """Add ``name``: from 1 to ``parts``, in which quantile part of its group the value lies.

    A value on an edge belongs to the lower part; NULL and NaN have none.  The edges are one
    row a group, written and read, so that Spark knows how small they are.
    """
    edges = exact_quantiles(df, value, [i / parts for i in range(1, parts)], by)
    edges = edges.select(*(F.col(c).alias(f"_e{c}") for c in by), "quantiles")
    edges = materialise(edges.withColumnRenamed("quantiles", "_edges"), "edges")
    v = F.col(value).cast("double")
    # named once, as a lambda would cast the value anew at each edge
    above = F.size(F.filter("_edges", lambda e: v > e)) + 1
    joined = df.join(edges, _alike(by, "_e"), "left")
    return joined.withColumn(name, F.when(v.isNotNull() & ~F.isnan(v), above)).select(*df.columns, name)
