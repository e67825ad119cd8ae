"""Shards by jump consistent hashing (Lamping and Veach, 2014).

A key's owner is the last stop, before the number of shards, of a chain of jumps that
the key alone determines.  Adding a shard lengthens the chains of a fair share of the
keys by one stop, the new shard, and leaves all others alone; there is no ring table.
One chain answers for ``shards`` and ``shards + 1`` at once.

Integer keys start the published generator as they are (negative ones as their 64-bit
pattern); other types start it with their xxhash64.  All expressions are built in.

Defined results: a NULL key counts as 0; NULL text has no bytes and crc32 0.  Slots
number a shard's rows from 0 by the md5 of the key, so that keys of any pattern spread
evenly; rows alike in key, size and checksum take their slots in any order.  A table's
other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from scribelake.session import materialise

ROW_BYTES = 16
_WORD = "decimal(20,0)"
_TWO_64 = "18446744073709551616"
# fixed value: the multiplier of the published generator
_MULTIPLIER = "2862933555777941757"
# chains this long are the rule; the rest go on until they end
_USUAL_JUMPS = 24


def _unsigned(key: Column) -> Column:
    wide = key.cast(_WORD)
    two_64 = F.lit(_TWO_64).cast("decimal(21,0)")
    return F.when(key < 0, (wide + two_64).cast(_WORD)).otherwise(wide)


def _advance(word: Column) -> Column:
    product = word * F.lit(_MULTIPLIER).cast("decimal(19,0)") + F.lit(1).cast("decimal(1,0)")
    return (product % F.lit(_TWO_64).cast("decimal(20,0)")).cast(_WORD)


def _jump(stop: Column, word: Column) -> Column:
    high = F.floor(word / F.lit(1 << 33).cast("decimal(10,0)")).cast("double") + F.lit(1.0)
    return ((stop + 1).cast("double") * (F.lit(float(1 << 31)) / high)).cast("long")


def _follow(chain: Column, shards: int, jumps: int) -> Column:
    def step(state: Column, _: Column) -> Column:
        moved = F.struct(
            _advance(state["word"]).alias("word"),
            F.when(state["stop"] < shards, state["stop"]).otherwise(state["owner"]).alias("owner"),
            state["stop"].alias("grown"),
            _jump(state["stop"], state["word"]).alias("stop"),
        )
        return F.when(state["stop"] <= shards, moved).otherwise(state)

    return F.aggregate(F.sequence(F.lit(1), F.lit(jumps)), chain, step)


def with_owner(rows: DataFrame, key: str, shards: int) -> DataFrame:
    """``rows`` (id ... ) with a struct column ``chain``: owner and grown shard of ``key``."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    integral = isinstance(rows.schema[key].dataType, IntegralType)
    number = F.col(f"`{key}`") if integral else F.xxhash64(F.col(f"`{key}`"))
    number = F.coalesce(number.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        _advance(_unsigned(number)).alias("word"),
        F.lit(0).cast("long").alias("owner"),
        F.lit(0).cast("long").alias("grown"),
        F.lit(0).cast("long").alias("stop"),
    )
    followed = rows.withColumn("chain", _follow(start, shards, _USUAL_JUMPS))
    # strictly rising stops end within as many jumps as there are shards
    ended = F.col("chain.stop") > shards
    rest = _follow(F.col("chain"), shards, shards + 1)
    return followed.withColumn("chain", F.when(ended, F.col("chain")).otherwise(rest))


def assign_shards(
    docs: DataFrame, shards: int, key: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: key, size, text_crc32, law, shard, slot, grown_shard.

    The rows, without their texts, are written once.  Slots then need no shard in one
    task: a shard is dealt into the 4096 prefixes of the key's md5, whose counts give every
    prefix its first slot.  Rows of one key are numbered together, so a key that very many
    rows share is a task's load, though without texts.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    facts = docs.select(
        F.col(f"`{key}`").alias("key"),
        (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    lean = with_owner(facts, "key", shards).select(
        "key",
        "size",
        "text_crc32",
        F.col("chain.owner").cast("int").alias("shard"),
        F.col("chain.grown").cast("int").alias("grown_shard"),
        F.md5(F.coalesce(F.col("key").cast("string"), F.lit("")).cast("binary")).alias("order"),
    )
    lean = materialise(lean.withColumn("deal", F.substring("order", 1, 3)), "shards")
    before = Window.partitionBy("shard").orderBy("deal").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    first = (
        lean.groupBy("shard", "deal")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "deal", (F.sum("n").over(before) - F.col("n")).alias("first"))
    )
    within = Window.partitionBy("shard", "deal").orderBy("order", "key", "size", "text_crc32")
    numbered = lean.join(first, ["shard", "deal"]).withColumn(
        "slot", F.col("first") + F.row_number().over(within) - 1
    )
    return numbered.select(
        F.col("key").alias(key),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )


def write_shards(docs: DataFrame, path: str, shards: int, key: str = "doc_id") -> None:
    """Write whole rows into one folder per shard, ``shard=k``, without a shuffle by shard."""
    wrapped = docs.select(F.col(f"`{key}`").alias("key"), F.struct("*").alias("row"))
    owned = with_owner(wrapped, "key", shards)
    clear = [c for c in docs.columns if c.lower() != "shard"]
    owned.select(
        *(F.col(f"row.`{c}`").alias(c) for c in clear),
        F.col("chain.owner").cast("int").alias("shard"),
    ).write.partitionBy("shard").parquet(path)
