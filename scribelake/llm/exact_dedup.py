"""Exact duplicates by skew-safe combining.

Equal texts are brought together in three steps, each of which groups by the digest
*and the whole text*, so that two texts with one digest never merge:

1. every task combines its own rows (the map side of the salted aggregation);
2. the rows of a digest, dealt over ``salts`` by their id, are merged per salt, so no
   task gets more of a large group than one row for each task and salt;
3. the salt winners, at most ``salts`` rows for each text, are combined globally.

Defined results: NULL text equals the empty text; of a group the row with the largest
id stays, NULL being the smallest id; rows that repeat an id *and* a text are the same
document listed twice: ``label_copies`` marks all of them as kept, ``keep_one`` returns
one.  Columns besides id and text never matter and may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scribelake.session import materialise

SALTS = 32


def sha256(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def _named(name: str) -> Column:
    return F.col(f"`{name}`")


def _rows(
    docs: DataFrame, id_col: str, text_col: str, salts: int, digest: Callable[[Column], Column]
) -> DataFrame:
    content = F.coalesce(_named(text_col), F.lit(""))
    rest = [_named(c) for c in docs.columns if c != text_col]
    return docs.select(
        _named(id_col).alias("id"),
        content.alias("content"),
        digest(content).alias("digest"),
        F.pmod(F.xxhash64(_named(id_col)), F.lit(salts)).alias("salt"),
        F.struct(_named(text_col).isNull().alias("null"), F.struct(*rest).alias("rest")).alias(
            "row"
        ),
    )


def label_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = SALTS,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest.

    The groups are written once, without their texts except where two texts share a
    digest.  Documents then find their group by digest alone; only those whose digest
    is shared compare texts again.
    """
    rows = _rows(docs, id_col, text_col, salts, digest)
    salted = rows.groupBy("digest", "salt", "content").agg(
        F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    # dealt by digest, of which the window below makes use too
    groups = (
        salted.repartition("digest")
        .groupBy("digest", "content")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        .withColumn("contents", F.count(F.lit(1)).over(Window.partitionBy("digest")))
        .select(
            "digest",
            "keep_id",
            "group_size",
            F.when(F.col("contents") > 1, F.col("content")).alias("content"),
        )
    )
    stored = materialise(groups, "groups")
    # a table of its own, as a rule an empty one, so that Spark knows its size
    shared = materialise(stored.where("content IS NOT NULL"), "shared").select(
        "digest", "content", F.struct("keep_id", "group_size").alias("by_text")
    )
    single = stored.where("content IS NULL").select(
        "digest", F.struct("keep_id", "group_size").alias("by_digest")
    )
    found = (
        rows.select("id", "content", "digest")
        .join(shared, ["digest", "content"], "left")
        .select("id", "digest", "by_text")
        .join(single, "digest", "left")
        .select("id", "digest", F.coalesce("by_text", "by_digest").alias("group"))
    )
    return found.select(
        F.col("id").alias("doc_id"),
        F.col("group.keep_id").alias("keep_id"),
        F.col("group.group_size").alias("group_size"),
        F.col("id").eqNullSafe(F.col("group.keep_id")).alias("kept"),
        "digest",
    )


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = SALTS,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """The rows that stay, whole and with their columns as they came.

    The winner's other columns travel through the three steps with it, so that no join
    follows.
    """
    last = F.max_by("row", F.struct("id")).alias("row")
    salted = (
        _rows(docs, id_col, text_col, salts, digest)
        .groupBy("digest", "salt", "content")
        .agg(last, F.max(F.struct("id")).alias("top"))
        .select("digest", "content", "row", F.col("top.id").alias("id"))
    )
    kept = salted.groupBy("digest", "content").agg(last)
    text = F.when(~F.col("row.null"), F.col("content"))
    return kept.select(
        *(
            (text if c == text_col else F.col(f"row.rest.`{c}`")).alias(c)
            for c in docs.columns
        )
    )
