"""From raw documents to token ids, in five stages.

Each stage takes all that the one before it kept, written as Parquet and read again, and
calls one operator of ``scribelake.llm``; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribelake.llm import bpe, exact_dedup, mixing, quality, simhash
from scribelake.llm.queries import MIX, bucket, prepare
from scribelake.session import step, step_result


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    prepare(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, bucket("doc_id", 4) != 2)
    # the columns travel as one, so that none can clash with those of the classifier
    wrapped = docs.select("text", F.struct("*").alias("row"))
    accepted = quality.predict(wrapped, model).where("predicted = 1")
    return accepted.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id."""
    prepare(spark)
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates, and those connected by them, the one with the smallest id."""
    prepare(spark)
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    prepare(spark)
    return mixing.mix(docs, **MIX)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digest of what they decode to."""
    prepare(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.round_trip(docs.select("doc_id", "source", "text"), path)
    return coded.select(
        "doc_id",
        "source",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", to_tokens),
]

# the classifier, XXH64 and the merges have no counterpart in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result but the last is written and read again.

    What a stage stored on the way to its result is deleted when the result is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with step(spark) as paths:
            docs = step_result(stage(spark, docs, sf_dir), name.replace(" ", "-"), paths)
    return STAGES[-1][1](spark, docs, sf_dir)
