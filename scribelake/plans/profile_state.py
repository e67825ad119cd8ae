"""A corpus profile that takes in new partitions without reading the old ones again.

The state is additive: occurrences of each token, and rows of each value of the length
features, per language and split.  Adding a batch counts that batch alone, adds the counts to
the last version's and writes a new version; a list says which batches a version has,
so a batch that is added again, by a job that was retried, changes nothing.  Drift, top
tokens and quantiles are read from the state.

Folder ``version=N`` holds ``tokens``, ``lengths`` and, written last, ``batches``: a version
without it is unfinished and not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribelake.operators import profile, vocabulary
from scribelake.sources.files import delete_path, names_in, path_exists

KEYS = ("language", "original_split")
TOKENS = "language string, original_split string, token string, count long"
LENGTHS = "language string, original_split string, feature string, value long, n long"
BATCHES = "batch string, rows long"
SCHEMAS = {"tokens": TOKENS, "lengths": LENGTHS, "batches": BATCHES}


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished versions."""
    found = (int(n.split("=")[1]) for n in names_in(spark, path) if n.startswith("version="))
    return sorted(v for v in found if path_exists(spark, f"{path}/version={v}/batches/_SUCCESS"))


def read_state(spark: SparkSession, path: str, part: str) -> DataFrame:
    """``tokens``, ``lengths`` or ``batches`` of the last version."""
    last = versions(spark, path)
    if not last:
        return spark.createDataFrame([], SCHEMAS[part])
    return spark.read.schema(SCHEMAS[part]).parquet(f"{path}/version={last[-1]}/{part}")


def add_batch(
    corpus: DataFrame, path: str, batch: str, *, features: Sequence[str] = profile.QUANTILE_FEATURES
) -> bool:
    """Count ``corpus`` into the state as ``batch``; ``False`` if the state has it already.

    Texts are normalised once for the tokens and once for the features.  Counting starts in
    each task; the old version comes to the same shuffle as one row a token.
    """
    spark = corpus.sparkSession
    done = read_state(spark, path, "batches")
    if not done.where(F.col("batch") == batch).isEmpty():
        return False
    last = versions(spark, path)
    new = f"{path}/version={last[-1] + 1 if last else 0}"
    tokens = vocabulary.token_counts(corpus, *KEYS).select(*KEYS, "token", F.col("count").cast("long"))
    merged = read_state(spark, path, "tokens").unionByName(tokens)
    merged.groupBy(*KEYS, "token").agg(F.sum("count").alias("count")).write.mode("overwrite").parquet(f"{new}/tokens")
    lengths = profile.feature_histogram(profile.text_features(corpus), KEYS, features)
    merged = read_state(spark, path, "lengths").unionByName(lengths)
    summed = merged.groupBy(*KEYS, "feature", "value").agg(F.sum("n").alias("n"))
    summed.write.mode("overwrite").parquet(f"{new}/lengths")
    entry = spark.createDataFrame([(batch, corpus.count())], BATCHES)
    done.unionByName(entry).coalesce(1).write.mode("overwrite").parquet(f"{new}/batches")
    # readers of the version before may still be at work
    for old in last[:-1]:
        delete_path(spark, f"{path}/version={old}")
    return True


def drift(spark: SparkSession, path: str, known: str = "train", checked: str = "validation") -> DataFrame:
    """As :func:`vocabulary.vocabulary_drift` of all batches, from the state alone."""
    tokens = read_state(spark, path, "tokens").where(F.col("language").isNotNull())

    def of(split: str):
        return F.coalesce(F.sum(F.when(F.col("original_split") == split, F.col("count"))), F.lit(0))

    counts = tokens.where(F.col("original_split").isin(known, checked)).groupBy("language", "token").agg(
        of(known).alias("known_count"), of(checked).alias("checked_count")
    )
    return vocabulary.drift_from_counts(counts, read_state(spark, path, "lengths").select("language"))


def quantiles(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`profile.length_quantiles` of all batches, from the state alone."""
    return profile.quantiles_from_histogram(read_state(spark, path, "lengths"), KEYS)


def top_tokens(spark: SparkSession, path: str, n: int = 50) -> DataFrame:
    """As :func:`vocabulary.top_tokens` of all batches, from the state alone."""
    tokens = read_state(spark, path, "tokens").where(F.col("language").isNotNull())
    counts = tokens.groupBy("language", "token").agg(F.sum("count").alias("count"))
    return vocabulary.top_from_counts(counts, n)
