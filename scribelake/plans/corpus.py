"""The corpus profile: all tables of one report from few passes over the transcripts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribelake.functions.roles import canonical, need_columns
from scribelake.operators import profile, vocabulary
from scribelake.operators.ids import repeat_count
from scribelake.session import materialise
from scribelake.sources.fingerprint import fingerprint
from scribelake.sources.splits import LABEL_COLUMNS
from scribelake.sources.tables import write_table

# What the histogram of one pass has to hold for quantiles and counts.
_KEYS = ("language", "original_split")


def corpus_profile(
    train: DataFrame,
    test: DataFrame,
    template: DataFrame,
    *,
    top_n: int = 50,
    files: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """The report's tables by name.

    The transcripts are normalised twice: once for the histogram (quantiles, split and
    language counts, checks of single rows), once for token counts (drift and top
    tokens).  Repeated transcripts take a look at the raw texts' digests.  The first two
    results are far smaller than the corpus and are written to shared scratch storage,
    so later tables start from them and survive lost executors.
    """
    need_columns(train.columns, LABEL_COLUMNS, "train table")
    test_ids, template_ids = canonical(test), canonical(template)

    raw = F.coalesce("transcription", F.lit(""))
    features = profile.text_features(train.select(*_KEYS, "transcription")).withColumn(
        "raw_empty", (raw == "").cast("int")
    )
    names = (*profile.QUANTILE_FEATURES, *profile.CHECK_FEATURES)
    histogram = materialise(profile.feature_histogram(features, _KEYS, names), "histogram")
    checks = (
        profile.id_checks(train, test_ids, template_ids),
        profile.row_checks(histogram),
        repeat_count(train, "transcription", "repeated_transcriptions"),
    )
    # every row is counted once under each feature
    sizes = histogram.where(F.col("feature") == profile.QUANTILE_FEATURES[0]).withColumnRenamed(
        "n", "rows"
    )
    tokens = materialise(
        vocabulary.token_counts(train.select(*_KEYS, "transcription"), *_KEYS), "tokens"
    )
    tables = {
        "language_split_counts": sizes.where(
            F.col("language").isNotNull() & F.col("original_split").isNotNull()
        )
        .groupBy(*_KEYS)
        .agg(F.sum("rows").alias("rows"))
        .orderBy(*_KEYS),
        "language_counts": sizes.where(F.col("language").isNotNull())
        .groupBy("language")
        .agg(F.sum("rows").alias("rows"))
        .orderBy(F.desc("rows"), "language"),
        "test_id_prefix_counts": profile.prefix_counts(test_ids),
        "transcript_length_by_language_split": profile.quantiles_from_histogram(histogram, _KEYS),
        "validation_oov_by_language": _drift(tokens, sizes),
        "quality_flags": reduce(DataFrame.unionByName, map(profile.as_flags, checks)),
        "top_tokens": _top(tokens, top_n),
    }
    if files:
        tables["dataset_fingerprint"] = fingerprint(train.sparkSession, files)
    return tables


def _drift(tokens: DataFrame, sizes: DataFrame) -> DataFrame:
    """Drift from token counts that already exist per language and split."""

    def occurrences(split: str):
        return F.coalesce(
            F.sum(F.when(F.col("original_split") == split, F.col("count"))), F.lit(0)
        )

    counts = (
        tokens.where(F.col("language").isNotNull())
        .groupBy("language", "token")
        .agg(
            occurrences("train").alias("known_count"),
            occurrences("validation").alias("checked_count"),
        )
    )
    return vocabulary.drift_from_counts(counts, sizes.select("language"))


def _top(tokens: DataFrame, n: int) -> DataFrame:
    per_language = (
        tokens.where(F.col("language").isNotNull())
        .groupBy("language", "token")
        .agg(F.sum("count").alias("count"))
    )
    return vocabulary.top_from_counts(per_language, n)


def write_corpus_profile(tables: dict[str, DataFrame], path: str) -> None:
    """One folder per table; top tokens in one folder per language."""
    for name, table in tables.items():
        if name == "top_tokens":
            write_table(table.drop("rank"), f"{path}/{name}", partition_by=["language"])
        else:
            write_table(table, f"{path}/{name}", single_file=True)


def table_profiles(spark: SparkSession, tables: dict[str, DataFrame | None]) -> DataFrame:
    """Profiles of several tables, one row per column; a missing table gives one row."""
    missing = (
        "path string, column string, roles string, value string, rows long, nulls long, "
        "distinct_ids long"
    )
    parts = [
        spark.createDataFrame([(path, None, "missing", None, None, None, None)], missing)
        if df is None
        else profile.table_profile(df, path)
        for path, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)
