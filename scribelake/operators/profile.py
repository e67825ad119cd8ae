"""Profiles of labelled transcript tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribelake.functions import text
from scribelake.functions.roles import find_role
from scribelake.operators.ids import counts_by_id, how_many, repeated, text_digest

# Features summarised by quantiles, and the quantiles by name.
QUANTILE_FEATURES = ("char_len", "word_len", "unique_word_len", "punct_count")
QUANTILES = {
    "min": 0.0,
    "p25": 0.25,
    "median": 0.5,
    "p75": 0.75,
    "p95": 0.95,
    "max": 1.0,
}

# Integrity checks and how serious a non-zero count is.
SEVERITY = {
    "duplicate_train_ids": "high",
    "duplicate_test_ids": "high",
    "train_test_id_overlap": "high",
    "test_sample_id_symmetric_difference": "high",
    "empty_train_transcriptions": "high",
    "normalized_empty_train_transcriptions": "high",
    "repeated_transcriptions": "medium",
    "transcriptions_with_digits": "medium",
    "transcriptions_with_quotes": "medium",
}


def text_features(corpus: DataFrame, column: str = "transcription") -> DataFrame:
    """Add the eight length and character counts of each transcript."""
    raw = F.col(column)
    return (
        corpus.withColumn("_n", text.normalise(raw))
        .withColumns(
            {
                "char_len": F.char_length("_n"),
                "word_len": text.word_count("_n"),
                "unique_word_len": F.size(F.array_distinct(text.words("_n"))),
                "comma_count": text.comma_count(raw),
                "quote_count": text.quote_count(raw),
                "apostrophe_count": text.apostrophe_count(raw),
                "digit_count": text.digit_count(raw),
                "punct_count": text.punctuation_count(raw),
            }
        )
        .drop("_n")
    )


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    """Rows per key, sorted by key; rows with a NULL key are left out."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.where(known).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).orderBy(*keys)


def value_counts(
    df: DataFrame, value: Column | str, name: str, *, keep_null: bool = False
) -> DataFrame:
    """Rows per value, most frequent first; ties go to the smaller value."""
    values = df.select((F.col(value) if isinstance(value, str) else value).alias(name))
    if not keep_null:
        values = values.where(F.col(name).isNotNull())
    return values.groupBy(name).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), name)


def feature_histogram(features: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """``keys, feature, value, n``: how many rows show each value of each feature.

    One pass, counted inside each task first; the result has one row per distinct
    value and is what quantiles and most integrity checks are read from.
    """
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("feature"), F.col(name).cast("long").alias("value"))
            for name in names
        ]
    )
    return (
        features.select(*keys, F.explode(entries).alias("e"))
        .select(*keys, "e.feature", "e.value")
        .groupBy(*keys, "feature", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def quantiles_from_histogram(histogram: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact, linearly interpolated quantiles of each feature, one row per key."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    chosen = histogram.where(known & F.col("feature").isin(*QUANTILE_FEATURES))
    shares = F.array(*[F.lit(q) for q in QUANTILES.values()])
    columns = [F.sum(F.when(F.col("feature") == QUANTILE_FEATURES[0], F.col("n"))).alias("rows")]
    for feature in QUANTILE_FEATURES:
        one = F.when(F.col("feature") == feature, F.col("value"))
        columns.append(F.percentile(one, shares, F.col("n")).alias(feature))
    wide = chosen.groupBy(*keys).agg(*columns)
    return wide.select(
        *keys,
        "rows",
        *[
            F.col(feature)[i].alias(f"{feature}_{name}")
            for feature in QUANTILE_FEATURES
            for i, name in enumerate(QUANTILES)
        ],
    ).orderBy(*keys)


def length_quantiles(
    features: DataFrame, keys: Sequence[str] = ("language", "original_split")
) -> DataFrame:
    """Quantiles of the four length features per key; needs :func:`text_features` first."""
    return quantiles_from_histogram(feature_histogram(features, keys, QUANTILE_FEATURES), keys)


def id_checks(train: DataFrame, test: DataFrame, template: DataFrame) -> DataFrame:
    """One row with the four id checks; all three tables need an ``id`` column."""
    counted = counts_by_id({"a": train, "b": test, "c": template})
    known = F.col("id").isNotNull()
    a, b, c = F.col("a") > 0, F.col("b") > 0, F.col("c") > 0
    return counted.agg(
        repeated("a").alias("duplicate_train_ids"),
        repeated("b").alias("duplicate_test_ids"),
        how_many(known & a & b).alias("train_test_id_overlap"),
        how_many(known & (b != c)).alias("test_sample_id_symmetric_difference"),
    )


def text_checks(train: DataFrame, column: str = "transcription") -> DataFrame:
    """One row with the five transcript checks.

    Rows are first combined by text, within each task and then across tasks, so the
    repeat count and the four row checks share one shuffle of 32-byte digests.
    """
    raw = F.col(column)
    clean = train.select(column, text.normalise(raw).alias("_n"))

    def rows_where(predicate: Column, name: str) -> Column:
        return F.count_if(predicate).alias(name)

    per_text = clean.groupBy(text_digest(raw).alias("digest")).agg(
        F.count(F.lit(1)).alias("n"),
        rows_where(raw.isNull() | (raw == ""), "empty"),
        rows_where(F.col("_n") == "", "blank"),
        rows_where(text.digit_count(raw) > 0, "digits"),
        rows_where(text.quote_count(raw) > 0, "quotes"),
    )
    return per_text.agg(
        F.coalesce(F.sum("empty"), F.lit(0)).alias("empty_train_transcriptions"),
        F.coalesce(F.sum("blank"), F.lit(0)).alias("normalized_empty_train_transcriptions"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_transcriptions"),
        F.coalesce(F.sum("digits"), F.lit(0)).alias("transcriptions_with_digits"),
        F.coalesce(F.sum("quotes"), F.lit(0)).alias("transcriptions_with_quotes"),
    )


# what a histogram has to hold for the row checks; character lengths are there anyway
CHECK_FEATURES = ("raw_empty", "digit_count", "quote_count")


def row_checks(histogram: DataFrame) -> DataFrame:
    """The transcript checks that concern single rows, from :func:`feature_histogram`."""

    def rows_where(feature: str, predicate: Column, name: str) -> Column:
        chosen = (F.col("feature") == feature) & predicate
        return F.coalesce(F.sum(F.when(chosen, F.col("n"))), F.lit(0)).alias(name)

    value = F.col("value")
    return histogram.agg(
        rows_where("raw_empty", value > 0, "empty_train_transcriptions"),
        rows_where("char_len", value == 0, "normalized_empty_train_transcriptions"),
        rows_where("digit_count", value > 0, "transcriptions_with_digits"),
        rows_where("quote_count", value > 0, "transcriptions_with_quotes"),
    )


def as_flags(row: DataFrame) -> DataFrame:
    """Turn a one-row table of checks into ``check, value, severity`` rows."""
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("check"),
                F.col(name).cast("long").alias("value"),
                F.lit(SEVERITY[name]).alias("severity"),
            )
            for name in row.columns
        ]
    )
    return row.select(F.explode(entries).alias("f")).select("f.*")


def quality_flags(train: DataFrame, test: DataFrame, template: DataFrame) -> DataFrame:
    """The nine integrity checks; ``train`` has ``id, transcription``, the others ``id``."""
    return as_flags(id_checks(train, test, template)).unionByName(as_flags(text_checks(train)))


def overview(
    train: DataFrame, test: DataFrame, template: DataFrame, split: str = "validation"
) -> DataFrame:
    """One row: table sizes, rows of the checked split, and the languages in order."""
    per_language = train.groupBy("language").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("original_split") == split).alias("v")
    )
    sizes = per_language.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("train_rows"),
        F.coalesce(F.sum("v"), F.lit(0)).alias("validation_rows"),
        F.array_join(F.array_sort(F.collect_list("language")), ", ").alias("languages"),
    ).withColumn("part", F.lit(1))
    tests = test.agg(F.count(F.lit(1)).alias("test_rows")).withColumn("part", F.lit(1))
    samples = template.agg(F.count(F.lit(1)).alias("sample_rows")).withColumn("part", F.lit(1))
    return (
        sizes.join(tests, "part")
        .join(samples, "part")
        .select("train_rows", "test_rows", "sample_rows", "validation_rows", "languages")
    )


def null_counts(df: DataFrame) -> DataFrame:
    """``column, nulls``: NULL cells of every column, in one pass."""
    row = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"c{i}") for i, c in enumerate(df.columns)])
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("nulls"))
            for i, c in enumerate(df.columns)
        ]
    )
    return row.select(F.explode(entries).alias("e")).select("e.*")


def distinct_count(df: DataFrame, column: str, *, relative_error: float | None = None) -> DataFrame:
    """Distinct non-null values; approximate only when an error bound is given.

    Texts are told apart by their digests, so that long ones are not shuffled.
    """
    if relative_error is not None:
        return df.agg(F.approx_count_distinct(column, relative_error).alias("distinct_values"))
    value = text_digest(column) if dict(df.dtypes)[column] == "string" else F.col(column)
    return df.agg(F.count_distinct(value).alias("distinct_values"))


def table_profile(df: DataFrame, path: str = "") -> DataFrame:
    """``path, column, roles, value, rows, nulls, distinct_ids``: one row per column.

    ``distinct_ids`` is filled for the id column; ``roles`` lists what the column
    would serve as.  A row of role ``language value`` follows for each value of the
    language column, NULL included, with its number of rows.
    """
    names = df.columns
    chosen = {role: find_role(names, role) for role in ("id", "text", "language", "audio")}
    key = chosen["id"]
    # a column name that differs from another in case only is reached by position
    flat = df.toDF(*[f"c{i}" for i in range(len(names))])
    nulls = [F.count_if(F.col(f"c{i}").isNull()).alias(f"n{i}") for i in range(len(names))]
    row = flat.agg(F.count(F.lit(1)).alias("rows"), *nulls)
    if key is not None:
        ids = flat.select(F.col(f"c{names.index(key)}").alias("k")).where(F.col("k").isNotNull())
        per_id = ids.groupBy("k").agg(F.lit(1).alias("one"))
        unique = per_id.agg(F.count(F.lit(1)).alias("unique")).withColumn("part", F.lit(1))
        row = row.withColumn("part", F.lit(1)).join(unique, "part")
    entries = [
        F.struct(
            F.lit(path).alias("path"),
            F.lit(name).alias("column"),
            F.lit(",".join(r for r, c in chosen.items() if c == name)).alias("roles"),
            F.lit(None).cast("string").alias("value"),
            F.col("rows").alias("rows"),
            F.col(f"n{i}").alias("nulls"),
            (F.col("unique") if name == key else F.lit(None)).cast("long").alias("distinct_ids"),
        )
        for i, name in enumerate(names)
    ]
    columns = row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    per_language = language_profile(df)
    if per_language is None:
        return columns
    return columns.unionByName(
        per_language.select(
            F.lit(path).alias("path"),
            F.lit(chosen["language"]).alias("column"),
            F.lit("language value").alias("roles"),
            F.col("language").cast("string").alias("value"),
            "rows",
            F.lit(None).cast("long").alias("nulls"),
            F.lit(None).cast("long").alias("distinct_ids"),
        )
    )


def language_profile(df: DataFrame) -> DataFrame | None:
    """Rows per language, NULL included; ``None`` for a table without a language."""
    column = find_role(df.columns, "language")
    return None if column is None else value_counts(df, column, "language", keep_null=True)


def submission_inputs(test: DataFrame, template: DataFrame) -> DataFrame:
    """One row: sizes, distinct ids and set difference of test table and template."""
    counted = counts_by_id({"a": test, "b": template})
    known = F.col("id").isNotNull()
    a, b = F.col("a") > 0, F.col("b") > 0
    return counted.agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("test_rows"),
        F.coalesce(F.sum("b"), F.lit(0)).alias("sample_rows"),
        how_many(known & a).alias("test_unique_ids"),
        how_many(known & b).alias("sample_unique_ids"),
        how_many(known & (a != b)).alias("test_sample_symmetric_difference"),
    )


def submission_report(test: DataFrame, template: DataFrame) -> DataFrame:
    """``measure, key, value``: :func:`submission_inputs` and the id prefixes of both tables."""
    sizes = submission_inputs(test, template)
    entries = [
        F.struct(F.lit(c).alias("measure"), F.lit("").alias("key"), F.col(c).cast("long").alias("value"))
        for c in sizes.columns
    ]
    parts = [sizes.select(F.explode(F.array(*entries)).alias("e")).select("e.*")]
    for name, ids in (("test_id_prefix", test), ("sample_id_prefix", template)):
        parts.append(
            prefix_counts(ids).select(
                F.lit(name).alias("measure"), F.col("id_prefix").alias("key"), F.col("rows").alias("value")
            )
        )
    return reduce(DataFrame.unionByName, parts)


def prefix_counts(ids: DataFrame, *, whole_without_underscore: bool = False) -> DataFrame:
    """Rows per id prefix; the two forms differ for ids without an underscore."""
    form = text.id_group if whole_without_underscore else text.id_prefix
    return value_counts(ids, form("id"), "id_prefix")
