"""Token frequencies, vocabulary drift between splits, frequent tokens, spelling variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribelake.functions import text
from scribelake.operators.selection import top_per_group
from scribelake.session import materialise


def exploded_tokens(corpus: DataFrame, *keys: str, column: str = "transcription") -> DataFrame:
    """One row per token occurrence, with the given key columns."""
    clean = corpus.select(*keys, text.normalise(column).alias("_n"))
    return clean.select(*keys, F.explode(text.tokens("_n")).alias("token"))


def token_counts(corpus: DataFrame, *keys: str, column: str = "transcription") -> DataFrame:
    """``keys, token, count``: occurrences of each token per key.

    Counting starts inside each task, so a frequent token costs one row per task in
    the shuffle, however often it occurs.
    """
    return (
        exploded_tokens(corpus, *keys, column=column)
        .groupBy(*keys, "token")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def vocabulary_sizes(counts: DataFrame, *keys: str) -> DataFrame:
    """Distinct tokens and total occurrences per key, from :func:`token_counts`."""
    return counts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("vocabulary"), F.sum("count").alias("occurrences")
    )


def split_counts(
    corpus: DataFrame,
    *,
    column: str = "transcription",
    language: str = "language",
    split: str = "original_split",
    known: str = "train",
    checked: str = "validation",
) -> DataFrame:
    """Per language and token, occurrences in the known and in the checked split."""
    in_either = corpus.where(F.col(language).isNotNull() & F.col(split).isin(known, checked))
    return (
        exploded_tokens(in_either, language, split, column=column)
        .groupBy(language, "token")
        .agg(
            F.count_if(F.col(split) == known).alias("known_count"),
            F.count_if(F.col(split) == checked).alias("checked_count"),
        )
    )


def unseen_tokens(counts: DataFrame) -> DataFrame:
    """Tokens of the checked split that the known split never shows, per language."""
    return counts.where((F.col("checked_count") > 0) & (F.col("known_count") == 0))


def vocabulary_drift(corpus: DataFrame, **names: str) -> DataFrame:
    """Per language: vocabulary of both splits and the share of unseen tokens."""
    language = names.get("language", "language")
    return drift_from_counts(split_counts(corpus, **names), corpus.select(language), language)


def drift_from_counts(counts: DataFrame, rows: DataFrame, language: str = "language") -> DataFrame:
    """Drift from counts as :func:`split_counts` makes them.

    No token is joined to another: both splits sit side by side in one row per
    token.  ``rows`` only supplies the languages, so that one without any token
    still gets a row of zeros.
    """
    seen, tested = F.col("known_count") > 0, F.col("checked_count") > 0
    tested_count = F.col("checked_count")
    per_language = counts.groupBy(language).agg(
        F.count_if(seen).alias("train_vocab"),
        F.count_if(tested).alias("validation_vocab"),
        F.sum(tested_count).alias("validation_token_count"),
        F.count_if(tested & ~seen).alias("validation_unseen_vocab"),
        F.sum(F.when(~seen, tested_count).otherwise(0)).alias("validation_unseen_token_count"),
    )
    every = rows.where(F.col(language).isNotNull()).select(language).distinct()
    whole = every.join(per_language, language, "left").na.fill(0)
    rate = F.col("validation_unseen_token_count").cast("double") / F.greatest(
        F.col("validation_token_count"), F.lit(1)
    ).cast("double")
    return whole.withColumn("validation_unseen_token_rate", rate).orderBy(language)


def top_tokens(
    corpus: DataFrame, n: int = 50, *, column: str = "transcription", language: str = "language"
) -> DataFrame:
    """The ``n`` most frequent tokens per language; ties go to the smaller token."""
    counts = token_counts(corpus.where(F.col(language).isNotNull()), language, column=column)
    return top_from_counts(counts, n, language)


def top_from_counts(counts: DataFrame, n: int = 50, language: str = "language") -> DataFrame:
    return top_per_group(counts, [language], [F.desc("count"), F.asc("token")], n, spread="token")


def _form_hashes(language: str, token: str = "token"):
    """Hashes of the token and of every form of it with one character left out.

    Only the hashes are kept, eight bytes for each form however long the token is.  The
    empty form of a single letter is left out: it would pair all letters of a language.
    """
    t, n = F.col(token), F.char_length(token)
    cut = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.xxhash64(language, F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, n))),
    )
    whole = F.array(F.xxhash64(language, t))
    return F.array_distinct(F.when(n > 1, F.concat(whole, cut)).otherwise(whole))


def spelling_variants(counts: DataFrame, language: str = "language") -> DataFrame:
    """Pairs (unseen token, known token) one edit apart, within a language.

    Single letters are no variants of each other.  Other words are at most one edit apart only if they share a form with at most one
    character removed.  Joining on such forms finds every pair without comparing all
    words of a block: a form matches only words that extend it by one character.  The
    join is on a hash of language and form; what a collision adds, the distance removes.

    Both sides start from the same counts, which are written to scratch storage first;
    otherwise the corpus would be tokenised once for each.  The join is a sort-merge
    join, because the number of forms is not visible in the size of the counts.
    """
    counts = materialise(counts, "vocabulary")
    forms = counts.select(
        language, "token", "checked_count", "known_count", F.explode(_form_hashes(language)).alias("form")
    )
    new = forms.where((F.col("checked_count") > 0) & (F.col("known_count") == 0)).select(
        "form",
        language,
        F.col("token").alias("unseen"),
        F.col("checked_count").alias("unseen_count"),
    )
    old = forms.where(F.col("known_count") > 0).select(
        "form", F.col(language).alias("_language"), F.col("token").alias("known"), "known_count"
    )
    return (
        new.join(old.hint("merge"), "form")
        .where((F.col(language) == F.col("_language")) & (F.levenshtein("unseen", "known", 1) == 1))
        .select(language, "unseen", "unseen_count", "known", "known_count")
        .distinct()
    )
