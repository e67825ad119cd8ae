"""Queries that profile labelled transcripts: counts, quantiles, vocabulary, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribelake.functions.roles import canonical
from scribelake.operators import ids, profile, selection, vocabulary
from scribelake.plans import corpus as corpus_plan
from workload import tables as t
from workload.registry import query

NORM = t.norm_sql("transcription")


@query(
    t.with_sql(
        "corpus",
        """SELECT language, original_split, count(*) AS rows FROM corpus
        WHERE language IS NOT NULL AND original_split IS NOT NULL GROUP BY ALL""",
    )
)
def language_split_counts(spark: SparkSession, sf: str) -> DataFrame:
    return profile.counts_by(t.corpus(spark, sf), "language", "original_split")


@query(t.with_sql("corpus", "SELECT language, count(*) AS rows FROM corpus GROUP BY ALL"))
def language_counts(spark: SparkSession, sf: str) -> DataFrame:
    return profile.value_counts(t.corpus(spark, sf), "language", "language")


@query(
    t.with_sql(
        "flagged", "SELECT language, count(*) AS rows FROM (SELECT CASE WHEN transcription IS NULL "
        "THEN NULL ELSE language END AS language FROM flagged) GROUP BY ALL"
    )
)
def language_profile_with_null(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.flagged(spark, sf).withColumn(
        "language", F.when(F.col("transcription").isNotNull(), F.col("language"))
    )
    return profile.language_profile(rows)


@query(
    t.with_sql(
        "test_ids", "SELECT split_part(ID, '_', 1) AS id_prefix, count(*) AS rows "
        "FROM test_ids GROUP BY ALL"
    )
)
def test_id_prefix_counts(spark: SparkSession, sf: str) -> DataFrame:
    return profile.prefix_counts(canonical(t.test_ids(spark, sf)))


@query(
    t.with_sql(
        "test_ids",
        """SELECT split_part(ID, '_', 1) AS id_prefix, count(*) AS rows FROM (
            SELECT ID FROM test_ids UNION ALL SELECT source FROM documents) GROUP BY ALL""",
    )
)
def id_group_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Ids with and without an underscore; the latter are groups of their own."""
    plain = t.read(spark, sf, "documents").select(F.col("source").alias("ID"))
    both = canonical(t.test_ids(spark, sf).unionByName(plain))
    return profile.prefix_counts(both, whole_without_underscore=True)


@query(
    t.with_sql(
        "corpus",
        """SELECT language, original_split, count(*) AS rows FROM corpus GROUP BY ALL
        ORDER BY language, original_split LIMIT 5""",
    )
)
def shown_rows(spark: SparkSession, sf: str) -> DataFrame:
    counts = profile.counts_by(t.corpus(spark, sf), "language", "original_split")
    return selection.shown(counts, 5)


_FEATURES = rf"""SELECT language, original_split, length(n)::DOUBLE AS char_len,
            len(w)::DOUBLE AS word_len, len(list_distinct(w))::DOUBLE AS unique_word_len,
            len(regexp_extract_all(transcription, '[!-/:-@\[-`{{-~]'))::DOUBLE AS punct_count
            FROM (SELECT *, {t.words_sql('n')} AS w FROM (SELECT *, {NORM} AS n FROM corpus))"""


def _quantiles_sql() -> str:
    parts = []
    for feature in profile.QUANTILE_FEATURES:
        for name, q in profile.QUANTILES.items():
            parts.append(f"round(quantile_cont({feature}, {q}), 6) AS {feature}_{name}")
    return t.with_sql(
        "corpus",
        f"SELECT language, original_split, count(*) AS rows, {', '.join(parts)} FROM f GROUP BY ALL",
        f=_FEATURES,
    )


@query(_quantiles_sql())
def length_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Rounded, since the two engines interpolate with differently ordered arithmetic."""
    wide = profile.length_quantiles(profile.text_features(t.corpus(spark, sf)))
    doubles = [c for c, kind in wide.dtypes if kind == "double"]
    return wide.withColumns({c: F.round(c, 6) for c in doubles})


_TOKENS = f"""SELECT language, original_split, unnest({t.tokens_sql(NORM)}) AS token FROM corpus"""
_COUNTS = """SELECT language, token, count(*) FILTER (original_split = 'train') AS known_count,
    count(*) FILTER (original_split = 'validation') AS checked_count FROM tok GROUP BY ALL"""


@query(
    t.with_sql(
        "corpus",
        "SELECT language, original_split, token, count(*) AS count FROM tok GROUP BY ALL",
        tok=_TOKENS,
    )
)
def token_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary.token_counts(t.corpus(spark, sf), "language", "original_split")


@query(
    t.with_sql(
        "corpus",
        """SELECT language, count(*) AS vocabulary, sum(n)::BIGINT AS occurrences
        FROM (SELECT language, token, count(*) AS n FROM tok GROUP BY ALL) GROUP BY ALL""",
        tok=_TOKENS,
    )
)
def vocabulary_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary.vocabulary_sizes(
        vocabulary.token_counts(t.corpus(spark, sf), "language"), "language"
    )


@query(
    t.with_sql(
        "corpus",
        """SELECT language, count(*) FILTER (known_count > 0) AS train_vocab,
            count(*) FILTER (checked_count > 0) AS validation_vocab,
            sum(checked_count)::BIGINT AS validation_token_count,
            count(*) FILTER (checked_count > 0 AND known_count = 0) AS validation_unseen_vocab,
            coalesce(sum(checked_count) FILTER (known_count = 0), 0)::BIGINT
                AS validation_unseen_token_count,
            coalesce(sum(checked_count) FILTER (known_count = 0), 0)::DOUBLE
                / greatest(sum(checked_count), 1)::DOUBLE AS validation_unseen_token_rate
        FROM counts GROUP BY language""",
        tok=_TOKENS,
        counts=_COUNTS,
    )
)
def vocabulary_drift(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary.vocabulary_drift(t.corpus(spark, sf))


@query(
    t.with_sql(
        "corpus",
        "SELECT * FROM counts WHERE checked_count > 0 AND known_count = 0",
        tok=_TOKENS,
        counts=_COUNTS,
    )
)
def unseen_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary.unseen_tokens(vocabulary.split_counts(t.corpus(spark, sf)))


@query(
    t.with_sql(
        "corpus",
        """SELECT * FROM (SELECT language, token, count(*) AS count, row_number() OVER (
            PARTITION BY language ORDER BY count(*) DESC, token) AS rank
            FROM tok GROUP BY language, token) WHERE rank <= 50""",
        tok=_TOKENS,
    )
)
def top_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary.top_tokens(t.corpus(spark, sf), 50)


@query(
    t.with_sql(
        "corpus",
        """SELECT * FROM (SELECT language, token, count(*) AS count, row_number() OVER (
            PARTITION BY language ORDER BY count(*) DESC, token) AS rank
            FROM tok GROUP BY language, token) WHERE rank <= 2000""",
        tok=_TOKENS,
    )
)
def top_tokens_many(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary.top_tokens(t.corpus(spark, sf), 2000)


@query(
    t.with_sql(
        "corpus",
        f"""SELECT DISTINCT u.language, u.token AS unseen, u.checked_count AS unseen_count,
            k.token AS known, k.known_count
        FROM forms u JOIN forms k ON u.language = k.language AND u.form = k.form
        WHERE u.checked_count > 0 AND u.known_count = 0 AND k.known_count > 0
            AND u.form <> '' AND {t.chars_distance_sql('u.token', 'k.token')} = 1""",
        tok=_TOKENS,
        counts=_COUNTS,
        forms="""SELECT *, token AS form FROM counts UNION ALL
            SELECT *, unnest(list_transform(range(1, length(token) + 1),
                lambda i: token[1:i - 1] || token[i + 1:])) FROM counts""",
    )
)
def spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary.spelling_variants(vocabulary.split_counts(t.corpus(spark, sf)))


@query(
    t.with_sql(
        "flagged",
        """SELECT (count(*) - count(DISTINCT transcription)
            - any_value((SELECT count(*) > 0 FROM flagged WHERE transcription IS NULL))::BIGINT)::BIGINT
            AS repeated FROM flagged""",
    )
)
def repeated_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    return ids.repeat_count(t.flagged(spark, sf), "transcription")


_FLAG_CHECKS = {
    "duplicate_train_ids": "(SELECT count(*) - count(DISTINCT id) FROM flagged)",
    "duplicate_test_ids": "(SELECT count(*) - count(DISTINCT ID) FROM test_ids)",
    "train_test_id_overlap": "(SELECT count(DISTINCT id) FROM flagged "
    "WHERE id IN (SELECT ID FROM test_ids))",
    "test_sample_id_symmetric_difference": "(SELECT count(DISTINCT ID) FROM test_ids "
    "WHERE ID NOT IN (SELECT ID FROM template)) + (SELECT count(DISTINCT ID) FROM template "
    "WHERE ID NOT IN (SELECT ID FROM test_ids))",
    "empty_train_transcriptions": "(SELECT count(*) FROM flagged "
    "WHERE coalesce(transcription, '') = '')",
    "normalized_empty_train_transcriptions": f"(SELECT count(*) FROM flagged WHERE {NORM} = '')",
    "repeated_transcriptions": "(SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM flagged "
    "GROUP BY transcription))",
    "transcriptions_with_digits": r"(SELECT count(*) FROM flagged "
    r"WHERE regexp_matches(transcription, '\d'))",
    "transcriptions_with_quotes": "(SELECT count(*) FROM flagged "
    "WHERE contains(transcription, '\"'))",
}


def _flags_sql() -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS \"check\", ({sql})::BIGINT AS value, '{profile.SEVERITY[name]}' AS severity"
        for name, sql in _FLAG_CHECKS.items()
    )
    return t.with_sql("flagged test_ids template", rows)


@query(_flags_sql())
def quality_flags(spark: SparkSession, sf: str) -> DataFrame:
    return profile.quality_flags(
        t.flagged(spark, sf),
        canonical(t.test_ids(spark, sf)),
        canonical(t.template(spark, sf)),
    )


@query(
    t.with_sql(
        "corpus test_ids template",
        """SELECT (SELECT count(*) FROM corpus) AS train_rows,
            (SELECT count(*) FROM test_ids) AS test_rows,
            (SELECT count(*) FROM template) AS sample_rows,
            (SELECT count(*) FROM corpus WHERE original_split = 'validation') AS validation_rows,
            (SELECT string_agg(language, ', ' ORDER BY language)
             FROM (SELECT DISTINCT language FROM corpus)) AS languages""",
    )
)
def corpus_overview(spark: SparkSession, sf: str) -> DataFrame:
    return profile.overview(t.corpus(spark, sf), t.test_ids(spark, sf), t.template(spark, sf))


@query(
    t.with_sql(
        "flagged",
        """SELECT 'id' AS "column", count(*) FILTER (id IS NULL) AS nulls FROM flagged
        UNION ALL SELECT 'transcription', count(*) FILTER (transcription IS NULL) FROM flagged
        UNION ALL SELECT 'language', count(*) FILTER (language IS NULL) FROM flagged
        UNION ALL SELECT 'original_split', count(*) FILTER (original_split IS NULL) FROM flagged""",
    )
)
def null_cells(spark: SparkSession, sf: str) -> DataFrame:
    return profile.null_counts(t.flagged(spark, sf))


@query(
    t.with_sql("flagged", "SELECT count(DISTINCT transcription) AS distinct_values FROM flagged")
)
def distinct_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    return profile.distinct_count(t.flagged(spark, sf), "transcription")


@query(
    t.with_sql(
        "flagged test_ids",
        """SELECT 'train' AS path, 'id' AS "column", 'id' AS roles, NULL AS value, count(*) AS rows,
            count(*) FILTER (id IS NULL) AS nulls, count(DISTINCT id) AS distinct_ids FROM flagged
        UNION ALL SELECT 'train', 'transcription', 'text', NULL, count(*),
            count(*) FILTER (transcription IS NULL), NULL FROM flagged
        UNION ALL SELECT 'train', 'language', 'language', NULL, count(*), 0, NULL FROM flagged
        UNION ALL SELECT 'train', 'original_split', '', NULL, count(*), 0, NULL FROM flagged
        UNION ALL SELECT 'train', 'language', 'language value', language, count(*), NULL, NULL
            FROM flagged GROUP BY language
        UNION ALL SELECT 'test', 'ID', 'id', NULL, count(*), 0, count(DISTINCT ID) FROM test_ids
        UNION ALL SELECT 'absent', NULL, 'missing', NULL, NULL, NULL, NULL""",
    )
)
def table_profiles(spark: SparkSession, sf: str) -> DataFrame:
    named = {"train": t.flagged(spark, sf), "test": t.test_ids(spark, sf), "absent": None}
    return corpus_plan.table_profiles(spark, named)


@query(
    t.with_sql(
        "test_ids template",
        """SELECT (SELECT count(*) FROM test_ids) AS test_rows,
            (SELECT count(*) FROM template) AS sample_rows,
            (SELECT count(DISTINCT ID) FROM test_ids) AS test_unique_ids,
            (SELECT count(DISTINCT ID) FROM template) AS sample_unique_ids,
            (SELECT count(*) FROM (SELECT ID FROM test_ids EXCEPT SELECT ID FROM template))
            + (SELECT count(*) FROM (SELECT ID FROM template EXCEPT SELECT ID FROM test_ids))
            AS test_sample_symmetric_difference""",
    )
)
def submission_inputs(spark: SparkSession, sf: str) -> DataFrame:
    return profile.submission_inputs(
        canonical(t.test_ids(spark, sf)), canonical(t.template(spark, sf))
    )


@query(
    t.with_sql(
        "test_ids",
        """SELECT DISTINCT ID AS id FROM test_ids WHERE ID IN (SELECT lang || '_' || doc_id FROM documents)""",
    )
)
def id_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return ids.overlap(t.corpus(spark, sf), canonical(t.test_ids(spark, sf)))


@query(
    t.with_sql(
        "test_ids template", "SELECT ID AS id FROM test_ids EXCEPT SELECT ID FROM template"
    )
)
def id_difference(spark: SparkSession, sf: str) -> DataFrame:
    return ids.difference(canonical(t.test_ids(spark, sf)), canonical(t.template(spark, sf)))


@query(
    t.with_sql(
        "test_ids template",
        """SELECT ID AS id, 'left' AS side FROM (SELECT ID FROM test_ids EXCEPT SELECT ID FROM template)
        UNION ALL SELECT ID, 'right' FROM (SELECT ID FROM template EXCEPT SELECT ID FROM test_ids)""",
    )
)
def id_symmetric_difference(spark: SparkSession, sf: str) -> DataFrame:
    return ids.symmetric_difference(
        canonical(t.test_ids(spark, sf)), canonical(t.template(spark, sf))
    )


def _melted_sql(table: str, key: str, source: str, measures: dict[str, str], group: str) -> str:
    """``table, key, measure, value``, one row per key and measure."""
    inner = ", ".join(f"({sql})::DOUBLE AS {name}" for name, sql in measures.items())
    entries = ", ".join(f"struct_pack(measure := '{n}', value := {n})" for n in measures)
    return f"""SELECT '{table}' AS "table", key, e.measure AS measure, e.value AS value FROM (
        SELECT key, unnest([{entries}]) AS e FROM (SELECT {key} AS key, {inner} FROM {source} {group}))"""


def _report_sql() -> str:
    """All columns of all report tables, as (table, key, measure, value) rows."""
    quantiles = {
        f"{feature}_{name}": f"round(quantile_cont({feature}, {q}), 6)"
        for feature in profile.QUANTILE_FEATURES
        for name, q in profile.QUANTILES.items()
    }
    unseen = "coalesce(sum(checked_count) FILTER (known_count = 0), 0)"
    drift = {
        "train_vocab": "count(*) FILTER (known_count > 0)",
        "validation_vocab": "count(*) FILTER (checked_count > 0)",
        "validation_token_count": "sum(checked_count)",
        "validation_unseen_vocab": "count(*) FILTER (checked_count > 0 AND known_count = 0)",
        "validation_unseen_token_count": unseen,
        "validation_unseen_token_rate": f"{unseen}::DOUBLE / greatest(sum(checked_count), 1)::DOUBLE",
    }
    by_split, rows = "language || '/' || original_split", {"rows": "count(*)"}
    top = """(SELECT language, token, count(*) AS n, row_number() OVER (
        PARTITION BY language ORDER BY count(*) DESC, token) AS rank FROM tok GROUP BY language, token)"""
    parts = [
        _melted_sql("language_split_counts", by_split, "corpus", rows, "GROUP BY language, original_split"),
        _melted_sql("language_counts", "language", "corpus", rows, "GROUP BY language"),
        _melted_sql("test_id_prefix_counts", "split_part(ID, '_', 1)", "test_ids", rows, "GROUP BY ALL"),
        _melted_sql(
            "transcript_length_by_language_split", by_split, "features", rows | quantiles,
            "GROUP BY language, original_split",
        ),
        _melted_sql("validation_oov_by_language", "language", "counts", drift, "GROUP BY language"),
        _melted_sql(
            "top_tokens", "language || '/' || token", top, {"count": "n", "rank": "rank"}, "WHERE rank <= 20"
        ),
        _melted_sql("quality_flags", '"check"', "flags", {"value": "value"}, ""),
    ]
    flags = " UNION ALL ".join(
        f"SELECT '{name}' AS \"check\", ({sql.replace('flagged', 'corpus')})::BIGINT AS value"
        for name, sql in _FLAG_CHECKS.items()
    )
    return t.with_sql(
        "corpus test_ids template",
        " UNION ALL ".join(parts),
        tok=_TOKENS,
        counts=_COUNTS,
        features=_FEATURES,
        flags=flags,
    )


@query(_report_sql())
def corpus_report(spark: SparkSession, sf: str) -> DataFrame:
    """All numbers of all report tables, in long form; quantiles rounded."""
    tables = corpus_plan.corpus_profile(
        t.corpus(spark, sf), t.test_ids(spark, sf), t.template(spark, sf), top_n=20
    )
    keys = {
        "language_split_counts": ["language", "original_split"],
        "language_counts": ["language"],
        "test_id_prefix_counts": ["id_prefix"],
        "transcript_length_by_language_split": ["language", "original_split"],
        "validation_oov_by_language": ["language"],
        "top_tokens": ["language", "token"],
        "quality_flags": ["check"],
    }
    parts = []
    for name, key in keys.items():
        table = tables[name]
        numbers = [c for c, kind in table.dtypes if c not in key and kind != "string"]
        rounded = name == "transcript_length_by_language_split"
        entries = F.array(
            *[
                F.struct(
                    F.lit(c).alias("measure"),
                    (F.round(c, 6) if rounded else F.col(c)).cast("double").alias("value"),
                )
                for c in numbers
            ]
        )
        parts.append(
            table.select(
                F.lit(name).alias("table"), F.concat_ws("/", *key).alias("key"), F.explode(entries).alias("e")
            ).select("table", "key", "e.*")
        )
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
