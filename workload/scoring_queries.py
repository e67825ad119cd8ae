"""Queries on joining predictions to references and scoring them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribelake.operators import guards, scoring
from scribelake.operators.ids import missing_summary, pairing_audit
from scribelake.plans import run_gate, validation
from scribelake.session import scratch_path
from scribelake.sources.ledger import append_history, history_rows
from workload import tables as t
from workload.registry import query


def scored_sql(model: str, where: str = "", normalised: bool = True) -> str:
    """Common table expressions up to ``scored``."""
    if normalised:
        r, p = t.norm_sql("transcription"), t.norm_sql("prediction")
    else:
        r, p = "transcription", "prediction"
    return t.with_sql(
        f"utterances {model}",
        "",
        pairs=f"""SELECT u.id, language, original_split, prediction, {r} AS r, {p} AS p
            FROM utterances u JOIN {model} m ON u.id = m.ID {where}""",
        listed=f"SELECT *, {t.words_sql('r')} AS a, {t.words_sql('p')} AS b FROM pairs",
        scored=f"""SELECT *, {t.chars_distance_sql('r', 'p')} AS char_edits, length(r) AS char_total,
            {t.words_distance_sql('a', 'b')} AS word_edits, len(a) AS word_total,
            CASE WHEN len(a) <= 5 THEN '00_05' WHEN len(a) <= 10 THEN '06_10'
                 WHEN len(a) <= 20 THEN '11_20' ELSE '21_plus' END AS length_bucket
            FROM listed""",
    )


RATES = """count(*) AS rows,
    sum(word_edits)::DOUBLE / greatest(sum(word_total), 1)::DOUBLE AS wer,
    sum(char_edits)::DOUBLE / greatest(sum(char_total), 1)::DOUBLE AS cer"""


def metrics_sql(keys: str = "", extra: str = "", source: str = "scored") -> str:
    lead = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    more = f", {extra}" if extra else ""
    return f"""SELECT *, 0.5::DOUBLE * wer + 0.5::DOUBLE * cer AS error,
        1.0::DOUBLE - (0.5::DOUBLE * wer + 0.5::DOUBLE * cer) AS score
        FROM (SELECT {lead}{RATES}{more} FROM {source} {group})"""


def sliced_sql(prefix: str = "scored") -> str:
    parts = [metrics_sql(source=prefix)] + [
        metrics_sql(k, source=prefix) for k in ("language", "length_bucket")
    ]
    heads = ["'overall' AS slice, '' AS value"] + [
        f"'{k}' AS slice, {k} AS value" for k in ("language", "length_bucket")
    ]
    return " UNION ALL ".join(
        f"SELECT {h}, rows, wer, cer, error, score FROM ({p})" for h, p in zip(heads, parts)
    )


def scored_utterances(spark: SparkSession, sf: str, *, normalised: bool = True) -> DataFrame:
    transcripts = t.utterances(spark, sf)
    pairs = scoring.pair(
        transcripts, t.model_a(transcripts), keep=["language", "original_split"]
    )
    return scoring.with_edits(pairs, normalised=normalised)


@query(scored_sql("model_a", "WHERE original_split = 'validation'") + sliced_sql())
def validation_report(spark: SparkSession, sf: str) -> DataFrame:
    transcripts = t.utterances(spark, sf)
    return validation.validation_report(transcripts, t.model_a(transcripts))


@query(scored_sql("model_a") + sliced_sql())
def sliced_metrics_all_rows(spark: SparkSession, sf: str) -> DataFrame:
    scored = scoring.with_length_bucket(scored_utterances(spark, sf))
    return scoring.sliced_metrics(scored, "language", "length_bucket")


@query(scored_sql("model_a") + f"SELECT wer, cer, error, score FROM ({metrics_sql()})")
def score_pairs(spark: SparkSession, sf: str) -> DataFrame:
    transcripts = t.utterances(spark, sf)
    return validation.score_pairs(transcripts, t.model_a(transcripts))


@query(scored_sql("model_a") + f"SELECT wer, cer, error, score FROM ({metrics_sql()})")
def score_pairs_builtin(spark: SparkSession, sf: str) -> DataFrame:
    transcripts = t.utterances(spark, sf)
    return validation.score_pairs(transcripts, t.model_a(transcripts), forms="jvm")


@query(scored_sql("model_a", "WHERE original_split = 'validation'") + sliced_sql())
def validation_report_builtin(spark: SparkSession, sf: str) -> DataFrame:
    transcripts = t.utterances(spark, sf)
    return validation.validation_report(transcripts, t.model_a(transcripts), forms="jvm")


@query(
    scored_sql("model_a", normalised=False)
    + f"SELECT wer, cer, error, score FROM ({metrics_sql()})"
)
def score_pairs_raw(spark: SparkSession, sf: str) -> DataFrame:
    transcripts = t.utterances(spark, sf)
    # capitals and punctuation stay and are counted as wrong
    return validation.score_pairs(transcripts, t.model_a(transcripts), normalised=False)


@query(scored_sql("model_a") + metrics_sql("language"))
def metrics_by_language(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.metrics_by(scored_utterances(spark, sf), "language")


@query(scored_sql("model_a") + metrics_sql("language, original_split"))
def metrics_by_language_and_split(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.metrics_by(scored_utterances(spark, sf), "language", "original_split")


@query(
    scored_sql("model_a")
    + metrics_sql(extra="avg(length(prediction)) AS mean_pred_len")
)
def metrics_with_prediction_length(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.metrics_with_length(scored_utterances(spark, sf))


_ROW_RATES = """word_edits::DOUBLE / greatest(word_total, 1)::DOUBLE AS wer,
    char_edits::DOUBLE / greatest(char_total, 1)::DOUBLE AS cer"""


@query(
    scored_sql("model_a")
    + f"""SELECT id, wer, cer, 0.5::DOUBLE * wer + 0.5::DOUBLE * cer AS error
    FROM (SELECT id, {_ROW_RATES} FROM scored) ORDER BY error DESC, id LIMIT 100"""
)
def worst_rows(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.worst_rows(scored_utterances(spark, sf), 100).select("id", "wer", "cer", "error")


@query(
    scored_sql("model_a")
    + f"""SELECT * FROM (SELECT id, language, error, row_number() OVER (
            PARTITION BY language ORDER BY error DESC, id) AS rank
        FROM (SELECT id, language, 0.5::DOUBLE * wer + 0.5::DOUBLE * cer AS error
              FROM (SELECT id, language, {_ROW_RATES} FROM scored))) WHERE rank <= 25"""
)
def worst_rows_by_language(spark: SparkSession, sf: str) -> DataFrame:
    worst = scoring.worst_rows(scored_utterances(spark, sf), 25, by="language")
    return worst.select("id", "language", "error", "rank")


@query(
    t.with_sql(
        "utterances model_a model_b",
        f"""SELECT id, in_both, word_edits, char_edits, 0.5::DOUBLE * wer + 0.5::DOUBLE * cer AS error
        FROM (SELECT *, {_ROW_RATES} FROM scored) WHERE char_edits > 0 OR NOT in_both""",
        pairs=f"""SELECT coalesce(x.ID, y.ID) AS id, x.ID IS NOT NULL AND y.ID IS NOT NULL AS in_both,
                {t.norm_sql('x.prediction')} AS r, {t.norm_sql('y.prediction')} AS p
            FROM (SELECT * FROM model_a WHERE NOT ends_with(ID, '7')) x
            FULL JOIN (SELECT * FROM model_b WHERE NOT ends_with(ID, '5')) y ON x.ID = y.ID""",
        listed=f"SELECT *, {t.words_sql('r')} AS a, {t.words_sql('p')} AS b FROM pairs",
        scored=f"""SELECT id, in_both, ({t.chars_distance_sql('r', 'p')})::INTEGER AS char_edits,
            length(r) AS char_total, ({t.words_distance_sql('a', 'b')})::INTEGER AS word_edits,
            len(a) AS word_total FROM listed""",
    )
)
def model_disagreements(spark: SparkSession, sf: str) -> DataFrame:
    transcripts = t.utterances(spark, sf)
    first = t.model_a(transcripts).where(~F.endswith("ID", F.lit("7")))
    second = t.model_b(transcripts).where(~F.endswith("ID", F.lit("5")))
    apart = scoring.disagreements(first, second)
    return apart.select("id", "in_both", "word_edits", "char_edits", "error")


_GAP = "SELECT * FROM model_a WHERE prediction NOT LIKE '%qu%' UNION ALL SELECT 'zz_0', 'x'"


def _with_gaps(transcripts: DataFrame) -> DataFrame:
    """Predictions of a recogniser that gives up on every utterance with ``qu``."""
    kept = t.model_a(transcripts).where(~F.contains("prediction", F.lit("qu")))
    extra = transcripts.sparkSession.createDataFrame([("zz_0", "x")], "ID string, prediction string")
    return kept.unionByName(extra)


@query(
    t.with_sql(
        "utterances model_a",
        """SELECT (SELECT count(*) FROM utterances) AS reference_rows,
            (SELECT count(*) FROM gap) AS other_rows,
            (SELECT count(*) FROM utterances WHERE id NOT IN (SELECT ID FROM gap)) AS missing,
            (SELECT count(DISTINCT ID) FROM gap WHERE ID NOT IN (SELECT id FROM utterances)) AS extra,
            0::BIGINT AS repeated_reference, 0::BIGINT AS repeated_other,
            0::BIGINT AS null_reference, 0::BIGINT AS null_other""",
        gap=_GAP,
    )
)
def pairing_audit_with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    transcripts = t.utterances(spark, sf)
    return pairing_audit(transcripts, _with_gaps(transcripts).withColumnRenamed("ID", "id"))


@query(
    t.with_sql(
        "utterances model_a",
        """SELECT (SELECT count(*) FROM absent) AS missing,
            (SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT id FROM absent ORDER BY id LIMIT 5))
            AS examples""",
        gap=_GAP,
        absent="SELECT id FROM utterances WHERE id NOT IN (SELECT ID FROM gap)",
    )
)
def missing_predictions(spark: SparkSession, sf: str) -> DataFrame:
    transcripts = t.utterances(spark, sf)
    summary = missing_summary(transcripts, _with_gaps(transcripts).withColumnRenamed("ID", "id"))
    return summary.select("missing", F.array_join("examples", ",").alias("examples"))


@query(
    t.with_sql(
        "utterances model_a",
        """SELECT u.id, transcription AS reference_text, prediction AS prediction_text
        FROM utterances u JOIN gap ON u.id = gap.ID""",
        gap=_GAP,
    )
)
def scoring_join(spark: SparkSession, sf: str) -> DataFrame:
    """The join itself; with gaps, so the completeness check is left off."""
    transcripts = t.utterances(spark, sf)
    return scoring.pair(transcripts, _with_gaps(transcripts), checked=False)


@query(
    t.with_sql(
        "recordings",
        """SELECT language, count(DISTINCT split) AS distinct_values, count(*) AS rows
        FROM recordings GROUP BY language HAVING count(DISTINCT split) > 1""",
    )
)
def mixed_value_groups(spark: SparkSession, sf: str) -> DataFrame:
    return guards.mixed_groups(t.recordings(spark, sf), ["language"], "split")


_RUNS = {"model_a": "2024-01-01T00:00:00Z", "model_b": "2024-02-01T00:00:00Z"}


def _run_sql() -> str:
    """Error per slice of both runs."""
    bodies = {}
    for model in _RUNS:
        scored = scored_sql(model, "WHERE original_split = 'validation'")
        bodies[model] = f"SELECT * FROM ({scored} {sliced_sql()})"
    history = " UNION ALL ".join(
        f"SELECT '{m}' AS experiment_id, '{_RUNS[m]}' AS created_at_utc, slice, value, error FROM ({b})"
        for m, b in bodies.items()
    )
    return f"""WITH history AS ({history}), lagged AS (
        SELECT *, lag(error) OVER (PARTITION BY slice, value
            ORDER BY created_at_utc, experiment_id) AS previous_error FROM history)
        SELECT *, error - previous_error AS change,
            coalesce(error - previous_error > 0, false) AS worse FROM lagged"""


@query(_run_sql())
def run_regressions(spark: SparkSession, sf: str) -> DataFrame:
    transcripts = t.utterances(spark, sf)
    path = scratch_path(spark, "history")
    for model, moment in _RUNS.items():
        report = validation.validation_report(transcripts, getattr(t, model)(transcripts))
        append_history(history_rows(report, F.lit(model), F.lit(moment)), path)
    return run_gate.regressions(spark.read.parquet(path))
