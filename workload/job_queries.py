"""Queries on jobs that break, are retried and go on, and on places in an order."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribelake.operators import ordering, predict, scoring
from scribelake.plans import resumable
from scribelake.session import scratch_path
from scribelake.sources import ledger
from workload import tables as t
from workload.registry import query
from workload.scoring_queries import _ROW_RATES, scored_sql, scored_utterances
from workload.source_queries import read_aloud

_HASH_SQL = "('0x' || md5({0})[1:8])::BIGINT"


def _page_rows(spark: SparkSession, sf: str) -> DataFrame:
    return t.recordings(spark, sf).where("split = 'test'").select("id", "language", "audio")


# ------------------------------------------------------------------ jobs that go on

CHUNKS, PER_WAVE, BEFORE = 16, 4, 2


@query(
    f"""WITH asked AS (
        SELECT {t.PAGE_ID_SQL} AS id, {t.norm_sql('url')} AS prediction,
               regexp_extract(url, '/([a-z][a-z])/', 1) = 'fr' AS late FROM pages),
    dealt AS (SELECT *, {_HASH_SQL.format('id')} % {CHUNKS} AS chunk FROM asked),
    first_run AS (
        SELECT DISTINCT chunk FROM dealt WHERE NOT late ORDER BY chunk LIMIT {PER_WAVE * BEFORE})
    SELECT id, prediction, CASE WHEN late OR chunk NOT IN (SELECT chunk FROM first_run) THEN 1 ELSE 0 END
        ::INTEGER AS run FROM dealt"""
)
def resumed_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """A job that ends after two waves goes on, with rows that came meanwhile; who predicted what."""
    rows, path = _page_rows(spark, sf), scratch_path(spark, "resumable")
    plan = {"chunks": CHUNKS, "per_wave": PER_WAVE, "batch_size": 16}
    resumable.predict_resumable(rows.where("language <> 'fr'"), read_aloud, path, max_waves=BEFORE, **plan)
    done = resumable.predict_resumable(rows, read_aloud, path, **plan)
    return done.select("id", "prediction", "run")


BATCH, LANE = 16, 200


def _rate_and_size():
    """A stand-in recogniser that refuses mixed rates and says what it was given."""

    def recognise(batch: pd.DataFrame) -> Sequence[str]:
        (rate,) = batch["rate"].unique()
        return [f"{rate} {len(batch)}"] * len(batch)

    return recognise


@query(
    f"""WITH asked AS (SELECT {t.PAGE_ID_SQL} AS id, (8000 * (length(html) % 3 + 1))::BIGINT AS rate FROM pages),
    laid AS (
        SELECT *, {_HASH_SQL.format('id')} % ((count(*) OVER (PARTITION BY rate) + {LANE - 1}) // {LANE}) AS lane
        FROM asked),
    cut AS (
        SELECT *, (row_number() OVER (PARTITION BY rate, lane ORDER BY id) - 1) // {BATCH} AS batch FROM laid),
    sized AS (SELECT *, count(*) OVER (PARTITION BY rate, lane, batch) AS batch_rows FROM cut)
    SELECT id, rate || ' ' || batch_rows AS prediction, rate, lane, batch, batch_rows FROM sized"""
)
def uniform_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of three mixed sampling rates in batches of one rate each."""
    pages = t.read(spark, sf, "pages")
    rate = (8000 * (F.char_length("html") % 3 + 1)).cast("long").alias("rate")
    rows = pages.select(t.page_id().alias("id"), rate)
    return predict.predict(
        rows, _rate_and_size, batch_size=BATCH, uniform="rate", lane_rows=LANE, told=True
    )


def _runs(spark: SparkSession, sf: str, stage: str) -> DataFrame:
    documents = t.read(spark, sf, "documents")
    return documents.groupBy(F.concat_ws("/", "source", "lang").alias("experiment_id")).agg(
        F.lit(stage).alias("stage"),
        F.lit(stage).alias("created_at_utc"),
        F.count(F.lit(1)).cast("string").alias("notes"),
        F.max("text").alias("hypothesis"),
    )


@query(
    f"""SELECT source || '/' || lang AS experiment_id,
        CASE WHEN lang = 'fr' THEN '2024-02' ELSE '2024-01' END AS stage, stage AS created_at_utc,
        count(*)::VARCHAR AS notes, max(text) AS hypothesis,
        {', '.join(f"'' AS {c}" for c in ledger.LEDGER_COLUMNS
                   if c not in ('experiment_id', 'stage', 'created_at_utc', 'notes', 'hypothesis'))}
    FROM documents GROUP BY source, lang"""
)
def ledger_of_retried_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs recorded twice, compacted, some recorded again, compacted again: each is there once."""
    path = scratch_path(spark, "ledger")
    first, later = _runs(spark, sf, "2024-01"), _runs(spark, sf, "2024-02")
    for _ in range(2):
        ledger.record_runs(first, path)
    ledger.compact_ledger(spark, path)
    again = F.endswith("experiment_id", F.lit("/fr"))
    ledger.record_runs(first.where(again), path)
    ledger.record_runs(later.where(again), path)
    ledger.compact_ledger(spark, path)
    ledger.record_runs(later.where(again), path)
    return ledger.read_ledger(spark, path)


# ------------------------------------------------------------------ places in an order


@query(
    scored_sql("model_a")
    + f"""SELECT id, wer, cer, error FROM (
        SELECT *, row_number() OVER (ORDER BY error DESC, id) AS place, count(*) OVER () AS n
        FROM (SELECT *, 0.5::DOUBLE * wer + 0.5::DOUBLE * cer AS error
              FROM (SELECT id, {_ROW_RATES} FROM scored))) WHERE place <= n // 2"""
)
def worst_half(spark: SparkSession, sf: str) -> DataFrame:
    """The half of all pairs with the highest errors, of which very many tie."""
    scored = scored_utterances(spark, sf)
    worst = scoring.worst_rows(scored, scored.count() // 2)
    return worst.select("id", "wer", "cer", "error")


@query(
    t.with_sql(
        "corpus",
        """SELECT id, language, place FROM (
            SELECT *, row_number() OVER (ORDER BY language DESC, transcription, id) - 1 AS place,
                count(*) OVER () AS n FROM corpus) WHERE place < n // 3""",
    )
)
def first_third_numbered(spark: SparkSession, sf: str) -> DataFrame:
    """The first third of the corpus in an order of texts, with the places in it."""
    corpus = t.corpus(spark, sf)
    order = (ordering.By("language", descending=True), "transcription", "id")
    first = ordering.first_rows(corpus, corpus.count() // 3, *order)
    return ordering.numbered(first, *order).select("id", "language", "place")
