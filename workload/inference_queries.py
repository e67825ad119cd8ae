"""Queries on quantiles, measured buckets, uncertainty, kept state and sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribelake.operators import quantiles, scoring, sketches, slices
from scribelake.operators.ids import counts_by_id
from scribelake.plans import profile_state, run_gate
from scribelake.session import materialise, scratch_path
from workload import profile_queries  # noqa: F401  two of its oracles are used here
from workload import tables as t
from workload.registry import ORACLES, query
from workload.scoring_queries import RATES, scored_sql, scored_utterances

SHARES = (0.0, 0.01, 0.25, 0.5, 0.75, 0.95, 1.0)


@query(
    "SELECT event_type, count(value) AS n, "
    + ", ".join(f"round(quantile_cont(value, {p}::DOUBLE), 6) AS q{i}" for i, p in enumerate(SHARES))
    + " FROM events GROUP BY event_type"
)
def value_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Quantiles of a measure with as many values as rows; rounded, as engines interpolate
    with differently ordered arithmetic."""
    found = quantiles.exact_quantiles(t.read(spark, sf, "events"), "value", SHARES, ["event_type"])
    listed = (F.round(F.col("quantiles")[i], 6).alias(f"q{i}") for i in range(len(SHARES)))
    return found.select("event_type", "n", *listed)


LEVELS = ((), ("language",), ("language", "length_part"), ("language", "density_part"), ("length_part", "density_part"))


def _part_sql(value: str) -> tuple[str, str]:
    """The quantile part of a value, and the edges of its language."""
    edges = ", ".join(f"{p}::DOUBLE" for p in (0.25, 0.5, 0.75))
    return (
        f"1 + len(list_filter(e_{value}, lambda e: {value}::DOUBLE > e))",
        f"quantile_cont({value}::DOUBLE, [{edges}]) AS e_{value}",
    )


_LENGTH, _DENSITY = _part_sql("char_total"), _part_sql("density")


@query(
    scored_sql("model_a")[: -1]
    + f""", dense AS (SELECT *, char_total::DOUBLE / greatest(word_total, 1)::DOUBLE AS density FROM scored),
    edges AS (SELECT language AS l, {_LENGTH[1]}, {_DENSITY[1]} FROM dense GROUP BY language),
    cut AS (SELECT *, {_LENGTH[0]} AS length_part, {_DENSITY[0]} AS density_part FROM dense JOIN edges ON l = language)
    SELECT * REPLACE (length_part::INTEGER AS length_part, density_part::INTEGER AS density_part),
        0.5::DOUBLE * wer + 0.5::DOUBLE * cer AS error,
        1.0::DOUBLE - (0.5::DOUBLE * wer + 0.5::DOUBLE * cer) AS score
    FROM (SELECT concat_ws(',', CASE WHEN grouping(language) = 0 THEN 'language' END,
            CASE WHEN grouping(length_part) = 0 THEN 'length_part' END,
            CASE WHEN grouping(density_part) = 0 THEN 'density_part' END) AS level,
            language, length_part, density_part, {RATES}
        FROM cut GROUP BY GROUPING SETS ({', '.join(f"({', '.join(level)})" for level in LEVELS)}))"""
)
def metrics_by_measured_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Error rates by the quartiles of length, and of characters a word, of each language."""
    density = F.col("char_total").cast("double") / F.greatest("word_total", F.lit(1)).cast("double")
    kept = ("language", "char_total", *(c for c in scoring.EDIT_COLUMNS if c != "char_total"))
    scored = materialise(scored_utterances(spark, sf).select(*kept, density.alias("density")), "scored")
    cut = quantiles.with_quantile_bucket(scored, "char_total", "length_part", by=["language"])
    cut = quantiles.with_quantile_bucket(cut, "density", "density_part", by=["language"])
    return slices.metrics_at(cut, *LEVELS)


REPLICATES, SEED = 20, 13

_SUMS = ", ".join(
    f"sum(times * {side}.{c})::DOUBLE AS {side}_{c}" for side in "ab" for c in scoring.EDIT_COLUMNS
)


def _error_sql(side: str) -> str:
    wer, cer = (f"{side}_{k}_edits / greatest({side}_{k}_total, 1)::DOUBLE" for k in ("word", "char"))
    return f"(0.5::DOUBLE * ({wer}) + 0.5::DOUBLE * ({cer}))"


def _bootstrap_sql() -> str:
    runs = {m: f"SELECT * FROM ({scored_sql(m)} SELECT * FROM scored)" for m in ("model_a", "model_b")}
    digits = f"md5('{SEED}:' || id || ':' || (k // 4)::VARCHAR)[1 + 8 * (k % 4) : 8 + 8 * (k % 4)]"
    times = " + ".join(f"(u >= {p!r}::DOUBLE)::INTEGER" for p in run_gate.POISSON)
    per_slice = " UNION ALL ".join(
        f"SELECT '{s}' AS slice, {v} AS value, k, sum(times) AS rows, {_SUMS} FROM drawn d "
        f"JOIN a ON a.id = d.id JOIN b ON b.id = d.id GROUP BY ALL"
        for s, v in (("overall", "''"), ("language", "a.language"))
    )
    return f"""WITH a AS MATERIALIZED ({runs['model_a']}), b AS MATERIALIZED ({runs['model_b']}),
        numbers AS (SELECT id, k, ('0x' || {digits})::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
                    FROM a, range({REPLICATES}) x(k)),
        drawn AS MATERIALIZED (SELECT id, k, {times} AS times FROM numbers UNION ALL SELECT id, -1, 1 FROM a),
        sums AS ({per_slice}),
        changes AS (SELECT *, {_error_sql('b')} - {_error_sql('a')} AS change FROM sums)
        SELECT slice, value, max(rows) FILTER (k < 0)::BIGINT AS rows, round(max(change) FILTER (k < 0), 9) AS change,
            round(quantile_cont(change, 0.025::DOUBLE) FILTER (k >= 0), 9) AS low,
            round(quantile_cont(change, 0.975::DOUBLE) FILTER (k >= 0), 9) AS high,
            quantile_cont(change, 0.025::DOUBLE) FILTER (k >= 0) > 0 AS worse
        FROM changes GROUP BY slice, value"""


@query(_bootstrap_sql())
def error_change_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """The change of the error from one recogniser to the other, with its bootstrap interval."""
    transcripts = t.utterances(spark, sf)
    runs = [
        scoring.with_edits(scoring.pair(transcripts, model(transcripts), keep=["language"]))
        for model in (t.model_a, t.model_b)
    ]
    found = run_gate.bootstrap_changes(*runs, ["language"], replicates=REPLICATES, seed=SEED)
    rounded = (F.round(c, 9).alias(c) for c in ("change", "low", "high"))
    return found.select("slice", "value", "rows", *rounded, "worse")


def _state(spark: SparkSession, sf: str) -> str:
    """The corpus in two batches, the second added by a job that was retried."""
    corpus, path = t.corpus(spark, sf), scratch_path(spark, "state")
    late = F.col("language") == "fr"
    profile_state.add_batch(corpus.where(~late), path, "first")
    for _ in range(2):
        profile_state.add_batch(corpus.where(late), path, "second")
    return path


@query(ORACLES["vocabulary_drift"])
def drift_from_state(spark: SparkSession, sf: str) -> DataFrame:
    return profile_state.drift(spark, _state(spark, sf))


@query(ORACLES["top_tokens"])
def top_tokens_from_state(spark: SparkSession, sf: str) -> DataFrame:
    found = profile_state.top_tokens(spark, _state(spark, sf), 50)
    return found.select("language", "token", "count", "rank")


PAIRS = {"corpus and test": ("corpus", "test"), "corpus and utterances": ("corpus", "utterances")}


@query(
    t.with_sql(
        "corpus test_ids utterances",
        """, sets AS (SELECT 'corpus' AS name, id FROM corpus UNION SELECT 'test', ID FROM test_ids
            UNION SELECT 'utterances', regexp_replace(id, '_[0-9]+$', '') FROM utterances),
        pairs(key, x, y) AS (VALUES ('corpus and test', 'corpus', 'test'), ('corpus and utterances', 'corpus', 'utterances')),
        sides AS (SELECT key, id, bool_or(name = x) AS a, bool_or(name = y) AS b
                  FROM pairs JOIN sets ON name IN (x, y) GROUP BY key, id),
        counted AS (SELECT key, count(*) FILTER (a AND b) AS overlap, count(*) AS "union",
            count(*) FILTER (a AND NOT b) AS difference,
            count(*) FILTER (a <> b) AS symmetric_difference FROM sides GROUP BY key)
        SELECT 'distinct' AS measure, name AS key, count(*) AS exact, true AS within FROM sets GROUP BY name
        UNION ALL SELECT measure, key, exact, true FROM (
            UNPIVOT counted ON overlap, "union", difference, symmetric_difference INTO NAME measure VALUE exact)""",
    )
)
def sketched_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Sketches stored for parts of the tables, added up and compared; whether each estimate
    is within its bound of the exact count."""
    heard = t.utterances(spark, sf).select(F.regexp_replace("id", "_[0-9]+$", "").alias("id"))
    tables = {
        "corpus": t.corpus(spark, sf).select("id"),
        "test": t.test_ids(spark, sf).select(F.col("ID").alias("id")),
        "utterances": heard,
    }
    path = scratch_path(spark, "sketches")
    for name, ids in tables.items():
        for part in ("id < 'en'", "id >= 'en'"):
            sketches.id_sketch(ids.where(part), name).write.mode("append").parquet(path)
    stored = sketches.add_up(spark.read.parquet(path))
    found = sketches.compare(materialise(stored, "sketches"), PAIRS)

    counts = materialise(counts_by_id(tables), "counts")
    parts = [
        counts.agg(F.count_if(F.col(name) > 0).alias("exact")).select(
            F.lit("distinct").alias("measure"), F.lit(name).alias("key"), "exact"
        )
        for name in tables
    ]
    for key, (x, y) in PAIRS.items():
        a, b = F.col(x) > 0, F.col(y) > 0
        each = {"overlap": a & b, "union": a | b, "difference": a & ~b, "symmetric_difference": a != b}
        for measure, holds in each.items():
            parts.append(
                counts.agg(F.count_if(holds).alias("exact")).select(
                    F.lit(measure).alias("measure"), F.lit(key).alias("key"), "exact"
                )
            )
    exact = parts[0]
    for part in parts[1:]:
        exact = exact.unionByName(part)
    within = F.abs(F.col("estimate") - F.col("exact")) <= F.col("bound")
    return exact.join(found, ["measure", "key"]).select("measure", "key", "exact", within.alias("within"))
