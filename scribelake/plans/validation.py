"""Scoring jobs: a pair of tables, and the sliced report on one split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from scribelake.functions.roles import need_columns
from scribelake.operators import guards, scoring
from scribelake.sources.tables import write_table

SLICES = ("language", "length_bucket")


def score_pairs(
    reference: DataFrame, prediction: DataFrame, *, normalised: bool = True, forms: str = "arrow"
) -> DataFrame:
    """One row ``wer, cer, error, score`` for two tables matched by id."""
    scored = scoring.with_edits(
        scoring.pair(reference, prediction), normalised=normalised, forms=forms
    )
    return scoring.metrics(scored).select("wer", "cer", "error", "score")


def scored_split(
    reference: DataFrame,
    prediction: DataFrame,
    *,
    split: str = "validation",
    keep: Sequence[str] = (),
    forms: str = "arrow",
) -> DataFrame:
    """Pairs of one split with edit counts, language and length bucket."""
    need_columns(reference.columns, ["language"], "reference")
    chosen = guards.with_rows(guards.in_split(reference, split), f"reference split {split!r}")
    pairs = scoring.pair(chosen, prediction, keep=["language", *keep])
    return scoring.with_length_bucket(scoring.with_edits(pairs, forms=forms))


def validation_report(
    reference: DataFrame,
    prediction: DataFrame,
    *,
    split: str = "validation",
    slices: Sequence[str] = SLICES,
    forms: str = "arrow",
) -> DataFrame:
    """Metrics overall and per slice: ``slice, value, rows, wer, cer, error, score``.

    Any column of the reference can be a slice.
    """
    extra = [s for s in slices if s not in SLICES]
    scored = scored_split(reference, prediction, split=split, keep=extra, forms=forms)
    return scoring.sliced_metrics(scored, *slices)


def write_validation_report(report: DataFrame, path: str, slices: Sequence[str] = SLICES) -> None:
    """One small table per slice under ``path``; the report is computed once."""
    report = report.persist()
    try:
        for name in ("overall", *slices):
            part = report.where(report["slice"] == name).drop("slice")
            part = part.drop("value") if name == "overall" else part.withColumnRenamed("value", name)
            folder = "overall_metrics" if name == "overall" else f"metrics_by_{name}"
            write_table(part, f"{path}/{folder}", single_file=True)
    finally:
        report.unpersist()
