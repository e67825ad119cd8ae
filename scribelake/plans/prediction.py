"""Batch prediction from stored recordings to a submission, and its dry run."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribelake.functions import text
from scribelake.functions.roles import canonical, find_role
from scribelake.operators import predict as P
from scribelake.operators import profile, selection
from scribelake.operators.ids import need_each_once
from scribelake.operators.ordering import first_rows
from scribelake.plans.resumable import predict_resumable
from scribelake.session import materialise
from scribelake.sources.ledger import append_ledger
from scribelake.sources.splits import load_split
from scribelake.sources.tables import POSITION, write_table


@dataclass(frozen=True)
class Run:
    """What the ledger records about a run."""

    name: str
    stage: str = "baseline_submission"
    hypothesis: str = ""
    model: str = ""
    dataset_version: str = ""
    config_path: str = ""
    output_path: str = ""
    notes: str = ""
    extra: dict[str, str] = field(default_factory=dict)


def prediction_rows(
    store: DataFrame,
    split: str = "test",
    languages: Sequence[str] | None = None,
    *,
    wanted: DataFrame | None = None,
    checked: bool = True,
) -> DataFrame:
    """``id, language, audio`` of the rows to predict.

    With a table of wanted ids: only those, each of which must exist exactly once, or
    the number of rows would differ from the number of ids; its language column, if any,
    overrides the stored one.
    """
    rows = load_split(store, split, languages, keep_text=False)
    if wanted is None:
        return rows
    ids = canonical(wanted).distinct()
    if checked:
        need_each_once(ids, rows, f"recording in {split}")
    chosen = selection.only_ids(rows, ids)
    if find_role(wanted.columns, "language"):
        chosen = selection.override_language(chosen, canonical(wanted, language="language"))
    return chosen


def dry_run(test: DataFrame | None, template: DataFrame | None) -> DataFrame | None:
    """``measure, key, value`` of the inputs alone; ``None`` unless both tables are given."""
    if test is None or template is None:
        return None
    return profile.submission_report(canonical(test), canonical(template))


def ledger_record(spark: SparkSession, run: Run, status: str) -> DataFrame:
    """One ledger row, stamped with the current time in UTC."""
    now = F.current_timestamp()
    fields = {
        "stage": run.stage,
        "hypothesis": run.hypothesis,
        "status": status,
        "dataset_version": run.dataset_version,
        "model": run.model,
        "config_path": run.config_path,
        "output_path": run.output_path,
        "submitted": "false",
        "notes": run.notes,
        **run.extra,
    }
    return spark.range(1).select(
        text.run_id(F.lit(run.name), now).alias("experiment_id"),
        text.utc_text(now).alias("created_at_utc"),
        *[F.lit(value).alias(name) for name, value in fields.items()],
    )


def log_dry_run(spark: SparkSession, run: Run, ledger: str) -> None:
    append_ledger(ledger_record(spark, run, "dry_run_validated"), ledger)


def predict_split(
    rows: DataFrame,
    factory: P.RecogniserFactory,
    *,
    batch_size: int = 4,
    max_rows: int | None = None,
    uniform: str | None = None,
) -> DataFrame:
    """``id, prediction`` cleaned for storage; of the first ``max_rows`` ids, if given."""
    if max_rows:
        rows = first_rows(rows, max_rows, "id")
    return P.cleaned(P.predict(rows, factory, batch_size=batch_size, uniform=uniform))


def batch_prediction(
    store: DataFrame,
    factory: P.RecogniserFactory,
    run: Run,
    *,
    output: str,
    split: str = "test",
    languages: Sequence[str] | None = None,
    test: DataFrame | None = None,
    template: DataFrame | None = None,
    position: str | Sequence[str] | None = None,
    raw_output: str | None = None,
    ledger: str | None = None,
    batch_size: int = 4,
    max_rows: int | None = None,
    uniform: str | None = None,
    resume: str | None = None,
) -> DataFrame:
    """Predict, store, fill the template, append to the ledger; returns the predictions.

    The predictions are written before anything else uses them: the model runs once,
    and no later failure loses its output.  ``resume`` names the folder of a job that a
    restart continues (:mod:`scribelake.plans.resumable`): only what is not done there is
    predicted.  A template read with ``numbered=True`` keeps its row order.
    """
    rows = prediction_rows(store, split, languages, wanted=test)
    if position is None and template is not None and set(POSITION) <= set(template.columns):
        position = POSITION
    if resume is None:
        made = predict_split(rows, factory, batch_size=batch_size, max_rows=max_rows, uniform=uniform)
        predictions = materialise(made, "predictions")
    else:
        if max_rows:
            rows = first_rows(rows, max_rows, "id")
        done = predict_resumable(rows, factory, resume, batch_size=batch_size, uniform=uniform)
        # the folder may hold more than this job asks for
        predictions = selection.only_ids(done.select("id", "prediction"), rows.select("id"))
    if raw_output:
        write_table(P.raw_predictions(predictions), raw_output)
    submission = (
        P.bare_submission(predictions)
        if template is None
        else P.fill_template(template, predictions, position=position, checked=test is None)
    )
    write_table(submission, output)
    if ledger:
        append_ledger(ledger_record(store.sparkSession, run, "completed_unsubmitted"), ledger)
    return predictions
