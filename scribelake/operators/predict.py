"""Batch prediction with a pluggable recogniser, and filling a submission template."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scribelake.functions import text
from scribelake.functions.roles import need_role
from scribelake.session import materialise

# A recogniser maps a batch of rows to one text per row.  The factory is called once
# per task, so a model is loaded once and reused for every batch of the task.
Recogniser = Callable[[pd.DataFrame], Sequence[str]]
RecogniserFactory = Callable[[], Recogniser]


# Rows of one value that are put in order together before they are cut into batches.
LANE_ROWS = 50_000


def batched(
    rows: DataFrame, batch_size: int, uniform: str, *, key: str = "id", lane_rows: int = LANE_ROWS
) -> DataFrame:
    """``rows`` with ``lane`` and ``batch``: batches of one value of ``uniform``, NULL being one.

    Which batch a row is in follows from the data alone, whatever the partitioning.  The
    rows of a value are dealt by a hash of their id to as many lanes as make up ``lane_rows``
    each; in a lane they are ordered by id and cut.  Every batch but the last of a lane has
    ``batch_size`` rows, so there are at most as many short ones as lanes: one for each value
    and one more for each further ``lane_rows`` rows of it.  A lane streams through its task.
    """
    sizes = rows.groupBy(F.col(uniform).alias("_value")).agg(F.count(F.lit(1)).alias("_rows"))
    # one row a value, written so that Spark knows how small it is and does not shuffle the rows
    # by a value that a third of them may share
    lanes = materialise(sizes.select("_value", F.ceil(F.col("_rows") / lane_rows).alias("_lanes")), "lanes")
    digits = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long")
    dealt = rows.join(lanes, F.col(uniform).eqNullSafe(F.col("_value")), "left")
    lane = F.coalesce(F.pmod(digits, F.col("_lanes")), F.lit(0))
    laid = dealt.select(*rows.columns, lane.alias("lane"))
    order = Window.partitionBy(uniform, "lane").orderBy(key)
    number = F.floor((F.row_number().over(order) - 1) / batch_size)
    return laid.withColumn("batch", number.cast("long"))


def predict(
    rows: DataFrame,
    factory: RecogniserFactory,
    *,
    batch_size: int = 4,
    uniform: str | None = None,
    key: str = "id",
    lane_rows: int = LANE_ROWS,
    told: bool = False,
) -> DataFrame:
    """``id, prediction``: the recogniser's output for every row, as it came.

    Rows stream through the task and nothing is gathered; a lost executor costs its tasks,
    not the run.  A batch goes on where an Arrow batch ends.  With ``uniform``, the name
    of a column, every batch holds one value of it and is that of :func:`batched`; ``told``
    then adds ``uniform``, ``lane``, ``batch`` and ``batch_rows``.  A row without id is refused.
    """
    added = [] if uniform is None else [uniform, "lane", "batch"]
    if uniform is not None:
        rows = batched(rows, batch_size, uniform, key=key, lane_rows=lane_rows)

    def texts_of(recogniser: Recogniser, batch: pd.DataFrame) -> pd.DataFrame:
        if batch[key].isna().any():
            raise ValueError(f"a row to predict has no {key}")
        output = list(recogniser(batch.drop(columns=["lane", "batch"][: 2 * bool(added)])))
        if len(output) != len(batch):
            raise ValueError(f"{len(output)} texts for a batch of {len(batch)} rows")
        found = pd.DataFrame({"id": batch[key].astype(str).to_numpy(), "prediction": output})
        if told and added:
            for c in added:
                found[c] = batch[c].to_numpy()
            found["batch_rows"] = len(batch)
        return found

    def cut(frame: pd.DataFrame, last: bool) -> tuple[list[pd.DataFrame], pd.DataFrame]:
        """The batches that are complete, and the rows that wait for more."""
        if not added:
            whole = len(frame) if last else len(frame) - len(frame) % batch_size
            return [frame.iloc[k : k + batch_size] for k in range(0, whole, batch_size)], frame.iloc[whole:]
        if frame.empty:
            return [], frame
        marks = frame[added]
        changed = (marks != marks.shift()) & ~(marks.isna() & marks.shift().isna())
        starts = [k for k, new in enumerate(changed.any(axis=1)) if new or k == 0]
        parts = [frame.iloc[a:b] for a, b in zip(starts, [*starts[1:], len(frame)])]
        return (parts, frame.iloc[:0]) if last else (parts[:-1], parts[-1])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recogniser, waiting = factory(), None
        for frame in frames:
            frame = frame if waiting is None else pd.concat([waiting, frame], ignore_index=True)
            batches, waiting = cut(frame, last=False)
            if batches:
                yield pd.concat([texts_of(recogniser, b) for b in batches], ignore_index=True)
        if waiting is not None and len(waiting):
            batches, _ = cut(waiting, last=True)
            yield pd.concat([texts_of(recogniser, b) for b in batches], ignore_index=True)

    schema = T.StructType().add("id", T.StringType()).add("prediction", T.StringType())
    if told and added:
        for c in added:
            schema = schema.add(rows.schema[c])
        schema = schema.add("batch_rows", T.LongType())
    return rows.mapInPandas(run, schema)


def cleaned(predictions: DataFrame) -> DataFrame:
    """``id, prediction`` after the clean-up every stored prediction goes through."""
    return predictions.select("id", text.clean_prediction("prediction").alias("prediction"))


def fill_template(
    template: DataFrame,
    predictions: DataFrame,
    *,
    position: str | Sequence[str] | None = None,
    checked: bool = True,
) -> DataFrame:
    """The template with its first non-id column replaced by the predictions.

    Ids without a prediction get ''; predictions of unknown ids are ignored; column
    order is kept.  ``position`` names the columns to sort by (and drop), for a template
    whose row order matters; ``read_table(..., numbered=True)`` supplies them.  An id of
    the template with several predictions fails the job that fills it: predictions are
    counted by id on their way to the join, so neither they nor the ids are read for it a
    second time.  ``checked=False`` is for predictions already known to be unique.
    """
    id_column = need_role(template.columns, "id")
    places = [position] if isinstance(position, str) else list(position or ())
    targets = [c for c in template.columns if c != id_column and c not in places]
    if not targets:
        raise ValueError("the template has no column to fill")
    answers = predictions.select(
        F.col("id").cast("string").alias("_id"), F.col("prediction").alias("_prediction")
    )
    filled = F.coalesce("_prediction", F.lit(""))
    if checked:
        answers = answers.groupBy("_id").agg(
            F.max("_prediction").alias("_prediction"), F.count(F.lit(1)).alias("_times")
        )
        refused = F.raise_error(F.concat(F.lit("predictions repeat an id of the template: "), "_id"))
        filled = F.when(F.col("_times") > 1, refused).otherwise(filled)
    joined = template.join(answers, F.col(id_column).cast("string") == F.col("_id"), "left")
    if places:
        joined = joined.orderBy(*places)
    return joined.select(
        *[filled.alias(c) if c == targets[0] else F.col(c) for c in template.columns if c not in places]
    )


def bare_submission(predictions: DataFrame) -> DataFrame:
    """Submission without a template."""
    return predictions.select(
        F.col("id").alias("ID"), F.col("prediction").alias("transcription")
    )


def raw_predictions(predictions: DataFrame) -> DataFrame:
    return predictions.select(F.col("id").alias("ID"), "prediction")
