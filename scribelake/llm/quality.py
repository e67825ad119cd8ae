"""Text quality by positive-unlabelled learning (Kiryo et al., 2017: non-negative risk).

A linear model on 48 plain properties of the whole text is fitted to trusted positives
and unlabelled web text.  With class prior ``p`` it minimises

    p * E_pos[loss(z, 1)] + max(0, E_unl[loss(z, 0)] - p * E_pos[loss(z, 0)])

with the logistic loss; where the second part, an estimate of the negatives' risk, falls
below zero, a step is taken that raises it again.  The prior is estimated from the trusted
labels: the share of positives among all labelled rows that may be learned from.

The fit uses at most ``SAMPLE`` positives and as many unlabelled texts, a repeatable sample
of their ids; this bound, a parameter, is the only sample.  It counts ids: of
an id's rows the one with the smallest hash of its text is learned from, so that repeats
neither weigh more nor reach the driver.  Labels are counted in full and every text is
scored as a whole.

Defined results: NULL text is the empty text, which is scored like any other; without a
positive or an unlabelled example every score is the prior, and without labels 0.5.
Labels without id or value count as none; an id with contradicting labels is no positive.
Other columns of the documents pass through; one named score or predicted, in any case, is
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from scribelake.operators.selection import sample_n

SAMPLE = 20_000
THRESHOLD = 0.7
_STEPS = 600
_RATE = 0.05
_DECAY = 1e-4
_FEW_WORDS = 4
_CLIP = 3.0
# printable ASCII that is neither letter, digit nor space
_MARKS = np.array([c for c in range(0x21, 0x7F) if not chr(c).isalnum()])


def properties(text: str) -> np.ndarray:
    """Rates of characters, words and repetitions in a whole text."""
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8), minlength=256)
    words = text.split()
    lines = [line for line in text.split("\n") if line]
    n, length = max(1, len(words)), max(1, len(text))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    upper = counts[0x41:0x5B].sum()
    letters = max(1, upper + counts[0x61:0x7B].sum())
    marks = counts[_MARKS]
    plain = [
        np.log1p(len(words)),
        upper / letters,
        counts[0x30:0x3A].sum() / length,
        marks.sum() / length,
        (len(text) - lengths.sum()) / length,
        lengths.sum() / n / 10,
        (lengths <= 3).sum() / n,
        (lengths >= 10).sum() / n,
        sum(map(eq, words, words[1:])) / n,
        len(set(words)) / n,
        len(set(words)) / n * np.log1p(len(words)) / 10,
        len(set(lines)) / max(1, len(lines)),
        np.log1p(length / max(1, len(lines))) / 10,
        np.log1p(len(lines)) / 10,
        float((lengths[1:] == lengths[:-1]).sum()) / n,
        counts[0xC0:].sum() / length,
    ]
    # per word, so that a sign on every word counts alike in short and long ones
    return np.concatenate([plain, np.log1p(10 * marks / n)])


N_PROPERTIES = 16 + len(_MARKS)


def _standard(rows: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Centred and scaled; the fewer words a text has, the less its rates say."""
    words = np.expm1(rows[:, :1])
    return np.clip((rows - centre) / scale, -_CLIP, _CLIP) * (words / (words + _FEW_WORDS))


@dataclass
class Model:
    """Weights on centred and scaled properties; without weights only the prior."""

    prior: float
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    bias: float = 0.0

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(rows), self.prior)
        z = _standard(rows, self.centre, self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def minimise(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """Fit by gradient steps over both samples as a whole; nothing is random."""
    if not len(positive) or not len(unlabelled):
        return Model(prior)
    centre, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3
    pos, unl = (_standard(x, centre, scale) for x in (positive, unlabelled))
    pos, unl = (np.hstack([x, np.ones((len(x), 1))]) for x in (pos, unl))
    w = np.zeros(pos.shape[1])
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, _STEPS + 1):
        z_pos, z_unl = pos @ w, unl @ w
        p_pos, p_unl = 1 / (1 + np.exp(-z_pos)), 1 / (1 + np.exp(-z_unl))
        negatives = np.logaddexp(0, z_unl).mean() - prior * np.logaddexp(0, z_pos).mean()
        towards = p_unl @ unl / len(unl) - prior * (p_pos @ pos) / len(pos)
        if negatives >= 0:
            slope = towards - prior * ((1 - p_pos) @ pos) / len(pos)
        else:
            slope = -towards
        slope += _DECAY * w
        mean = 0.9 * mean + 0.1 * slope
        square = 0.999 * square + 0.001 * slope**2
        w -= _RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Model(prior, centre, scale, w[:-1], float(w[-1]))


def _property_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [properties(t.as_py() or "") for t in batch.column(batch.num_columns - 1)]
        flat = pa.array(np.concatenate(rows) if rows else np.empty(0))
        ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * N_PROPERTIES)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.ListArray.from_arrays(ends, flat)],
            names=[*batch.schema.names[:-1], "row"],
        )


def fit(
    docs: DataFrame,
    labels: DataFrame,
    may_learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample: int = SAMPLE,
) -> Model:
    """Fit from the labels and texts of the rows for which ``may_learn``, over doc_id, holds."""
    marked = (
        labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").alias("label"))
        .where(may_learn & F.col("label").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
    )
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    texts = texts.where(may_learn & F.col("doc_id").isNotNull())
    share = marked.agg(F.avg((F.col("label") == 1).cast("double"))).first()[0]
    prior = 0.5 if share is None else float(share)

    # labels of documents that are not in the table teach the prior only
    ids = texts.select("doc_id").distinct()
    learned = marked.where("label = 1").join(ids, "doc_id", "left_semi").select("doc_id")
    positives, unlabelled = (sample_n(x, sample, seed=k, key="doc_id") for k, x in ((1, learned), (2, ids)))
    wanted = positives.withColumn("positive", F.lit(True)).unionByName(
        unlabelled.withColumn("positive", F.lit(False))
    )
    # at most twice ``sample`` ids and flags, whatever the size of the corpus
    rows = texts.join(F.broadcast(wanted), "doc_id").select(
        "doc_id", "positive", F.xxhash64("text").alias("hash"), "text"
    )
    schema = StructType([*rows.schema.fields[:-1], StructField("row", ArrayType(DoubleType()))])
    # one row an id and flag, made one in each task first
    each = rows.mapInArrow(_property_rows, schema).groupBy("doc_id", "positive").agg(
        F.min(F.struct("hash", "row"))["row"].alias("row")
    )
    table = each.select("positive", "row").toArrow()
    flat = table.column("row").combine_chunks()
    matrix = flat.flatten().to_numpy().reshape(-1, N_PROPERTIES) if len(table) else np.empty((0, N_PROPERTIES))
    is_positive = table.column("positive").to_numpy().astype(bool)
    # tasks may end in any order; sorting makes reruns agree to the last digit
    pos, unl = (x[np.lexsort(x.T)] for x in (matrix[is_positive], matrix[~is_positive]))
    return minimise(pos, unl, prior)


def predict(
    docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """``docs`` with score and predicted (1 from ``threshold`` on)."""
    # plain values, so that workers need no copy of this package
    sent = docs.sparkSession.sparkContext.broadcast(
        (model.prior, model.centre, model.scale, model.weights, model.bias)
    )
    place = docs.columns.index(text_col)
    kept = [k for k, c in enumerate(docs.columns) if c.lower() not in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        for batch in batches:
            rows = [properties(t.as_py() or "") for t in batch.column(place)]
            scores = model.scores(np.array(rows).reshape(-1, N_PROPERTIES))
            predicted = pa.array((scores >= threshold).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in kept), pa.array(scores), predicted],
                names=[*(batch.schema.names[k] for k in kept), "score", "predicted"],
            )

    fields = [docs.schema.fields[k] for k in kept]
    added = [StructField("score", DoubleType()), StructField("predicted", IntegerType())]
    return docs.mapInArrow(run, StructType([*fields, *added]))
