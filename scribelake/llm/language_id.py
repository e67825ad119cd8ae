"""Language identification by multinomial naive Bayes over hashed character n-grams.

Every task counts the n-grams (one to three characters of the lower-cased text, hashed
into ``2**BITS`` buckets) of all its training texts per language; Spark adds the counts.
The matrix of log probabilities, languages times buckets, is broadcast; its size is
checked first.  Scoring gathers the rows of a batch's n-grams, which is a product of a
sparse count matrix with the model, and sums them per text.

Defined results: text that is NULL or has no letter is ``und`` with score 0; so is every
text if there was nothing to learn from.  Equal scores go to the smaller name.  The score
is the posterior probability of the language named.  Training texts without language,
and those without n-grams, teach nothing but, for the latter, the language's share.
Other columns of the input pass through; one named like an output, in any case, is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from scribelake.llm import ngrams

BITS = 15
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
UNKNOWN = "und"
MAX_MODEL_BYTES = 64 << 20
_CHARS = 1 << 19
_LABELS_AT_ONCE = 64
_SOME_LETTER = re.compile("[A-Za-z]")


@dataclass
class Model:
    """Names in order, log shares, and buckets times languages log probabilities."""

    names: list[str]
    shares: np.ndarray
    logs: np.ndarray


def _has_letter(text: str) -> bool:
    return bool(_SOME_LETTER.search(text)) or any(c.isalpha() for c in text)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = 1 << BITS
    held: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for name, counts in held.items():
            # the last place counts texts
            places = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(places), pa.string()), pa.array(places), pa.array(counts[places])],
                names=["name", "bucket", "n"],
            )
        held.clear()

    for batch in batches:
        by_name: dict[str, list[str]] = {}
        for text, name in zip(batch.column(0), batch.column(1)):
            by_name.setdefault(name.as_py(), []).append((text.as_py() or "").lower())
        for name, texts in by_name.items():
            if name not in held:
                if len(held) >= _LABELS_AT_ONCE:
                    yield from flush()
                held[name] = np.zeros(none + 1, dtype=np.int64)
            for portion in ngrams.portions(texts, max(ORDERS), _CHARS):
                for n in ORDERS:
                    found = np.bincount(ngrams.buckets(*portion, n, BITS), minlength=none + 1)
                    held[name][:none] += found[:none]
            held[name][none] += len(texts)
    yield from flush()


def fit(examples: DataFrame, text_col: str = "text", label_col: str = "lang") -> Model:
    """Learn from all ``examples``.  Only the counts, languages times buckets, are collected."""
    spark = examples.sparkSession
    rows = examples.select(
        F.col(f"`{text_col}`").alias("text"), F.col(f"`{label_col}`").cast("string").alias("name")
    ).where("name IS NOT NULL")
    names = rows.select("name").distinct()
    bytes_each = 4 * ((1 << BITS) + 1)
    most = MAX_MODEL_BYTES // bytes_each
    if names.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} languages; their model would exceed {MAX_MODEL_BYTES} bytes")
    counted = rows.mapInArrow(_counts, "name string, bucket long, n long")
    table = counted.groupBy("name", "bucket").agg(F.sum("n").alias("n")).toArrow()
    # names are spelt once; their cells, as many as the model has, stay arrays
    spelt = table.column("name").combine_chunks().dictionary_encode()
    if isinstance(spelt, pa.ChunkedArray):
        spelt = spelt.unify_dictionaries().combine_chunks()
    names = spelt.dictionary.to_pylist()
    known = sorted(names)
    place = np.array([known.index(name) for name in names], dtype=np.int64)
    column = place[spelt.indices.to_numpy()]
    counts = np.zeros(((1 << BITS) + 1, len(known)))
    np.add.at(counts, (table.column("bucket").to_numpy(), column), table.column("n").to_numpy())
    texts, counts = counts[-1], counts[:-1]
    logs = np.log((counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * (1 << BITS)))
    shares = np.log(texts / texts.sum()) if known else texts
    # the extra row is for places where no n-gram ends
    return Model(known, shares, np.vstack([logs, np.zeros((1, len(known)))]).astype(np.float32))


def scores(model: Model, texts: list[str]) -> np.ndarray:
    """Text, language: the joint log probability."""
    totals = np.tile(model.shares, (len(texts), 1))
    chars = max(1 << 14, (_CHARS * 8) // max(8, len(model.names)))
    for codes, owner, context in ngrams.portions([t.lower() for t in texts], max(ORDERS), chars):
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        for n in ORDERS:
            found = model.logs[ngrams.buckets(codes, owner, context, n, BITS)]
            totals[owner[starts]] += np.add.reduceat(found, starts, axis=0, dtype=np.float64)
    return totals


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score."""
    # plain values, so that workers need no copy of this package
    sent = docs.sparkSession.sparkContext.broadcast((model.names, model.shares, model.logs))
    place = docs.columns.index(text_col)
    kept = [k for k, c in enumerate(docs.columns) if c.lower() not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(place)]
            names, chances = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if model.names and texts:
                totals = scores(model, texts)
                best = totals.argmax(axis=1)
                top = totals[np.arange(len(texts)), best]
                sure = 1 / np.exp(totals - top[:, None]).sum(axis=1)
                for k, text in enumerate(texts):
                    if _has_letter(text):
                        names[k], chances[k] = model.names[best[k]], sure[k]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in kept), pa.array(names, pa.string()), pa.array(chances)],
                names=[*(batch.schema.names[k] for k in kept), "lang_pred", "score"],
            )

    fields = [docs.schema.fields[k] for k in kept]
    added = [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    return docs.mapInArrow(run, StructType([*fields, *added]))
