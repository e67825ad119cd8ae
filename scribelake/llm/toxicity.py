"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

A sentence scores ``p = sigmoid(b + sum of the weights of its distinct words)``; a document
scores by noisy-or, ``1 - prod(1 - p)`` over its sentences.  A word weighs what it and its
beginnings of ``BEGINNINGS`` letters weigh together, so that inflected forms that were never
seen are known by their stem.  Only labels of documents teach: the weights minimise the log
loss of the documents' scores plus an L1 penalty, which keeps a weight at zero unless it
pulls for more than ``PENALTY`` documents.  The sentences that then score ``AT_FAULT`` or
more are located in the text.

Sentences end at ``. ! ?`` or a line break; words are runs of letters, digits and ``_``,
lower-cased.

The fit learns from at most ``SAMPLE`` toxic and twice as many other labelled documents,
those that a repeatable sample of their ids draws, of each one text (the smallest by hash)
of at most ``LONGEST`` characters; these bounds, parameters, are the only limits, and bound
what reaches the driver.  Every text is scored as a whole.

Defined results: text that is NULL, empty or without a word scores 0.  Labels without id or
value count as none, ids with contradicting labels teach nothing.  Without toxic or without
other examples nothing is known, and every text scores 0.  Repeated rows score alike.
Other columns of the documents pass through; one named like an output, in any case, is
replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
)
from xxhash import xxh64_intdigest

from scribelake.operators.selection import sample_n

SAMPLE = 3_000
LONGEST = 1 << 14
THRESHOLD = 0.5
AT_FAULT = 0.5
PENALTY = 0.5
BEGINNINGS = (3, 4, 5)
_STEPS = 300
_RATE = 1.0
_START = -4.0
_WORDS_HELD = 1 << 20
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORDS = re.compile(r"\w+")

SPANS = ArrayType(
    StructType(
        [
            StructField("begin", IntegerType()),
            StructField("end", IntegerType()),
            StructField("score", DoubleType()),
        ]
    )
)


def word_features(word: str) -> list[str]:
    """The word as a whole, and its beginnings, marked as such."""
    return [f"{word}$", *(word[:n] for n in BEGINNINGS if n <= len(word))]


class _Remembered(dict):
    """What words weigh, remembered for a bounded number of them."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= _WORDS_HELD:
            self.clear()
        found = self[word] = sum(self.weights.get(f, 0.0) for f in word_features(word))
        return found


@dataclass
class Model:
    """Weights by feature; ``None`` for the bias if nothing could be learned."""

    bias: float | None = None
    weights: dict[str, float] = field(default_factory=dict)


def sentence_scores(text: str, bias: float, known: _Remembered) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Spans of the sentences that have words, and the log odds of each."""
    lower = text.lower()
    # where lower-casing changes lengths, places are those of the text as it is
    exact = len(lower) == len(text)
    spans, odds = [], []
    for found in _SENTENCE.finditer(lower if exact else text):
        sentence = found.group() if exact else found.group().lower()
        if words := set(_WORDS.findall(sentence)):
            spans.append(found.span())
            odds.append(sum(map(known.__getitem__, words)))
    return spans, np.array(odds) + bias


def noisy_or(odds: np.ndarray) -> float:
    """``1 - prod(1 - sigmoid(odds))``, without losing small chances."""
    return float(-np.expm1(-np.logaddexp(0, odds).sum()))


def minimise(
    words: Sequence[str],
    bags: list[tuple[np.ndarray, np.ndarray]],
    toxic: np.ndarray,
    penalty: float = PENALTY,
) -> Model:
    """Fit from documents as (numbers of words, ends of sentences); nothing is random.

    Proximal AdaGrad over all documents: steps of their own size for each weight, which
    the L1 penalty then draws towards zero.
    """
    if not toxic.any() or toxic.all():
        return Model()
    # word by feature, as pairs; features by their hash, as most of them get no weight
    of = np.repeat(np.arange(len(words)), [len(word_features(w)) for w in words])
    hashed = (xxh64_intdigest(f) for w in words for f in word_features(w))
    known, feature = np.unique(np.fromiter(hashed, dtype=np.uint64), return_inverse=True)

    word = np.concatenate([b[0] for b in bags])
    lengths = np.concatenate([np.diff(b[1], prepend=0) for b in bags])
    first_word = np.cumsum(lengths) - lengths
    n_sentences = np.array([len(b[1]) for b in bags])
    first_sentence = np.cumsum(n_sentences) - n_sentences
    weights, bias = np.zeros(len(known)), _START
    squares, bias_square = np.full(len(known), 1.0), 1.0
    for _ in range(_STEPS):
        of_words = np.bincount(of, weights[feature], len(words))
        odds = np.add.reduceat(of_words[word], first_word) + bias
        chance = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        hazard = np.add.reduceat(np.logaddexp(0, odds), first_sentence)
        # of the log loss by the hazard: 1 for clean documents, -1 / (e^hazard - 1) for toxic ones
        slope = np.where(toxic, -1 / np.expm1(np.clip(hazard, 1e-9, 500)), 1.0)
        of_sentence = chance * np.repeat(slope, n_sentences)
        pull = np.bincount(word, np.repeat(of_sentence, lengths), len(words))
        pull = np.bincount(feature, pull[of], len(known))
        squares += pull**2
        step = _RATE / np.sqrt(squares)
        weights -= step * pull
        weights = np.sign(weights) * np.maximum(np.abs(weights) - step * penalty, 0)
        bias_square += of_sentence.sum() ** 2
        bias -= _RATE / np.sqrt(bias_square) * of_sentence.sum()
    kept = {int(known[k]): float(weights[k]) for k in np.flatnonzero(weights)}
    spelt = {f: xxh64_intdigest(f) for w in words for f in word_features(w) if xxh64_intdigest(f) in kept}
    return Model(float(bias), {f: kept[spelt[f]] for f in sorted(spelt)})


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, texts, as the words of their sentences and where those end."""
    for batch in batches:
        words, ends = [], []
        for text in batch.column(batch.num_columns - 1):
            of_text, ends_of_text = [], []
            for sentence in _SENTENCE.findall((text.as_py() or "").lower()):
                if distinct := set(_WORDS.findall(sentence)):
                    of_text.extend(sorted(distinct))
                    ends_of_text.append(len(of_text))
            words.append(of_text)
            ends.append(ends_of_text)
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns[:-1],
                pa.array(words, pa.list_(pa.string())),
                pa.array(ends, pa.list_(pa.int32())),
            ],
            names=[*batch.schema.names[:-1], "words", "ends"],
        )


def fit(
    docs: DataFrame,
    labels: DataFrame,
    may_learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample: int = SAMPLE,
    longest: int = LONGEST,
) -> Model:
    """Fit from the labels and texts of the rows for which ``may_learn``, over doc_id, holds."""
    text = F.col(f"`{text_col}`")
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text")).where(
        may_learn & F.col("doc_id").isNotNull() & (F.char_length("text") <= longest)
    )
    marked = (
        labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").alias("label"))
        .where(may_learn & F.col("label").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("most"))
        .where("label = most")
        .join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
        .select("doc_id", (F.col("label") == 1).alias("toxic"))
    )
    toxic = sample_n(marked.where("toxic"), sample, key="doc_id")
    other = sample_n(marked.where("NOT toxic"), 2 * sample, key="doc_id")
    # at most three times ``sample`` ids and flags, whatever the size of the corpus
    wanted = F.broadcast(toxic.unionByName(other))
    rows = texts.join(wanted, "doc_id").select("doc_id", "toxic", F.xxhash64("text").alias("hash"), "text")
    schema = StructType(
        [
            *rows.schema.fields[:-1],
            StructField("words", ArrayType(StringType())),
            StructField("ends", ArrayType(IntegerType())),
        ]
    )
    table = (
        rows.mapInArrow(_bags, schema)
        .where(F.size("ends") > 0)
        .groupBy("doc_id", "toxic")
        .agg(F.min(F.struct("hash", "words", "ends")).alias("bag"))
        .select("doc_id", "toxic", "bag.words", "bag.ends")
        .toArrow()
        # tasks may end in any order; sorting makes reruns agree to the last digit
        .sort_by("doc_id")
    )
    if not len(table):
        return Model()
    columns = table.combine_chunks()
    words, ends = columns.column("words").combine_chunks(), columns.column("ends").combine_chunks()
    spelt = words.flatten().dictionary_encode()
    numbers, firsts = spelt.indices.to_numpy(), words.offsets.to_numpy()
    stops, stops_first = ends.flatten().to_numpy(), ends.offsets.to_numpy()
    bags = [
        (numbers[firsts[k] : firsts[k + 1]], stops[stops_first[k] : stops_first[k + 1]])
        for k in range(len(table))
    ]
    toxic_rows = columns.column("toxic").to_numpy().astype(bool)
    return minimise(spelt.dictionary.to_pylist(), bags, toxic_rows)


def predict(
    docs: DataFrame,
    model: Model,
    text_col: str = "text",
    threshold: float = THRESHOLD,
    at_fault: float = AT_FAULT,
) -> DataFrame:
    """``docs`` with score, predicted (1 from ``threshold`` on) and the offending sentences.

    ``offending`` holds the begin and end, in code points, and the score of each sentence
    that scores ``at_fault`` or more; of a predicted document always that of the highest
    score, the first of them if several tie.
    """
    # plain values, so that workers need no copy of this package
    sent = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))
    place = docs.columns.index(text_col)
    outputs = ("score", "predicted", "offending")
    kept = [k for k, c in enumerate(docs.columns) if c.lower() not in outputs]

    def judged(text: str, known: _Remembered) -> tuple[float, list[dict]]:
        spans, odds = sentence_scores(text, sent.value[0], known)
        if not spans:
            return 0.0, []
        score, chances = noisy_or(odds), 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        found = np.flatnonzero(chances >= at_fault)
        if not len(found) and score >= threshold:
            found = [int(chances.argmax())]
        return score, [
            {"begin": spans[k][0], "end": spans[k][1], "score": float(chances[k])} for k in found
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, weights = sent.value
        known = _Remembered(weights)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(place)]
            if bias is None:
                found = [(0.0, [])] * len(texts)
            else:
                found = [judged(text, known) for text in texts]
            scores = np.array([score for score, _ in found], dtype=np.float64)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k) for k in kept),
                    pa.array(scores),
                    pa.array((scores >= threshold).astype(np.int32)),
                    pa.array([spans for _, spans in found], _SPANS_ARROW),
                ],
                names=[*(batch.schema.names[k] for k in kept), *outputs],
            )

    fields = [docs.schema.fields[k] for k in kept]
    added = [
        StructField("score", DoubleType()),
        StructField("predicted", IntegerType()),
        StructField("offending", SPANS),
    ]
    return docs.mapInArrow(run, StructType([*fields, *added]))


_SPANS_ARROW = pa.list_(
    pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
)
