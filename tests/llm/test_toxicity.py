"""Toxicity: the fit against plain gradients, located sentences, held-out labels, odd rows."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scribelake.llm import toxicity
from scribelake.llm.queries import bucket, op11_toxic_sentences

CLEAN = ["the day is long", "we go home", "rain fell again", "it was a good week"]


def examples(n, rude="grobian"):
    """Documents of several sentences; in every other one, one sentence has a rude word."""
    rows = []
    for k in range(n):
        sentences = [CLEAN[(k * 7 + j * 3) % 4] for j in range(1 + k % 5)]
        if k % 2:
            sentences[k % len(sentences)] += f" {rude}{'abcdefg'[k % 7]}x"
        rows.append((k, ". ".join(sentences) + ".", k % 2))
    return rows


def frames(spark, rows):
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    return docs, labels


def plain_score(text, model):
    """The score of a text, spelled out."""
    clean = 1.0
    for sentence in re.split(r"[.!?\n]", text.lower()):
        words = set(re.findall(r"\w+", sentence))
        if words:
            z = model.bias + sum(
                model.weights.get(f, 0.0)
                for w in words
                for f in [w + "$", *(w[:n] for n in (3, 4, 5) if len(w) >= n)]
            )
            clean *= 1 - 1 / (1 + math.exp(-z))
    return 1 - clean


def test_scores_are_those_of_the_definition(spark, documents, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(documents, labels, F.lit(True))
    found = toxicity.predict(documents.select("doc_id", "text"), model).collect()
    assert len(found) == documents.count()
    for row in found:
        assert row.score == pytest.approx(plain_score(row.text, model), abs=1e-9)
        assert row.predicted == int(row.score >= 0.5)


def test_the_fit_is_a_minimum(spark):
    """No small change of a weight or the bias lowers the penalised loss by much."""
    rows = examples(80)
    model = toxicity.fit(*frames(spark, rows), F.lit(True))

    def loss(bias, weights):
        changed = toxicity.Model(bias, weights)
        total = toxicity.PENALTY * sum(map(abs, weights.values()))
        for _, text, label in rows:
            p = min(max(plain_score(text, changed), 1e-12), 1 - 1e-12)
            total -= math.log(p if label else 1 - p)
        return total

    best = loss(model.bias, model.weights)
    features = [*model.weights, "day$", "grob"]
    for f in features:
        for by in (-0.3, 0.3):
            assert loss(model.bias, model.weights | {f: model.weights.get(f, 0.0) + by}) > best - 0.05
    assert min(loss(model.bias - 0.3, model.weights), loss(model.bias + 0.3, model.weights)) > best - 0.05


def test_offending_sentences_are_located(spark):
    rows = examples(120)
    docs, labels = frames(spark, rows)
    model = toxicity.fit(docs, labels, F.col("doc_id") < 80)
    for row in toxicity.predict(docs, model).where("doc_id >= 80").collect():
        assert row.predicted == row.doc_id % 2
        located = [row.text[s.begin : s.end] for s in row.offending]
        assert all("grobian" in s for s in located) and len(located) == row.doc_id % 2


def test_one_bad_sentence_in_a_long_text_is_found(spark):
    docs, labels = frames(spark, examples(100))
    model = toxicity.fit(docs, labels, F.lit(True))
    long_text = ". ".join(CLEAN * 500)
    asked = spark.createDataFrame(
        [(1, long_text), (2, f"{long_text}. you Grobianbx! {long_text}")], "doc_id long, text string"
    )
    found = {r.doc_id: r for r in toxicity.predict(asked, model).collect()}
    assert found[2].predicted == 1
    assert [found[2].text[s.begin : s.end].strip() for s in found[2].offending if s.score > 0.5] == ["you Grobianbx"]


def test_held_out_documents(spark):
    found = op11_toxic_sentences(spark, "/root/testdata/sf0.01")
    assert found.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = found.join(labels, "doc_id").toPandas()
    assert (judged["held_out"] == judged["doc_id"].map(lambda i: bucket_of(i) == 0)).all()
    held = judged[judged["held_out"]]
    # labels that nothing in the text explains occur, so recall is not complete
    assert held.loc[held["toxic"] == 0, "predicted"].mean() <= 0.05
    assert held.loc[held["toxic"] == 1, "predicted"].mean() >= 0.6


def bucket_of(doc_id):
    from zlib import crc32

    return crc32(str(doc_id).encode()) % 5


def test_only_permitted_labels_teach(spark):
    docs, labels = frames(spark, examples(60))
    turned = labels.withColumn("toxic", F.when(F.col("doc_id") < 30, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    allowed = F.col("doc_id") >= 30
    assert toxicity.fit(docs, labels, allowed) == toxicity.fit(docs, turned, allowed)


def test_odd_rows(spark, odd_documents):
    labels = spark.createDataFrame(
        [(1, 1), (1, 0), (2, 1), (3, 0), (4, 0), (5, 0), (7, 1), (None, 1), (8, None), (99, 1)],
        "doc_id long, toxic int",
    )
    model = toxicity.fit(odd_documents, labels, F.lit(True))
    found = toxicity.predict(odd_documents, model)
    assert found.columns == [c for c in odd_documents.columns if c != "score"] + ["score", "predicted", "offending"]
    rows = found.collect()
    assert len(rows) == odd_documents.count()
    for row in rows:
        assert 0 <= row.score <= 1
        if not row.text:
            assert row.score == 0 and row.offending == []
    assert len({r.score for r in rows if r.text == "a b c"}) == 1


def test_columns_named_like_outputs_in_any_case(spark):
    docs, labels = frames(spark, examples(20))
    model = toxicity.fit(docs, labels, F.lit(True))
    clashing = docs.withColumn("Score", F.lit("x")).withColumn("OFFENDING", F.lit(1))
    assert toxicity.predict(clashing, model).select("score").dtypes == [("score", "double")]


def test_nothing_to_learn_from(spark, documents, no_documents, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(documents, labels, F.lit(False))
    assert toxicity.predict(documents, model).agg(F.max("score")).first()[0] == 0
    assert toxicity.fit(no_documents, labels, F.lit(True)) == toxicity.Model()
    only_clean = labels.where("toxic = 0")
    assert toxicity.fit(documents, only_clean, F.lit(True)) == toxicity.Model()
    assert toxicity.predict(no_documents, model).count() == 0


def test_the_sample_bounds_what_is_learned_from(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(
        toxicity, "minimise", lambda words, bags, toxic: seen.append((len(bags), int(toxic.sum())))
    )
    docs, labels = frames(spark, examples(100))
    docs = docs.unionByName(docs).unionByName(docs)
    toxicity.fit(docs, labels, F.lit(True), sample=10)
    assert seen == [(30, 10)]


def test_noisy_or():
    odds = np.array([-2.0, 0.0, 3.0])
    p = 1 / (1 + np.exp(-odds))
    assert toxicity.noisy_or(odds) == pytest.approx(1 - np.prod(1 - p))
