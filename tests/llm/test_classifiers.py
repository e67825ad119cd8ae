import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scribelake.llm import language_id, ngrams, quality
from scribelake.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_language_on_held_out_documents(spark):
    found = QUERIES["op7_language_id"](spark, SF).join(
        spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id"
    )
    held = found.where("held_out").toPandas()
    assert len(held) > 100 and (held.lang_pred == held.lang).mean() > 0.98
    assert found.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_language_equals_naive_bayes_by_hand(spark):
    train = [("ab abc", "x"), ("bcd", "x"), ("zzz yz", "y"), ("", "y"), (None, "y"), ("abz", None)]
    model = language_id.fit(spark.createDataFrame(train, "text string, lang string"))
    assert model.names == ["x", "y"]

    def grams(text):
        parts = list(ngrams.portions([text.lower()], 3, 1000))
        none = 1 << language_id.BITS
        return [b for p in parts for n in (1, 2, 3) for b in ngrams.buckets(*p, n, language_id.BITS) if b != none]

    counts = {name: Counter(b for t, l in train if l == name for b in grams(t or "")) for name in "xy"}
    texts, shares = ["abz Q", "zz"], {"x": 2 / 5, "y": 3 / 5}
    totals = language_id.scores(model, texts)
    for k, text in enumerate(texts):
        for j, name in enumerate("xy"):
            whole = sum(counts[name].values()) + language_id.SMOOTHING * (1 << language_id.BITS)
            want = math.log(shares[name]) + sum(
                math.log((counts[name][b] + language_id.SMOOTHING) / whole) for b in grams(text)
            )
            assert totals[k, j] == pytest.approx(want, rel=1e-5)


def test_portions_lose_no_ngram():
    text = "abcdefghij" * 30
    for n in (1, 2, 3):
        whole = Counter(b for p in ngrams.portions([text, "xy", text], 3, 10_000) for b in ngrams.buckets(*p, n, 15))
        cut = Counter(b for p in ngrams.portions([text, "xy", text], 3, 7) for b in ngrams.buckets(*p, n, 15))
        whole.pop(1 << 15, 0), cut.pop(1 << 15, 0)
        assert whole == cut and sum(whole.values()) == 2 * (len(text) - n + 1) + max(0, 3 - n)


def test_language_of_odd_rows(odd_documents, no_documents, monkeypatch):
    model = language_id.fit(odd_documents)
    rows = language_id.predict(odd_documents, model).collect()
    assert len(rows) == odd_documents.count()
    for r in rows:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    nothing = language_id.fit(no_documents)
    assert {r.lang_pred for r in language_id.predict(odd_documents, nothing).collect()} == {"und"}
    assert language_id.predict(no_documents, model).count() == 0
    monkeypatch.setattr(language_id, "MAX_MODEL_BYTES", 1 << 18)
    with pytest.raises(ValueError, match="languages"):
        language_id.fit(odd_documents)


def test_quality_on_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = QUERIES["op10_quality"](spark, SF)
    assert found.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = found.where("held_out").join(labels, "doc_id").toPandas()
    assert len(held) > 50 and (held.predicted == held.quality).mean() > 0.97
    assert ((held.score >= 0.7) == (held.predicted == 1)).all()


def test_held_out_labels_do_not_matter(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    turned = labels.withColumn("quality", F.when(learn, F.col("quality")).otherwise(1 - F.col("quality")))
    a, b = (quality.fit(docs, x, learn) for x in (labels, turned.repartition(3)))
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_the_risk_never_falls_far_below_zero():
    rnd = np.random.default_rng(0)
    good, bad = rnd.normal(2, 1, (400, 3)), rnd.normal(-2, 1, (100, 3))
    rows = np.hstack([np.full((500, 1), 5.0), np.vstack([good, bad])])
    model = quality.minimise(rows[:200], rows, 0.8)
    z = np.log(model.scores(rows) / (1 - model.scores(rows)))
    negatives = np.logaddexp(0, z).mean() - 0.8 * np.logaddexp(0, z[:200]).mean()
    assert negatives > -0.05
    assert model.scores(rows[:400]).min() > model.scores(rows[400:]).max() - 0.5
    assert (model.scores(rows[:400]) > 0.5).mean() > 0.95 and (model.scores(rows[400:]) < 0.5).mean() > 0.9


def test_quality_of_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame(
        [(1, 1, "x"), (1, 0, "x"), (2, 1, "x"), (3, 0, "x"), (None, 1, "x"), (4, None, "x"), (99, 1, "x")],
        "doc_id long, quality int, text string",
    )
    model = quality.fit(odd_documents, labels, F.lit(True))
    assert model.prior == pytest.approx(0.5)
    rows = quality.predict(odd_documents, model).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.predict(no_documents, model).count() == 0
    blank = quality.fit(no_documents, labels.limit(0), F.lit(True))
    assert {r.score for r in quality.predict(odd_documents, blank).collect()} == {0.5}


def test_repeated_ids_are_learned_from_once(spark, monkeypatch):
    rows = [(i, f"Good text, number {i}.", 1) if i % 3 else (i, f"bad {i} " * 3, None) for i in range(90)]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    # a positive and an unlabelled id that hold most rows
    often = docs.where("doc_id IN (1, 3)").crossJoin(spark.range(200).select()).unionByName(docs)
    sizes = []
    minimise = quality.minimise
    monkeypatch.setattr(quality, "minimise", lambda p, u, prior: sizes.append((len(p), len(u))) or minimise(p, u, prior))
    a, b = (quality.fit(x, labels, F.lit(True)) for x in (docs, often))
    assert sizes == [(60, 90)] * 2
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias
    # differing texts of an id: one of them, whatever the order of the rows
    versions = docs.unionByName(docs.withColumn("text", F.concat("text", F.lit(" x y"))))
    c, d = (quality.fit(x, labels, F.lit(True), sample=20) for x in (versions, versions.repartition(5, "text")))
    assert sizes[2:] == [(20, 20)] * 2 and np.array_equal(c.weights, d.weights)
