"""Classifiers and the pipeline, recomputed by plain Python over whole tables."""

import hashlib
import re
from collections import Counter
from zlib import crc32

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from scribelake.llm import bpe, language_id, quality
from scribelake.llm.queries import MIX, OP9_SQL, QUERIES

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def part(doc_id, parts):
    return crc32(str(doc_id).encode()) % parts


def plain_quality(docs, labels, may_learn, sample=quality.SAMPLE):
    """Scores by doc_id; docs: (id, text), labels: {id: quality}."""
    learn = sorted(i for i, _ in docs if may_learn(i))
    known = {i: y for i, y in labels.items() if may_learn(i)}
    prior = sum(known.values()) / len(known)
    rows = {i: quality.properties(text or "") for i, text in docs}

    def drawn(ids, seed):
        return sorted(ids, key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())[:sample]

    pos = drawn([i for i in learn if known.get(i) == 1], 1)
    unl = drawn(learn, 2)
    model = quality.minimise(np.array([rows[i] for i in pos]), np.array([rows[i] for i in unl]), prior)
    return dict(zip(rows, model.scores(np.array(list(rows.values())))))


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_quality_query(spark, scale):
    path = f"/root/testdata/{scale}"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    want = plain_quality(docs, labels, lambda i: part(i, 4) != 2)
    found = QUERIES["op10_quality"](spark, path).collect()
    assert len(found) == len(docs)
    for r in found:
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-6)
        assert r.predicted == int(r.score >= 0.7) and r.held_out == (part(r.doc_id, 4) == 2)


def test_quality_learns_from_its_sample_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(docs, labels, F.lit(True), sample=60)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain_quality(rows, {r.doc_id: r.quality for r in labels.collect()}, lambda i: True, 60)
    for i, text in rows[:200]:
        assert model.scores(quality.properties(text)[None])[0] == pytest.approx(want[i], abs=1e-6)


def test_a_score_at_the_threshold_is_predicted(spark, documents):
    model = quality.Model(prior=0.7)
    found = quality.predict(documents.select("doc_id", "text"), model)
    assert found.where("score = 0.7 AND predicted = 1").count() == documents.count()


def test_names_of_outputs_in_any_case(spark, documents, sf_dir):
    clash = documents.select("doc_id", "text", "lang", *(
        F.lit("x").alias(c) for c in ("Score", "PREDICTED", "Lang_Pred", "IDS", "Decoded")
    ))
    scored = quality.predict(clash, quality.Model(prior=0.5)).select("score", "predicted")
    assert dict(scored.dtypes) == {"score": "double", "predicted": "int"}
    told = language_id.predict(clash, language_id.fit(documents)).select("lang_pred", "score")
    assert dict(told.dtypes) == {"lang_pred": "string", "score": "double"}
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert bpe.round_trip(clash, path).select("ids", "decoded").count() == documents.count()


def test_language_query(spark):
    """Naive Bayes over the n-grams themselves names the languages that the hashed ones name."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()

    def grams(text):
        text = text.lower()
        return Counter(text[k : k + n] for n in (1, 2, 3) for k in range(len(text) - n + 1))

    counts, shares = {}, Counter()
    for r in docs:
        if part(r.doc_id, 5) and r.lang is not None:
            counts.setdefault(r.lang, Counter()).update(grams(r.text or ""))
            shares[r.lang] += 1
    smooth, room = language_id.SMOOTHING, 1 << language_id.BITS
    whole = {name: sum(c.values()) + smooth * room for name, c in counts.items()}
    found = {r.doc_id: r for r in QUERIES["op7_language_id"](spark, SF).collect()}
    assert set(found) == {r.doc_id for r in docs}
    for r in docs:
        assert found[r.doc_id].held_out == (part(r.doc_id, 5) == 0)
        if not any(c.isalpha() for c in r.text or ""):
            assert found[r.doc_id].lang_pred == "und"
            continue
        own = grams(r.text)
        total = {
            name: np.log(shares[name] / sum(shares.values()))
            + sum(n * np.log((c[g] + smooth) / whole[name]) for g, n in own.items())
            for name, c in counts.items()
        }
        best = max(sorted(total), key=total.get)
        assert found[r.doc_id].lang_pred == best
        sure = 1 / sum(np.exp(x - total[best]) for x in total.values())
        assert found[r.doc_id].score == pytest.approx(sure, abs=0.05)


# ------------------------------------------------------------------ the pipeline, stage by stage


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before and after each stage."""
    folder = tmp_path_factory.mktemp("stages")
    docs, found = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        found[name] = (before, docs)
    return found


def ids(frame):
    return Counter(r.doc_id for r in frame.select("doc_id").collect())


def test_stage_quality(spark, stages):
    before, after = stages["quality classifier"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [(r.doc_id, r.text) for r in before.collect()]
    scores = plain_quality(rows, labels, lambda i: part(i, 4) != 2)
    assert ids(after) == Counter(i for i, s in scores.items() if s >= 0.7)


def test_stage_exact_dedup(stages):
    before, after = stages["exact dedup"]
    largest = {}
    for r in before.collect():
        largest[r.text or ""] = max(r.doc_id, largest.get(r.text or "", r.doc_id))
    assert ids(after) == Counter(largest.values()) and len(largest) < before.count()


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_stage_simhash(stages):
    before, after = stages["simhash near-dedup"]
    prints = sorted((r.doc_id, fingerprint(r.text)) for r in before.collect())
    group = {i: i for i, _ in prints}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for k, (i, a) in enumerate(prints):
        for j, b in prints[k + 1 :]:
            if (a ^ b).bit_count() <= 2:
                low, high = sorted((root(i), root(j)))
                group[high] = low
    assert ids(after) == Counter(i for i, _ in prints if root(i) == i)


def test_stage_mixing(stages):
    before, after = stages["mixing"]
    connection = duckdb.connect()
    connection.register("documents", before.toPandas())
    copies = connection.execute(OP9_SQL).df()
    assert MIX["seed"] == "mix"
    assert ids(after) == Counter({i: n for i, n in zip(copies.doc_id, copies.copies) if n})


def test_stage_bpe(stages):
    before, after = stages["bpe"]
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    want = Counter()
    for r in before.collect():
        coded = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(coded, skip_special_tokens=False)
        want[r.doc_id, tuple(coded), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, tuple(r.ids), r.decoded_sha256) for r in after.collect()) == want
