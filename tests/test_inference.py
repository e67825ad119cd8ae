"""Quantiles, buckets, intervals, kept state and sketches against plain computations."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scribelake.operators import quantiles, scoring, sketches, slices, vocabulary
from scribelake.plans import profile_state, run_gate


def measures(n, seed=4):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        v = rng.choice([rng.gauss(0, 1), rng.expovariate(0.01), 7.0, None, float("nan")])
        rows.append((rng.choice(["a", "b", None]), v))
    return rows


SHARES = [0.0, 0.013, 0.25, 0.5, 0.9, 0.999, 1.0]


@pytest.mark.parametrize(("n", "k", "most"), [(40, 64, 10), (6000, 64, 1_000_000), (30_000, 64, 300)])
def test_quantiles_are_exact(spark, n, k, most):
    rows = measures(n)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    found = quantiles.exact_quantiles(df, "v", SHARES, ["g"], k=k, most=most).collect()
    assert {r.g for r in found} == {"a", "b", None}
    for r in found:
        own = [v for g, v in rows if g == r.g and v is not None and v == v]
        assert r.n == len(own)
        assert r.quantiles == pytest.approx(np.quantile(own, SHARES).tolist(), rel=1e-12, abs=1e-12)


def test_quantiles_without_groups_and_of_nothing(spark):
    df = spark.createDataFrame([(float(v),) for v in range(11)], "v double")
    assert quantiles.exact_quantiles(df, "v", [0.5, 0.25]).first().quantiles == [5.0, 2.5]
    assert quantiles.exact_quantiles(df.where("v < 0"), "v", [0.5]).count() == 0
    same = spark.range(5000).select(F.lit(3.5).alias("v"))
    assert quantiles.exact_quantiles(same, "v", SHARES, k=64).first().quantiles == [3.5] * 7


def test_quantile_buckets(spark):
    df = spark.createDataFrame([("a", float(k)) for k in range(100)] + [("b", 1.0), ("b", None)], "g string, v double")
    cut = quantiles.with_quantile_bucket(df, "v", "part", by=["g"]).collect()
    for r in cut:
        edges = np.quantile(range(100), [0.25, 0.5, 0.75]) if r.g == "a" else [1.0] * 3
        assert r.part == (None if r.v is None else 1 + sum(r.v > e for e in edges))


def test_levels_agree_with_single_slices(spark):
    rows = [("x", "p", "a b c", "a b d"), ("x", None, "a", "b"), ("y", "q", "hello you", "hello"), (None, "p", "z", "z")]
    pairs = spark.createDataFrame(
        [(str(k), *r) for k, r in enumerate(rows)],
        "id string, language string, kind string, reference_text string, prediction_text string",
    )
    scored = scoring.with_edits(pairs)
    found = slices.metrics_at(scored, (), ("language",), ("language", "kind")).collect()
    by_level = {}
    for r in found:
        by_level.setdefault(r.level, {})[r.language, r.kind] = (r.rows, r.wer, r.cer, r.error)
    whole = scoring.metrics(scored).first()
    assert by_level[""] == {(None, None): (4, whole.wer, whole.cer, whole.error)}
    single = scoring.metrics_by(scored, "language").collect()
    assert by_level["language"] == {(r.language, None): (r.rows, r.wer, r.cer, r.error) for r in single}
    assert set(by_level["language,kind"]) == {("x", "p"), ("y", "q")}


def runs(spark, n=300, slip=0.1, seed=2):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        words = [rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(8)]
        heard = [w if rng.random() > 0.1 else w + "x" for w in words]
        worse = [w if rng.random() > slip else w + "y" for w in heard]
        rows.append((str(k), "xy"[k % 2], " ".join(words), " ".join(heard), " ".join(worse)))
    df = spark.createDataFrame(rows, "id string, language string, reference_text string, one string, two string")
    return [
        scoring.with_edits(df.select("id", "language", "reference_text", F.col(c).alias("prediction_text")))
        for c in ("one", "two")
    ]


def test_bootstrap_intervals(spark):
    first, second = runs(spark)
    found = {(r.slice, r.value): r for r in run_gate.bootstrap_changes(first, second, replicates=200).collect()}
    assert set(found) == {("overall", ""), ("language", "x"), ("language", "y")}
    change = scoring.metrics(second).first().error - scoring.metrics(first).first().error
    whole = found["overall", ""]
    assert whole.rows == 300 and whole.change == pytest.approx(change)
    assert whole.low < whole.change < whole.high and whole.worse
    # twice the rows, narrower: about the square root of two
    part = found["language", "x"]
    assert 1.1 < (part.high - part.low) / (whole.high - whole.low) < 1.9
    again = run_gate.bootstrap_changes(first.repartition(7), second.repartition(3), replicates=200)
    assert {(r.slice, r.value): r for r in again.collect()} == found
    back = run_gate.bootstrap_changes(second, first, replicates=50).collect()
    same = run_gate.bootstrap_changes(first, first, replicates=50).collect()
    assert not any(r.worse for r in back) and all((r.low, r.change, r.high) == (0, 0, 0) for r in same)


def test_draws_are_poisson(spark):
    drawn = spark.range(40_000).select(run_gate._poisson(F.substring(F.md5(F.col("id").cast("string")), 1, 8)).alias("n"))
    counts = {r.n: r["count"] / 40_000 for r in drawn.groupBy("n").count().collect()}
    for n, chance in enumerate((0.3679, 0.3679, 0.1839, 0.0613)):
        assert counts[n] == pytest.approx(chance, abs=0.01)


CORPUS = "id string, transcription string, language string, original_split string"


def corpus_rows(spark, ids):
    words = "muoyo mutu nzela moto na ya ba lelo".split()
    rows = [
        (str(k), " ".join(words[(k * j) % 8] + ("x" if k % 5 == j else "") for j in range(k % 6)),
         "lin" if k % 3 else "sna", "validation" if k % 4 == 0 else "train")
        for k in ids
    ]
    return spark.createDataFrame(rows, CORPUS)


def test_state_of_two_batches_is_that_of_the_whole(spark, tmp_path):
    path = str(tmp_path / "state")
    first, second, whole = (corpus_rows(spark, ids) for ids in (range(60), range(60, 100), range(100)))
    assert profile_state.drift(spark, path).count() == 0
    assert profile_state.add_batch(first, path, "one") and profile_state.add_batch(second, path, "two")
    # a job that is tried again changes nothing
    assert not profile_state.add_batch(second, path, "two")
    assert profile_state.drift(spark, path).collect() == vocabulary.vocabulary_drift(whole).collect()
    wanted = vocabulary.top_tokens(whole, 3).orderBy("language", "rank").collect()
    assert profile_state.top_tokens(spark, path, 3).orderBy("language", "rank").select(*wanted[0].asDict()).collect() == wanted
    from scribelake.operators import profile

    direct = profile.length_quantiles(profile.text_features(whole)).collect()
    assert profile_state.quantiles(spark, path).collect() == direct
    assert {(r.batch, r.rows) for r in profile_state.read_state(spark, path, "batches").collect()} == {("one", 60), ("two", 40)}


def test_a_version_that_was_not_finished_is_not_read(spark, tmp_path):
    path = tmp_path / "state"
    profile_state.add_batch(corpus_rows(spark, range(20)), str(path), "one")
    (path / "version=1" / "tokens").mkdir(parents=True)
    assert profile_state.versions(spark, str(path)) == [0]
    assert profile_state.add_batch(corpus_rows(spark, range(20, 30)), str(path), "two")
    assert profile_state.read_state(spark, str(path), "batches").count() == 2


def test_the_second_batch_reads_none_of_the_first(spark, tmp_path):
    path = str(tmp_path / "state")
    corpus_rows(spark, range(30)).write.parquet(str(tmp_path / "one"))
    profile_state.add_batch(spark.read.parquet(str(tmp_path / "one")), path, "one")
    for file in (tmp_path / "one").iterdir():
        file.unlink()
    assert profile_state.add_batch(corpus_rows(spark, range(30, 50)), path, "two")


@pytest.mark.parametrize("n", [500, 60_000])
def test_sketches(spark, n):
    a = spark.range(n).select(F.concat(F.lit("u"), "id").alias("id"))
    b = spark.range(n // 2, 2 * n).select(F.concat(F.lit("u"), "id").alias("id"))
    parts = [sketches.id_sketch(a.where("id < 'u5'"), "a"), sketches.id_sketch(a.where("id >= 'u5'").union(a.limit(9)), "a"),
             sketches.id_sketch(b.union(spark.createDataFrame([(None,)], "id string")), "b")]
    stored = sketches.add_up(parts[0].union(parts[1]).union(parts[2]))
    found = {(r.measure, r.key): r for r in sketches.compare(stored, {"ab": ("a", "b")}).collect()}
    half = n - n // 2
    exact = {
        ("distinct", "a"): n, ("distinct", "b"): 2 * n - n // 2, ("overlap", "ab"): half, ("union", "ab"): 2 * n,
        ("difference", "ab"): n // 2, ("symmetric_difference", "ab"): n // 2 + n,
    }
    assert set(found) == set(exact)
    for key, size in exact.items():
        assert abs(found[key].estimate - size) <= found[key].bound
        assert found[key].bound == 0 if n == 500 else found[key].bound < 0.05 * 2 * n
