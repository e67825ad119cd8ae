"""Jobs that break and go on, batches of one value, ordered files, and places in an order."""

import random
import sys

import pytest
from pyspark import cloudpickle

from scribelake.operators import ordering, predict
from scribelake.operators.ids import IncompleteError
from scribelake.operators.ordering import By
from scribelake.plans import prediction, resumable
from scribelake.sources import ledger, ordered

# the workers cannot import this file
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def shout():
    return lambda batch: [f"{x} said" for x in batch["id"]]


def counting(path):
    """A recogniser that leaves a file for each id it is given."""

    def factory():
        def recognise(batch):
            for x in batch["id"]:
                with open(f"{path}/{x}", "a") as seen:
                    seen.write("x")
            return [f"{x} said" for x in batch["id"]]

        return recognise

    return factory


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(f"r{k}", 8000 * (k % 3 + 1)) for k in range(200)], "id string, rate int")


def asked_of(path):
    return {p.name: len(p.read_text()) for p in path.iterdir()}


def test_a_restart_predicts_only_the_rest(spark, rows, tmp_path):
    seen, store = tmp_path / "seen", str(tmp_path / "store")
    seen.mkdir()
    plan = {"chunks": 8, "per_wave": 2}
    first = resumable.predict_resumable(rows, counting(seen), store, max_waves=2, **plan)
    done = {r.id for r in first.collect()}
    assert 0 < len(done) < 200 and set(asked_of(seen)) == done
    assert {r.chunk for r in resumable.done_chunks(spark, store).collect()} == {0, 1, 2, 3}
    whole = resumable.predict_resumable(rows, counting(seen), store, **plan).collect()
    assert sorted(r.id for r in whole) == sorted(r.id for r in rows.collect())
    assert all(r.prediction == f"{r.id} said" and r.run == int(r.id not in done) for r in whole)
    assert set(asked_of(seen).values()) == {1}
    # nothing is left
    resumable.predict_resumable(rows, counting(seen), store, **plan)
    assert set(asked_of(seen).values()) == {1}
    assert sum(r.rows for r in resumable.done_chunks(spark, store).collect()) == 200


def test_a_wave_that_breaks_counts_for_nothing(spark, rows, tmp_path):
    store = str(tmp_path / "store")
    bad = sorted(
        r.id for r in rows.withColumn("c", resumable.chunk_of("id", 8)).where("c = 5").collect()
    )[0]

    def breaks():
        def recognise(batch):
            if bad in set(batch["id"]):
                raise RuntimeError("out of memory")
            return ["ok"] * len(batch)

        return recognise

    plan = {"chunks": 8, "per_wave": 2}
    with pytest.raises(Exception, match="out of memory"):
        resumable.predict_resumable(rows, breaks, store, **plan)
    assert {r.chunk for r in resumable.done_chunks(spark, store).collect()} == {0, 1, 2, 3}
    # files that a broken commit left behind are replaced, not read
    stray = spark.createDataFrame([("stray", "x", 5, 0)], resumable.PREDICTIONS)
    resumable._write_wave(stray, store)
    assert "stray" not in {r.id for r in resumable.stored_predictions(spark, store).collect()}
    whole = resumable.predict_resumable(rows, shout, store, **plan).collect()
    assert sorted(r.id for r in whole) == sorted(r.id for r in rows.collect())


def test_rows_added_to_done_chunks(spark, rows, tmp_path):
    seen, store = tmp_path / "seen", str(tmp_path / "store")
    seen.mkdir()
    resumable.predict_resumable(rows.where("rate > 8000"), counting(seen), store, chunks=4)
    whole = resumable.predict_resumable(rows, counting(seen), store, chunks=4)
    assert sorted(r.id for r in whole.collect()) == sorted(r.id for r in rows.collect())
    assert set(asked_of(seen).values()) == {1} and whole.where("take = 1").count() == 67


def test_what_a_resumable_job_refuses(spark, rows, tmp_path):
    store = str(tmp_path / "store")
    with pytest.raises(IncompleteError, match="again"):
        resumable.predict_resumable(rows.unionByName(rows.limit(1)), shout, store)
    with pytest.raises(IncompleteError, match="without"):
        resumable.predict_resumable(spark.createDataFrame([(None,)], "id string"), shout, store)
    assert resumable.predict_resumable(rows.limit(0), shout, store).count() == 0
    resumable.predict_resumable(rows.limit(5), shout, store, chunks=4)
    with pytest.raises(ValueError, match="4 chunks"):
        resumable.predict_resumable(rows, shout, store, chunks=5)


def test_whole_job_with_a_folder_to_resume_from(spark, tmp_path):
    store = spark.createDataFrame(
        [(str(k), "x", ("p", None), None, "test") for k in range(30)],
        "id string, language string, audio struct<path string, bytes binary>, transcription string, split string",
    )
    folder, job = str(tmp_path / "resume"), prediction.Run("job")
    some = spark.createDataFrame([("3",), ("4",)], "ID string")
    first = prediction.batch_prediction(
        store, shout, job, output=str(tmp_path / "a"), languages=["x"], test=some, resume=folder
    )
    assert {r.id for r in first.collect()} == {"3", "4"}
    seen = tmp_path / "seen"
    seen.mkdir()
    whole = prediction.batch_prediction(
        store, counting(seen), job, output=str(tmp_path / "b"), languages=["x"], resume=folder
    )
    assert whole.count() == 30 and set(asked_of(seen)) == {str(k) for k in range(30)} - {"3", "4"}


@pytest.mark.parametrize("partitions", [1, 7])
def test_batches_of_one_value_whatever_the_partitioning(spark, rows, partitions):
    def one_rate():
        def recognise(batch):
            assert batch["rate"].nunique() == 1 and list(batch.columns) == ["id", "rate"]
            return list(batch["id"])

        return recognise

    made = predict.predict(
        rows.repartition(partitions), one_rate, batch_size=7, uniform="rate", lane_rows=30, told=True
    ).collect()
    assert sorted(r.id for r in made) == sorted(r.id for r in rows.collect())
    batches = {}
    for r in made:
        batches.setdefault((r.rate, r.lane, r.batch), []).append(r)
    assert all(len(b) == b[0].batch_rows <= 7 for b in batches.values())
    lanes = {key[:2] for key in batches}
    assert sum(len(b) < 7 for b in batches.values()) <= len(lanes) == 9
    expected = predict.batched(rows, 7, "rate", lane_rows=30).collect()
    assert {r.id: (r.rate, r.lane, r.batch) for r in expected} == {r.id: (r.rate, r.lane, r.batch) for r in made}


def test_batches_go_on_where_an_arrow_batch_ends(spark, rows):
    def sizes():
        return lambda batch: [str(len(batch))] * len(batch)

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        plain = predict.predict(rows.coalesce(1), sizes, batch_size=16).collect()
        assert sorted(r.prediction for r in plain) == ["16"] * 192 + ["8"] * 8
        odd = rows.withColumn("rate", rows["rate"].cast("string")).replace("8000", None, "rate")
        made = predict.predict(odd, sizes, batch_size=16, uniform="rate", told=True).collect()
        assert {r.rate for r in made} == {None, "16000", "24000"}
        assert sorted({(r.rate or "", r.batch_rows) for r in made}) == [
            (rate, n) for rate, rest in (("", 3), ("16000", 3), ("24000", 2)) for n in (rest, 16)
        ]
        assert all(r.prediction == str(r.batch_rows) for r in made)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def record(spark, *runs):
    columns = "experiment_id string, created_at_utc string, notes string"
    return spark.createDataFrame(list(runs), columns)


def noted(spark, path):
    return {r.experiment_id: r.notes for r in ledger.read_ledger(spark, path).collect()}


def test_a_run_recorded_twice_is_there_once(spark, tmp_path):
    path = str(tmp_path / "book")
    assert noted(spark, path) == {}
    for _ in range(2):
        ledger.record_runs(record(spark, ("a/1", "t1", "x"), ("b", "t1", "y")), path)
    assert noted(spark, path) == {"a/1": "x", "b": "y"}
    assert ledger.read_ledger(spark, path).columns == list(ledger.LEDGER_COLUMNS)
    ledger.compact_ledger(spark, path)
    assert noted(spark, path) == {"a/1": "x", "b": "y"}
    # recorded later counts, even with an earlier time
    ledger.record_runs(record(spark, ("b", "t0", "z"), ("c", "t1", "w"), ("c", "t2", "v")), path)
    assert noted(spark, path) == {"a/1": "x", "b": "z", "c": "v"}
    for _ in range(2):
        ledger.compact_ledger(spark, path)
        assert noted(spark, path) == {"a/1": "x", "b": "z", "c": "v"}
    with pytest.raises(ValueError, match="without experiment_id"):
        ledger.record_runs(record(spark, (None, "t", "x")), path)


def test_a_compaction_that_breaks_loses_and_doubles_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "book")
    ledger.record_runs(record(spark, ("a", "t1", "x"), ("b", "t1", "y")), path)

    def breaks(*_):
        raise OSError("gone")

    with monkeypatch.context() as patch:
        patch.setattr(ledger, "delete_path", breaks)
        with pytest.raises(OSError):
            ledger.compact_ledger(spark, path)
    assert noted(spark, path) == {"a": "x", "b": "y"} and ledger.read_ledger(spark, path).count() == 2
    # an unfinished version does not count
    (tmp_path / "book" / "whole" / "version=7").mkdir()
    ledger.record_runs(record(spark, ("a", "t2", "new")), path)
    ledger.compact_ledger(spark, path)
    assert noted(spark, path) == {"a": "new", "b": "y"}


def values(seed=3, n=400):
    rng = random.Random(seed)
    return [(rng.choice([None, 0.0, 0.5, 1.0, rng.random()]), rng.choice("abc"), k) for k in range(n)]


def python_order(row):
    error, name, k = row
    return (error is None, -(error or 0), name, k)


@pytest.mark.parametrize("n", [0, 1, 37, 200, 399, 400, 1000])
def test_first_rows_of_any_number(spark, n):
    data = values()
    df = spark.createDataFrame(data, "error double, name string, k int").repartition(6)
    first = ordering.first_rows(df, n, By("error", descending=True), "name", "k")
    assert sorted(map(tuple, first.collect()), key=python_order) == sorted(data, key=python_order)[:n]


def test_first_rows_among_rows_that_are_alike(spark):
    df = spark.createDataFrame([(1.0, k) for k in range(300)] + [(0.5, k) for k in range(20)], "error double, k int")
    first = ordering.first_rows(df.repartition(5), 170, By("error", descending=True)).collect()
    assert len(first) == 170 and {r.error for r in first} == {1.0} and len({r.k for r in first}) == 170


def test_numbers_follow_the_order(spark):
    data = values()
    df = spark.createDataFrame(data, "error double, name string, k int").repartition(6)
    order = (By("error", descending=True), "name", "k")
    found = {r.place: (r.error, r.name, r.k) for r in ordering.numbered(df, *order).collect()}
    assert [found[k] for k in range(len(data))] == sorted(data, key=python_order)


def test_ordered_files(spark, tmp_path):
    data = [(k, f'text "{k}"\nand \\ more', f"t{k % 9}") for k in range(500)]
    df = spark.createDataFrame(data, "k int, text string, name string").repartition(4)
    path = str(tmp_path / "out")
    ordered.write_ordered(df, path, By("name", descending=True), "k", drop=["k"], files=6)
    assert len(list((tmp_path / "out").glob("part-*"))) > 3
    index = spark.read.parquet(f"{path}/{ordered.INDEX}").orderBy("file").collect()
    assert sum(r.rows for r in index) == 500
    assert [r.first_place for r in index] == [sum(r.rows for r in index[:k]) for k in range(len(index))]
    wanted = [(t, n) for k, t, n in sorted(data, key=lambda r: (r[2], -r[0]), reverse=True)]
    found = ordered.read_ordered(spark, path).orderBy("place").collect()
    assert [r.place for r in found] == list(range(500))
    assert [(r.text, r.name) for r in found] == wanted
