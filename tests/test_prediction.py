import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from scribelake.operators import predict
from scribelake.operators.ids import IncompleteError
from scribelake.plans import prediction
from scribelake.sources import tables
from scribelake.sources.ledger import LEDGER_COLUMNS

# the workers cannot import this file
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def shout():
    def run(batch):
        assert len(batch) <= 4
        return [record["path"].upper() + "!" for record in batch["audio"]]

    return run


def short():
    return lambda batch: ["x"] * (len(batch) - 1)


@pytest.fixture(scope="module")
def store(spark):
    return spark.range(50).selectExpr(
        "cast(id as string) as id",
        "named_struct('path', concat('clip ', id), 'bytes', cast(null as binary)) as audio",
        "'x' as language",
        "if(id < 40, 'test', 'train') as split",
        "if(id = 7, 8000, 16000) as rate",
    )


def test_every_row_gets_its_own_prediction(store):
    out = prediction.predict_split(prediction.prediction_rows(store, "test", ["x"]), shout)
    got = {r.id: r.prediction for r in out.collect()}
    assert got == {str(i): f"clip {i}" for i in range(40)}


def test_batch_checks(store):
    with pytest.raises(Exception, match="texts for a batch"):
        predict.predict(store, short).collect()
    assert predict.predict(store, shout, uniform="rate").count() == store.count()
    assert predict.predict(store.where("rate = 16000"), shout, uniform="rate").count() == 49


def test_wanted_ids_and_language_override(spark, store):
    wanted = spark.createDataFrame([("3", "q"), ("5", "x")], "ID string, language string")
    rows = prediction.prediction_rows(store, "test", ["x"], wanted=wanted).orderBy("id").collect()
    assert [(r.id, r.language) for r in rows] == [("3", "q"), ("5", "x")]
    with pytest.raises(IncompleteError, match="'45'"):
        prediction.prediction_rows(
            store, "test", ["x"], wanted=spark.createDataFrame([("45",), ("1",)], "ID string")
        )


def test_template_fill(spark):
    template = spark.createDataFrame(
        [(2, "b", "", "k2"), (1, "a", "", "k1"), (3, "c", "", "k3")],
        "n int, ID string, Target string, other string",
    )
    made = spark.createDataFrame([("a", "A"), ("c", None), ("zz", "Z")], "id string, prediction string")
    out = predict.fill_template(template, made, position="n")
    assert out.columns == ["ID", "Target", "other"]
    assert [tuple(r) for r in out.collect()] == [("a", "A", "k1"), ("b", "", "k2"), ("c", "", "k3")]
    with pytest.raises(Exception, match="predictions repeat an id of the template: a"):
        predict.fill_template(template, made.unionByName(made.where("id = 'a'"))).collect()
    unknown_twice = made.unionByName(made.where("id = 'zz'"))
    assert predict.fill_template(template, unknown_twice).count() == 3
    with pytest.raises(ValueError, match="no column to fill"):
        predict.fill_template(template.select("ID"), made)
    assert predict.bare_submission(made).columns == ["ID", "transcription"]


def test_dry_run(spark, tmp_path):
    test = spark.createDataFrame([("1",), ("1",), ("2",)], "ID string")
    template = spark.createDataFrame([("2", ""), ("3", "")], "ID string, Target string")
    report = {(r.measure, r.key): r.value for r in prediction.dry_run(test, template).collect()}
    assert [report[m, ""] for m in ("test_rows", "sample_rows", "test_unique_ids", "sample_unique_ids")] == [3, 2, 2, 2]
    assert report["test_sample_symmetric_difference", ""] == 2
    assert report["test_id_prefix", ""] == 3 and report["sample_id_prefix", ""] == 2
    assert prediction.dry_run(test, None) is None
    prediction.log_dry_run(spark, prediction.Run("My run"), str(tmp_path / "book"))
    row = tables.read_table(spark, str(tmp_path / "book"), columns=LEDGER_COLUMNS).first()
    assert row.status == "dry_run_validated" and row.experiment_id.endswith("_my_run")
    assert row.created_at_utc.endswith("Z") and row.submitted == "false"


def test_whole_job(spark, store, tmp_path):
    template = spark.createDataFrame([("1", ""), ("99", "")], "ID string, Target string")
    made = prediction.batch_prediction(
        store,
        shout,
        prediction.Run("job"),
        output=str(tmp_path / "out"),
        raw_output=str(tmp_path / "raw"),
        languages=["x"],
        template=template,
        ledger=str(tmp_path / "book"),
        max_rows=15,
    )
    assert made.count() == 15
    rows = {r.ID: r.Target for r in tables.read_table(spark, str(tmp_path / "out")).collect()}
    assert rows == {"1": "clip 1", "99": None}
    assert tables.read_table(spark, str(tmp_path / "raw")).columns == ["ID", "prediction"]
    book = tables.read_table(spark, str(tmp_path / "book"), columns=LEDGER_COLUMNS)
    assert book.where(F.col("status") == "completed_unsubmitted").count() == 1
