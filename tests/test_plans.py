"""What the optimiser makes of the main jobs."""

import pytest
from pyspark.sql import functions as F

from scribelake.functions import text
from scribelake.operators import profile, scoring, selection, vocabulary
from scribelake.plans import validation
from scribelake import session
from scribelake.session import scratch_root

SCHEMA = "id string, transcription string, language string, original_split string, other string"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "t")
    rows = [(str(i), f"word{i} x", "a" if i % 3 else "b", "validation", "o") for i in range(60)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scoring_reads_what_it_needs(stored):
    predictions = stored.select(F.col("id").alias("ID"), F.col("transcription").alias("prediction"))
    plan = plan_of(validation.validation_report(stored, predictions))
    assert "PushedFilters: [IsNotNull(original_split), EqualTo(original_split,validation)" in plan
    assert "other" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    # one trip to Python for both normalised texts, none for the distances
    assert plan.count("ArrowEvalPython") == 1
    assert "Expand" not in plan  # slices are regrouped from sums, not from repeated rows


def test_id_checks_read_ids_only(stored):
    ids = stored.select("id")
    plan = plan_of(profile.id_checks(stored, ids, ids))
    assert set(part.split(">")[0] for part in plan.split("ReadSchema: struct<")[1:]) == {"id:string"}
    assert plan.count("Exchange hashpartitioning(id") == 1


def test_counts_combine_before_the_shuffle(stored):
    plan = plan_of(vocabulary.top_tokens(stored, 5))
    assert "partial_count" in plan and plan.count("Window [") == 2
    drift = plan_of(vocabulary.drift_from_counts(vocabulary.split_counts(stored), stored))
    assert drift.count("hashpartitioning(language") + drift.count("hashpartitioning(token") <= 4
    assert "BatchEvalPython" not in drift and drift.count("ArrowEvalPython") == 1


def test_text_checks_shuffle_digests(stored):
    plan = plan_of(profile.text_checks(stored))
    assert "unhex(sha2(" in plan and "hashpartitioning(transcription" not in plan


def test_filters_pass_through_normalisation(stored):
    clean = stored.withColumn("n", text.normalise("transcription", strip_accents=True))
    counted = vocabulary.token_counts(stored, "language")
    pairs = stored.selectExpr("id", "language", "id as reference_text", "transcription as prediction_text")
    for frame in (clean, counted, scoring.with_edits(pairs)):
        plan = plan_of(frame.where(F.col("language") == "b"))
        assert "EqualTo(language,b)" in plan.split("PushedFilters")[1]


def test_normalised_texts_can_be_grouped(stored):
    grouped = stored.groupBy(text.normalise("transcription").alias("n")).count()
    assert grouped.count() == 60


def test_oversampling_does_not_shuffle_rows_by_group(spark, stored):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        plan = plan_of(selection.oversample(stored))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_builtin_engine_needs_no_python(stored):
    pairs = stored.selectExpr("id", "transcription as reference_text", "transcription as prediction_text")
    assert "EvalPython" not in plan_of(scoring.metrics(scoring.with_edits(pairs, forms="jvm")))


def test_scratch_tables_can_be_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "scratch_root", lambda _: str(tmp_path))
    assert session.materialise(spark.range(3).toDF("n"), "t").count() == 3
    assert list(tmp_path.rglob("*.parquet"))
    session.clear_scratch(spark)
    assert not list(tmp_path.rglob("*.parquet"))


def test_scratch_folder_comes_from_the_session():
    from types import SimpleNamespace

    def made(setting, master="local[2]"):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda key, default: setting),
            sparkContext=SimpleNamespace(master=master, applicationId="app-1"),
        )

    assert scratch_root(made("hdfs://shared/dir/")) == "hdfs://shared/dir"
    assert scratch_root(made(None)) == scratch_root(made(None)) != ""
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_root(made(None, "yarn"))
