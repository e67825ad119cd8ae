import pytest

from scribelake.operators import scoring
from scribelake.operators.guards import EmptyInputError, MixedValueError, with_uniform
from scribelake.operators.ids import IncompleteError
from scribelake.plans import run_gate, validation


def pairs(spark, rows):
    data = [(str(i), a, b) for i, (a, b) in enumerate(rows)]
    return spark.createDataFrame(data, "id string, reference_text string, prediction_text string")


def score(spark, *rows, **options):
    return scoring.metrics(scoring.with_edits(pairs(spark, rows), **options)).first()


@pytest.mark.parametrize("forms", ["arrow", "jvm"])
def test_unit_rates(spark, forms):
    assert score(spark, ("two words", "two words"), forms=forms).wer == 0.0
    assert score(spark, ("two words", "two birds"), forms=forms).wer == 0.5
    assert score(spark, ("abc", "ab"), forms=forms).cer == 1 / 3
    row = score(spark, ("abc", "ab"), forms=forms)
    assert row.error == 0.5 * row.wer + 0.5 * row.cer
    assert row.score == 1.0 - row.error


def test_rates_are_micro_averaged_and_guarded(spark):
    row = score(spark, ("a b c", "a b c"), ("a", "b"))
    assert row.rows == 2 and row.wer == 1 / 4
    assert score(spark, ("", "two words")).wer == 2.0  # an empty reference counts as one word
    assert score(spark, ("a", "x y z")).wer == 3.0
    assert score(spark, (None, None)).error == 0.0
    empty = scoring.metrics(scoring.with_edits(pairs(spark, [("a", "a")]).where("false"))).first()
    assert (empty.rows, empty.wer, empty.score) == (0, 0.0, 1.0)


def test_raw_scoring_sees_case_and_punctuation(spark):
    assert score(spark, ("Hello, you", "hello you")).error == 0.0
    raw = score(spark, ("Hello,\tyou", "hello you"), normalised=False)
    assert raw.wer == 0.5 and raw.cer == 3 / 10


def test_raw_texts_are_split_once_in_python(spark):
    """What goes to Python has its whitespace read there, not before in the JVM as well."""
    scored = scoring.with_edits(pairs(spark, [("A b", "a b"), ("x", None)]), normalised=False)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "translate" not in plan[plan.index("ArrowEvalPython") :]


def test_raw_scoring_agrees_with_the_builtin(spark):
    texts = ["A  b,\tC", " a b c ", "", None, "é\u3000ß", "Wort " * 250, "a b c", "x\u2028y\x1fz"]
    both = pairs(spark, [(a, b) for a in texts for b in texts])
    rows = {
        forms: scoring.with_edits(both, normalised=False, forms=forms).orderBy("id").collect()
        for forms in ("arrow", "jvm")
    }
    assert rows["arrow"] == rows["jvm"] and rows["arrow"][0].asDict().keys() >= set(scoring.EDIT_COLUMNS)


REF = [("1", "a b", "x", "validation"), ("2", "c d", "y", "validation"), ("3", "e", "x", "train")]
REF_SCHEMA = "id string, transcription string, language string, original_split string"


def tables(spark, predictions, reference=REF):
    return (
        spark.createDataFrame(reference, REF_SCHEMA),
        spark.createDataFrame(predictions, "ID string, prediction string"),
    )


def test_join_is_strict(spark):
    ref, pred = tables(spark, [("1", "a b"), ("2", "c"), ("3", "e"), ("9", "extra")])
    assert scoring.pair(ref, pred).count() == 3
    for broken, problem in (
        ([("1", "a"), ("2", "c")], "'missing': 1"),
        ([("1", "a"), ("1", "b"), ("2", "c"), ("3", "e")], "'repeated_other': 1"),
    ):
        ref, pred = tables(spark, broken)
        with pytest.raises(IncompleteError, match=problem):
            scoring.pair(ref, pred)
    ref, pred = tables(spark, [("1", "a")], [*REF[:1], *REF[:1], (None, "t", "x", "train")])
    with pytest.raises(IncompleteError, match="repeated_reference.*null_reference"):
        scoring.pair(ref, pred)


def test_a_hot_repeated_id_does_not_multiply_rows(spark):
    """A third of both tables under one id: reported, never joined."""
    hot = spark.range(30_000).selectExpr(
        "if(id % 3 = 0, 'hot', cast(id as string)) as id", "'w' as transcription"
    )
    audit = scoring.pairing_audit(hot, hot).first()
    assert audit.repeated_reference == audit.repeated_other == 9_999
    with pytest.raises(IncompleteError):
        scoring.pair(hot, hot.withColumnRenamed("transcription", "prediction"))


def test_report_by_slice(spark):
    ref, pred = tables(spark, [("1", "a b"), ("2", "c x")])
    rows = {(r.slice, r.value): r for r in validation.validation_report(ref, pred).collect()}
    assert set(rows) == {
        ("overall", ""), ("language", "x"), ("language", "y"), ("length_bucket", "00_05")
    }
    assert rows[("overall", "")].wer == 0.25
    assert rows[("language", "y")].wer == 0.5
    with pytest.raises(EmptyInputError, match="'test'"):
        validation.validation_report(ref, pred, split="test")


def test_null_slice_values_count_only_overall(spark):
    ref, pred = tables(spark, [("1", "a")], [("1", "a", None, "validation")])
    scored = validation.scored_split(ref, pred)
    assert scoring.metrics_by(scored, "language").count() == 0
    slices = scoring.sliced_metrics(scored, "language").collect()
    assert [(r.slice, r.rows) for r in slices] == [("overall", 1)]


@pytest.mark.parametrize("partitions", [1, 16])
def test_result_does_not_depend_on_partitioning(spark, partitions):
    rows = [(f"w{i} common word", f"w{i} {'common' if i % 3 else 'rare'} word") for i in range(300)]
    out = scoring.metrics(scoring.with_edits(pairs(spark, rows).repartition(partitions))).first()
    assert out.wer == 100 / 900


def test_written_report(spark, tmp_path):
    ref, pred = tables(spark, [("1", "a b"), ("2", "c x")])
    report = validation.validation_report(ref, pred)
    validation.write_validation_report(report, str(tmp_path))
    by_language = spark.read.csv(f"{tmp_path}/metrics_by_language", header=True).collect()
    assert [r.language for r in by_language] == ["x", "y"]
    assert spark.read.csv(f"{tmp_path}/overall_metrics", header=True).columns[0] == "rows"


def test_extra_slice_column(spark):
    ref, pred = tables(spark, [("1", "a b"), ("2", "c x")])
    ref = ref.selectExpr("*", "concat('s', id) as speaker")
    report = validation.validation_report(ref, pred, slices=["speaker"])
    assert {r.value for r in report.collect()} == {"", "s1", "s2"}


def test_worst_rows_break_ties_by_id(spark):
    scored = scoring.with_edits(pairs(spark, [("a", "b"), ("a", "a"), ("c", "d")]))
    assert [r.id for r in scoring.worst_rows(scored, 2).collect()] == ["0", "2"]


def test_uniform_guard(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2)], "g string, rate int")
    with pytest.raises(MixedValueError, match="'b'"):
        with_uniform(df, ["g"], "rate")
    assert with_uniform(df.where("g = 'a'"), ["g"], "rate").count() == 2


def test_regressions(spark):
    history = spark.createDataFrame(
        [("r1", "2024-01", "overall", "", 0.2), ("r2", "2024-02", "overall", "", 0.3)],
        "experiment_id string, created_at_utc string, slice string, value string, error double",
    )
    rows = {r.experiment_id: r for r in run_gate.regressions(history).collect()}
    assert rows["r2"].worse and not rows["r1"].worse and rows["r1"].previous_error is None
    assert not run_gate.regressions(history, 0.2).where("worse").count()


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_normalised_once(spark):
    plan = executed(scoring.with_edits(pairs(spark, [("Ab c", "ab")])))
    assert plan.count("translate(") == 2  # one a side


def test_disagreements_count_edits_once(spark):
    first = spark.createDataFrame([("1", "a b"), ("2", "c"), ("3", "d")], "ID string, prediction string")
    second = spark.createDataFrame([("1", "A b"), ("2", "e"), ("4", "")], "ID string, prediction string")
    apart = scoring.disagreements(first, second)
    assert executed(apart).count("_char_batch(") == 1
    told = {r.id: (r.in_both, r.word_edits, r.char_edits) for r in apart.collect()}
    assert told == {"2": (True, 1, 1), "3": (False, 1, 1), "4": (False, 0, 0)}


def test_bootstrap_joins_runs_once(spark, monkeypatch):
    rows = pairs(spark, [("a b", "a"), ("c", "d")]).selectExpr("*", "'x' AS language")
    scored = scoring.with_edits(rows)
    plans = []

    def kept(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return df

    monkeypatch.setattr(run_gate, "materialise", kept)
    run_gate.bootstrap_changes(scored, scored, replicates=3).collect()
    assert plans[0].count("Join Inner") == 1 and "Union" not in plans[0]
    # one for each of the digits of a digest, none a chance
    assert plans[0].count("conv(") == 4


def test_pairing_reads_each_table_once(spark):
    """The ids are not gathered in a pass of their own, for which texts would be made anew."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    ref, pred = tables(spark, [("1", "a b"), ("2", "c"), ("3", "e"), ("9", "x"), ("9", "y"), (None, "z")])
    paired = scoring.pair(
        ref.mapInArrow(seen, ref.schema), pred.mapInArrow(seen, pred.schema), keep=["language"]
    )
    assert paired.columns == ["id", "reference_text", "language", "prediction_text"]
    assert sorted(paired.collect()) == [("1", "a b", "x", "a b"), ("2", "c d", "y", "c"), ("3", "e", "x", "e")]
    assert read.value == 9
    nulls = scoring.pair(*tables(spark, [("1", None)], [("1", None, None, None)]), keep=["language"])
    assert [tuple(r) for r in nulls.collect()] == [("1", None, None, None)]


def test_pairs_are_dealt_to_several_tasks_a_core(spark):
    """Few large files would leave most cores waiting for the last tasks of the scoring."""
    paired = scoring.pair(*tables(spark, [("1", "a b"), ("2", "c"), ("3", "e")]), keep=["language"])
    assert paired.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert len(paired.collect()) == 3
