import pytest

from pyspark.sql import functions as F

from scribelake.operators import ids, selection
from scribelake.operators.ids import IncompleteError


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.range(1000).selectExpr("cast(id as string) as id", "id % 7 as v")


def test_first_n(numbers):
    assert [r.id for r in selection.first_n(numbers, 3).collect()] == ["0", "1", "10"]
    assert selection.first_n(numbers, 2000).count() == 1000
    with pytest.raises(ValueError, match="2000 rows of 1000"):
        selection.first_n(numbers, 2000, strict=True)


@pytest.mark.parametrize("n", [0, 1, 137, 999, 1000, 5000])
def test_sample_is_exact_and_repeatable(numbers, monkeypatch, n):
    small = {r.id for r in selection.sample_n(numbers, n).collect()}
    monkeypatch.setattr(selection, "_HASH_DIGITS", 1)
    large = {r.id for r in selection.sample_n(numbers.repartition(16), n).collect()}
    assert len(small) == min(n, 1000) and small == large
    if n == 137:
        assert {r.id for r in selection.sample_n(numbers, n, seed=14).collect()} != small


def test_relabel(spark):
    rows = spark.createDataFrame([("1", "old", 5), ("2", "old", 6)], "id string, text string, x int")
    labels = spark.createDataFrame([("1", "a", 1), ("1", "b", 2), ("3", "c", 1)], "id string, label string, at int")
    with pytest.raises(IncompleteError, match="1 label rows"):
        selection.relabel(rows, labels)
    assert [tuple(r) for r in selection.relabel(rows, labels, order="at").collect()] == [("1", "b", 5)]


def test_language_override(spark):
    rows = spark.createDataFrame([("1", "x"), ("2", "y")], "id string, language string")
    given = spark.createDataFrame([("2", "z"), ("2", "q"), ("9", "n")], "id string, language string")
    out = selection.override_language(rows, given).orderBy("id").collect()
    assert [r.language for r in out] == ["x", "z"]


def test_missing_ids(spark):
    wanted = spark.createDataFrame([(str(i),) for i in range(20)] + [("3",)], "id string")
    found = wanted.where("id > 5")
    row = ids.missing_summary(wanted, found, k=3).first()
    assert (row.missing, row.examples) == (6, ["0", "1", "2"])
    with pytest.raises(IncompleteError, match="6 ids have no text"):
        ids.need_all(wanted, found, "text")
    ids.need_all(found, wanted, "text")


def test_set_operations_ignore_repeats(spark):
    a = spark.createDataFrame([("1",), ("1",), ("2",)], "id string")
    b = spark.createDataFrame([("2",), ("3",), ("3",)], "id string")
    assert [r.id for r in ids.overlap(a, b).collect()] == ["2"]
    assert [r.id for r in ids.difference(a, b).collect()] == ["1"]
    assert {tuple(r) for r in ids.symmetric_difference(a, b).collect()} == {("1", "left"), ("3", "right")}


def test_oversampling_balances_groups(spark):
    rows = spark.range(1300).selectExpr(
        "cast(id as string) as id", "if(id < 1000, 'big', 'small') as language"
    )
    out = selection.oversample(rows).groupBy("language").count().collect()
    sizes = {r.language: r["count"] for r in out}
    assert sizes["big"] == 1000 and 940 < sizes["small"] < 1060
    again = selection.oversample(rows.repartition(16))
    assert again.groupBy("language").count().collect() and again.count() == sum(sizes.values())


def test_samples_of_any_size_are_the_first_by_hash(spark, numbers):
    whole = [r.id for r in numbers.orderBy(selection._shuffled("id", 13), "id").select("id").collect()]
    for n in (0, 1, 100, 500, len(whole) - 1, len(whole), len(whole) + 5):
        assert {r.id for r in selection.sample_n(numbers, n).collect()} == set(whole[:n])
    hot = numbers.withColumn("id", F.lit("same"))
    assert selection.sample_n(hot, 7).count() == 7


def test_an_id_wanted_often_is_looked_for_once(spark):
    rows = spark.range(10).selectExpr("cast(id as string) as id")
    wanted = spark.range(3000).selectExpr("'3' as id")
    assert [r.id for r in selection.only_ids(rows, wanted).collect()] == ["3"]


def test_wanted_rows_exist_once(spark):
    def table(*names):
        return spark.createDataFrame([(n,) for n in names], "id string")

    ids.need_each_once(table("a"), table("a", "b", "b"), "clip")
    for wanted, found, problem in (
        (table("a", "c"), table("a"), "1 ids without a clip, first 'c'"),
        (table("a"), table("a", "a"), "several"),
        (table("a", "a"), table("a"), "repeatedly"),
        (table("a", None), table("a", None), "unknown"),
    ):
        with pytest.raises(IncompleteError, match=problem):
            ids.need_each_once(wanted, found, "clip")
