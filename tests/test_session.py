"""Scratch tables: what a step leaves."""

import os

import pytest

from scribelake import session


def stored(spark):
    folder = session._scratch_folder(spark).removeprefix("file:")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_a_step_leaves_its_result_alone(spark):
    before = stored(spark)
    with session.step(spark) as paths:
        way = session.materialise(spark.range(5), "way")
        kept = session.step_result(way.selectExpr("id + 1 AS id"), "kept", paths)
    left = stored(spark) - before
    assert len(left) == 1 and left.pop().startswith("kept-")
    assert sorted(r.id for r in kept.collect()) == [1, 2, 3, 4, 5]


def test_a_step_that_breaks_leaves_nothing(spark):
    before = stored(spark)
    with pytest.raises(RuntimeError), session.step(spark):
        session.materialise(spark.range(5), "way")
        raise RuntimeError
    assert stored(spark) == before
    session.materialise(spark.range(1), "later")
    assert len(stored(spark) - before) == 1


def test_steps_inside_steps(spark):
    before = stored(spark)
    with session.step(spark) as outer:
        with session.step(spark) as inner:
            found = session.step_result(spark.range(3), "inner", inner)
        assert found.count() == 3
        session.step_result(found, "outer", outer)
    assert [n.split("-")[0] for n in stored(spark) - before] == ["outer"]
