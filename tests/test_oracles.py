"""Every registered query against its oracle, on the smallest given tables."""

import json
import math

import pytest

import __spark_entry__ as contract
from workload.all_queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()



@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')"
        )
    return connection


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return None if value is None else str(value)


def ordered(rows, columns):
    by_name = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(json.dumps([cell(row[i]) for i in by_name]) for row in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = ordered(df.collect(), df.columns)
    assert got
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == ordered(result.fetchall(), columns)


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["slice", "value", "rows", "wer", "cer", "error", "score"]
    assert df.count() > 3
