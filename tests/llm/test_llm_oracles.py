"""Each query against its SQL, and the pipeline against its stages' own rules."""

import os

import duckdb
import pytest

import corpus_pipeline
from scribelake.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for file in os.listdir(sf_dir):
        connection.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{sf_dir}/{file}'")
    return connection


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(repr, frame[columns].astype(object).itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    mine, theirs = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLES[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    for frame in (mine, theirs):
        frame.sort_values(columns, inplace=True, ignore_index=True)
    assert (mine[columns].astype(str) == theirs[columns].astype(str)).all().all()


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_by_its_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == columns
        counts.append(docs.count())
    texts = spark.read.parquet(f"{tmp_path}/1")
    assert texts.select("text").distinct().count() == texts.count()
    mixed = docs.groupBy("doc_id").count().toPandas()
    assert mixed["count"].max() <= 2
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == counts[-1]
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(str, whole.collect())) == sorted(map(str, last.collect()))


def test_pipeline_takes_an_empty_table(spark, no_documents, sf_dir):
    docs = no_documents
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


def test_pipeline_takes_odd_rows_and_clashing_names(spark, odd_documents, sf_dir):
    docs = odd_documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns
        docs = kept
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == docs.count()
