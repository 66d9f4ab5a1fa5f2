"""Registered queries: DuckDB where SQL can express them, shape and rerun elsewhere."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from wordmend.llm.queries import ORACLES, QUERIES

TABLES = "/root/testdata/sf0.001"
NUMBERS = range(1, 14)


def test_one_query_for_each_operator():
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(NUMBERS)
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    connection = duckdb.connect()
    for table in os.listdir(TABLES):
        connection.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{TABLES}/{table}'")
    got = QUERIES[name](spark, TABLES).toPandas()
    want = connection.execute(ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns

    def rows(frame):
        values = frame[columns].astype(object)
        return sorted(values.where(values.notna(), None).itertuples(index=False, name=None), key=str)

    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["op2_minhash_neardup", "op4_language_id", "op9_license_scan"])
def test_one_row_for_each_document(spark, name):
    rows = QUERIES[name](spark, TABLES)
    documents = spark.read.parquet(f"{TABLES}/documents.parquet")
    assert sorted(r.doc_id for r in rows.collect()) == sorted(r.doc_id for r in documents.collect())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for name, function in corpus_pipeline.STAGES:
        out = corpus_pipeline.stage(function(spark, docs, TABLES), name)
        if name != "pack_sequences":
            assert out.columns == columns and out.dtypes == docs.dtypes
        counts.append(out.count())
        docs = out
    assert counts[1] <= counts[0] and counts[2] < counts[1] and counts[3] <= counts[2]
    assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0


def test_pipeline_of_nothing_and_odd_rows(spark, empty, clashing):
    for docs, filled in ((empty, False), (clashing, True)):
        for name, function in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stage(function(spark, docs, TABLES), name)
        assert bool(docs.count()) == filled
