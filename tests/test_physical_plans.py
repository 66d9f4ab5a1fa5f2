"""What the plans must not contain."""

import re

import pytest

from wordmend import runtime
from wordmend.operators.suggest import suggest
from wordmend.operators.tokens import tokens, words
from wordmend.operators.words import vocabulary
from wordmend.plans.check import find, misspellings_per_document


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.range(20).selectExpr("id", "'Teh cat ' || id AS text", "'x' AS unused").write.parquet(path)
    return spark.read.parquet(path)


def sound(text):
    assert "Python" not in text and "ArrowEval" not in text
    assert "NestedLoop" not in text and "CartesianProduct" not in text
    return text


def test_tokenizing_is_narrow_and_reads_only_its_columns(table):
    text = sound(plan(tokens(table, ["id"])))
    assert "Exchange" not in text
    assert "unused" not in text


def test_looking_up_words_shuffles_no_tokens(table, spark):
    known = spark.createDataFrame([("the",), ("cat",)], "word string")
    text = sound(plan(find(table, ["id"], known)))
    assert "LeftAnti, BuildRight" in text
    assert "Exchange hashpartitioning(id" not in text and "Exchange hashpartitioning(word" not in (
        text.split("BroadcastExchange")[0]
    )


def test_counts_are_combined_before_the_shuffle(table, spark):
    text = sound(plan(vocabulary(words(table, ["id"]))))
    assert text.count("Exchange") == 1 and "partial_count" in text
    known = spark.createDataFrame([("the",)], "word string")
    text = sound(plan(misspellings_per_document(table, find(table, ["id"], known), ["id"])))
    assert "partial_sum" in text


def test_suggestions_rank_without_a_shuffle(spark):
    asked = spark.createDataFrame([("teh",)], "word string")
    known = spark.createDataFrame([("the",)], "word string")
    text = sound(plan(suggest(asked, known)))
    # The words are spread, and made distinct where they are; the rest builds the index.
    stream = text.split("BroadcastExchange")[0]
    assert len(re.findall(r"Exchange hashpartitioning\(word", stream)) == 1
    assert "WindowGroupLimit" in stream


def test_big_dictionaries_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        asked = spark.createDataFrame([("teh",)], "word string")
        text = sound(plan(suggest(asked, asked)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text
