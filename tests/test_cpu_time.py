"""Steps that took most of the CPU time do their work in bulk, with the same results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from wordmend.functions.arrays import running_starts
from wordmend.functions.text import blank, without_return
from wordmend.operators.blocks import _begins, _from, _indent
from wordmend.operators.lexer import split_blocks
from wordmend.queries.entries import QUERIES
from wordmend.sources.documents import spread

TABLES = "/root/testdata/sf0.001"


def test_blank_is_not_made_character_by_character(spark):
    texts = ["", "plain text", "é ü\n", "\n\n", "a\U0001f600b\n中\r\n\tz", " \n "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    made = blank(F.col("t"))
    assert "regexp_replace" not in str(made)
    got = [r[0] for r in rows.select(made).collect()]
    want = ["\n".join(" " * len(x.encode()) for x in t.split("\n")) for t in texts]
    assert got == want


def test_return_is_cut_without_a_regular_expression(spark):
    texts = ["", "\r", "a\r", "é\r\r", "a\rb", "ab"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    made = without_return(F.col("t"))
    assert "regexp_replace" not in str(made)
    assert [r[0] for r in rows.select(made).collect()] == ["", "", "a", "é\r", "a\rb", "ab"]


def test_line_heads(spark):
    rows = spark.createDataFrame([("  é x", 0), ("  é x", 3), ("", 0)], "t string, at int")
    got = rows.select(_from(F.col("t"), F.col("at")), _indent(F.col("t")), _begins(F.ltrim("t"), "#-")).collect()
    assert [tuple(r) for r in got] == [("  é x", 2, False), (" x", 2, False), ("", 0, False)]


def test_raw_marks(spark):
    text = 'xr"no" r#"in "quoted" x"# éb"s" br##"a"#b"## r'
    got = spark.createDataFrame([(text,)], "t string").select(
        split_blocks(F.col("t"), F.lit("rust"))["blocks"].alias("b")
    ).first()[0]
    assert got.split() == ["in", '"quoted"', "x", 'a"#b']


@pytest.mark.parametrize("size", [0, 1, 16, 17, 257, 4097, 70000])
def test_running_starts_of_any_size(spark, size):
    lengths = F.transform(F.array_repeat(F.lit(3), size), lambda x, i: x + i % 2)
    got = spark.range(1).select(running_starts(lengths)).first()[0]
    assert got == [3 * i + i // 2 for i in range(size)]


def test_few_parts_for_each_core_are_dealt_out(spark):
    tasks = spark.sparkContext.defaultParallelism
    some = spark.range(100).repartition(tasks + 1)
    assert spread(some).rdd.getNumPartitions() == tasks + 1
    assert spread(some, 3).rdd.getNumPartitions() > 3 * tasks
    many = spark.range(100).repartition(3 * tasks)
    assert spread(many, 3).rdd.getNumPartitions() == 3 * tasks


def test_a_review_does_not_read_the_text_again(spark):
    """Decisions are made from the misspellings: the text was scanned for both before."""
    plan = QUERIES["added_personal_words"](spark, TABLES)._jdf.queryExecution().toString()
    assert "documents.parquet" not in plan
