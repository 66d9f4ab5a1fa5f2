import pytest
from pyspark.sql import functions as F

from wordmend import runtime
from wordmend.plans.check import check, find


@pytest.fixture
def little(spark, monkeypatch):
    """Broadcasts of up to 20 rows: frequent words fit, all words do not."""
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 20)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _documents(spark):
    frequent = " ".join(f"teh{c}" for c in "abcdefgh")
    rare = F.concat(F.lit("rare"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"))
    return spark.range(50).select("id", F.concat(F.lit(frequent + " "), rare).alias("text"))


def test_only_rare_words_are_shuffled(spark, words, little):
    """The words that most tokens have are broadcast; the rest is joined by a shuffle."""
    lookup = spark.createDataFrame(
        [(f"w{i}", 1000 if i < 8 else 1, ["x"]) for i in range(40)], "word string, n int, suggestions array<string>"
    )
    facts = spark.range(4000).select("id", F.concat(F.lit("w"), F.col("id") % 8).alias("word"))
    facts = facts.unionByName(spark.range(8, 45).select("id", F.concat(F.lit("w"), "id").alias("word")))
    joined = runtime.join_by_key(facts, lookup, "word", "n", [F.col("id")])
    assert joined.count() == 4032 and joined.select("word").distinct().count() == 40
    rest = facts.join(lookup.where(runtime.frequent_rows(lookup, "n")), "word", "left_anti")
    assert rest.count() == 37
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "LeftAnti" in plan


def test_no_count_stands_out(spark, little):
    lookup = spark.createDataFrame([(f"w{i}", 1) for i in range(40)], "word string, n int")
    assert runtime.frequent_rows(lookup, "n") is None
    joined = runtime.join_by_key(lookup.select("word"), lookup, "word", "n", [F.col("word")])
    assert joined.count() == 40


@pytest.mark.parametrize("known", ["rarea", "rarea " + " ".join(f"w{chr(97 + i)}" for i in range(26))])
def test_check_and_find_keep_all_words(spark, words, little, known):
    docs = _documents(spark)
    got = check(docs, ["id"], words(known))
    assert got.count() == 50 * 9 - 1
    assert got.select("id", "start").distinct().count() == 449
    assert find(docs, ["id"], words(known)).count() == 449
