"""Reports and reviews shuffle the text, not its words; results are those of ``check``."""

import random
import re

import pytest
from pyspark.sql import functions as F

from wordmend import runtime
from wordmend.plans.check import RANGE, check, placed_tokens
from wordmend.plans.fix import _decided_by_document, apply_decisions, chosen, with_decisions
from wordmend.plans.report import flat_report, flat_report_in_ranges, json_report


@pytest.fixture
def documents(spark):
    letters = "abcdefghij"
    rows = [(i % 45, f"Teh cat teha\ntehb rare{letters[i % 10]}{letters[i // 10]} LOUD") for i in range(50)]
    return spark.createDataFrame([*rows, (None, "teh nobody"), (7, None), (8, "")], "id int, text string")


@pytest.fixture(params=[runtime.BROADCAST_ROWS, 9, 0])
def limit(spark, request, monkeypatch):
    """All suggestions are broadcast, or those of frequent words, or none."""
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", request.param)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield request.param
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def table(frame):
    return sorted((tuple(map(str, row)) for row in frame.collect()))


def test_tokens_are_those_of_a_check(documents, words, limit):
    want = check(documents, ["id"], words("the cat"))
    found = placed_tokens(documents, ["id"], words("the cat"), ranges=True)[1]
    assert table(found.select(want.columns)) == table(want)


def test_json_report_of_placed_tokens(documents, words, limit):
    want = json_report(documents, check(documents, ["id"], words("the cat")), ["id"], F.col("id").cast("string"))
    found = placed_tokens(documents, ["id"], words("the cat"))[1]
    got = json_report(documents, found, ["id"], F.col("id").cast("string"))
    assert table(got) == table(want)


def test_flat_report_in_ranges(spark, documents, words, limit, tmp_path):
    want = flat_report(check(documents, ["id"], words("the cat")), ["id"])
    found = placed_tokens(documents, ["id"], words("the cat"), ranges=True)[1]
    got = flat_report_in_ranges(found, ["id"], RANGE)
    assert got.columns == want.columns and table(got) == table(want)
    got.write.parquet(str(tmp_path / "report"))
    lines = []
    for path in sorted((tmp_path / "report").glob("*.parquet")):
        lines += [(-1 if r.id is None else r.id) for r in spark.read.parquet(str(path)).collect()]
    assert lines == sorted(lines)


def test_words_are_not_shuffled(documents, words):
    """The text is, and the documents' keys for the join of the report."""
    found = placed_tokens(documents, ["id"], words("the cat"))[1]
    report = json_report(documents, found, ["id"], F.col("id").cast("string"))
    shuffles = re.findall(r"Exchange hashpartitioning\([^\n]*", plan(report))
    assert sum("REPARTITION_BY_NUM" in x for x in shuffles) == 1
    assert sum("ENSURE_REQUIREMENTS" in x for x in shuffles) <= 1
    found = placed_tokens(documents, ["id"], words("the cat"), ranges=True)[1]
    assert "ENSURE_REQUIREMENTS" not in plan(flat_report_in_ranges(found, ["id"], RANGE)).replace("Broadcast", "")


def test_ranges_of_keys(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(400)]), rng.choice("abc")) for _ in range(3000)]
    frame = spark.createDataFrame(rows, "a int, b string")
    for tasks in (1, 3, 150):
        placed = runtime.in_ranges(frame, ["a", "b"], tasks, "at").repartition(tasks, "at")
        parts = placed.groupBy(F.spark_partition_id().alias("p")).agg(
            F.min(F.struct("a", "b")).alias("low"), F.max(F.struct("a", "b")).alias("high")
        ).collect()
        held = [((-1 if r.low.a is None else r.low.a, r.low.b), (-1 if r.high.a is None else r.high.a, r.high.b))
                for r in sorted(parts, key=lambda r: r.p)]
        assert all(x[1] < y[0] for x, y in zip(held, held[1:]))
        assert placed.count() == 3000 and len(parts) >= 0.6 * tasks


def test_decisions_by_document(spark, documents, words):
    """Misspellings and decisions may repeat; keys and choices may be null."""
    found = spark.createDataFrame(
        [(1, 0, 3, "a", ["x", "y"]), (1, 0, 3, "b", ["z"]), (1, 4, 6, "c", []), (2, 0, 3, "d", ["u"]), (None, 0, 3, "e", ["v"])],
        "id int, start int, end int, word string, suggestions array<string>",
    )
    decisions = spark.createDataFrame(
        [(1, 0, 3, "replace", 1), (1, 0, 3, "replace", 2), (1, 4, 6, "replace", 1), (1, 0, 3, "skip", 1), (2, 0, 3, "add", 1),
         (2, 0, 3, "replace", None), (2, 0, 3, "replace", 1), (3, 0, 3, "replace", 1), (None, 0, 3, "replace", 1)],
        "id int, start long, end long, action string, choice int",
    )
    new = ["id", "start", "end", chosen().alias("new")]
    want = with_decisions(found, decisions, ["id"]).select(*new).where("new IS NOT NULL")
    got = _decided_by_document(found, decisions, ["id"]).select(*new).where("new IS NOT NULL")
    assert table(got) == table(want) and got.count() == 4


def test_a_review_shuffles_documents_only(documents, words):
    dealt, found = placed_tokens(documents, ["id"], words("the cat"), context=False)
    decisions = found.select("id", "start", "end", F.lit("replace").alias("action"), F.lit(1).alias("choice"))
    fixed = apply_decisions(dealt, found, decisions, ["id"])[0]
    text = plan(fixed)
    assert not re.findall(r"Exchange hashpartitioning\([^)]*start", text)
    assert "ENSURE_REQUIREMENTS" not in "".join(re.findall(r"\n[^\n]* Exchange [^\n]*", text))
    rows = {r.id: r.text for r in fixed.collect()}
    assert rows[None] == "teh nobody" and rows[20].startswith("the cat teha\n")
