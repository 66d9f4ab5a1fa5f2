"""Check, fix, review and report end to end."""

import json

import pytest
from pyspark.sql import functions as F

from wordmend import runtime
from wordmend.plans.check import check, find, misspellings_per_document, summarize
from wordmend.plans.fix import apply_decisions, apply_edits, fix, new_personal_words, summarize_fixes
from wordmend.plans.report import (
    append_personal_words,
    flat_report,
    json_report,
    write_corrected,
    write_flat_report,
    write_json_report,
)
from wordmend.sources.wordlists import read_personal_words

TEXTS = {
    "a.txt": "Teh cat\nteh  dog, qqqqqq é",
    "b.md": "# Teh cat\n\n`teh code` and [teh](http://teh.example)\n",
    "c.py": 'x = "teh cat"  # teh "teh" dog',
    "d.txt": "the cat",
    "e.txt": "",
}
DICTIONARY = "the cat dog and"


@pytest.fixture(params=["broadcast", "shuffle", "salted"])
def way(request, monkeypatch):
    if request.param != "broadcast":
        monkeypatch.setattr(runtime, "BROADCAST_ROWS", 0)
    if request.param == "salted":
        monkeypatch.setattr(runtime, "shuffle_tasks", lambda spark: 100)
    return request.param


def test_check(docs, words, way):
    got = check(docs(TEXTS), ["path"], words(DICTIONARY), path="path")
    rows = {(r.path, r.word, r.line, r.start, tuple(r.suggestions)) for r in got.collect()}
    assert rows == {
        ("a.txt", "Teh", 1, 0, ("the",)),
        ("a.txt", "teh", 2, 8, ("the",)),
        ("a.txt", "qqqqqq", 2, 18, ()),
        ("a.txt", "é", 2, 25, ()),
        ("b.md", "Teh", 1, 2, ("the",)),
        ("b.md", "teh", 3, 27, ("the",)),
        ("c.py", "teh", 1, 5, ("the",)),
        ("c.py", "teh", 1, 17, ("the",)),
        ("c.py", "teh", 1, 22, ("the",)),
    }
    assert got.count() == 10  # the quoted word of the comment is found twice


def test_find_agrees_with_check(docs, words, way):
    place = ["path", "word", "line", "column", "start", "end"]
    left = check(docs(TEXTS), ["path"], words(DICTIONARY), path="path").select(place)
    right = find(docs(TEXTS), ["path"], words(DICTIONARY), path="path").select(place)
    assert sorted(left.collect()) == sorted(right.collect())


def test_personal_words_and_ignore_rules(docs, words):
    got = check(
        docs({"a.txt": "Teh qqq Zap xyzzy"}), ["path"], words("the"), words("QQQ"), ignore=["^Z", "y+z"]
    )
    assert [r.word for r in got.collect()] == ["Teh"]


def test_a_frequent_word_is_spread_over_tasks(spark, words, monkeypatch):
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 0)
    frame = spark.range(40).select(F.col("id"), F.expr("repeat('teh ', 30) || 'rare' || id").alias("text"))
    got = check(frame, ["id"], words("the"))
    assert got.where("word = 'teh'").count() == 1200
    assert got.where("word = 'rare'").count() == 40
    assert got.select("id", "start").distinct().count() == 1240


def test_overlapping_edits(spark):
    documents = spark.createDataFrame([(1, "abcdefghijklmn"), (2, "untouched")], "id int, text string")
    edits = spark.createDataFrame(
        [(1, 0, 10, "X"), (1, 2, 4, "Y"), (1, 5, 8, "Z"), (1, 12, 13, None), (1, 10, 11, "K"), (1, 10, 11, "K")],
        "id int, start int, end int, new string",
    )
    rows = {r.id: tuple(r)[1:] for r in apply_edits(documents, edits, ["id"]).collect()}
    assert rows == {1: ("XKlmn", 2, 1), 2: ("untouched", 0, 0)}


def test_many_heavy_words_keep_all_rows(spark, monkeypatch):
    """No list of the heaviest words is cut off: 1500 of them are spread."""
    monkeypatch.setattr(runtime, "shuffle_tasks", lambda spark: 3000)
    facts = spark.range(9000).selectExpr("concat('w', id % 1500) AS word", "id")
    lookup = facts.groupBy("word").count().withColumnRenamed("count", "n")
    joined = runtime.salted_join(facts, lookup, ["word"], "n", [F.col("id")])
    assert joined.count() == 9000 and joined.where("n != 6").count() == 0


def test_counts(docs, words):
    frame = docs(TEXTS)
    found = find(frame, ["path"], words(DICTIONARY), path="path")
    counts = misspellings_per_document(frame, found, ["path"])
    assert {r.path: r.error_count for r in counts.collect()} == {
        "a.txt": 4, "b.md": 2, "c.py": 4, "d.txt": 0, "e.txt": 0,
    }
    assert tuple(summarize(found, frame).first()) == (5, 10, False)
    assert tuple(summarize(found.limit(0), frame).first()) == (5, 0, True)


def test_fix(docs, words, way):
    got = fix(docs(TEXTS), ["path"], words(DICTIONARY), path="path")
    rows = {r.path: (r.text, r.fixed_count, r.unfixed_count) for r in got.collect()}
    assert rows == {
        "a.txt": ("the cat\nthe  dog, qqqqqq é", 2, 2),
        "b.md": ("# the cat\n\n`teh code` and [the](http://teh.example)\n", 2, 0),
        "c.py": ('x = "the cat"  # the "the" dog', 3, 0),
        "d.txt": ("the cat", 0, 0),
        "e.txt": ("", 0, 0),
    }
    assert tuple(summarize_fixes(got).first()) == (5, 7)


def test_keys_may_repeat(spark, words):
    rows = [("k", "teh a-teh"), ("k", "cat teh"), ("k", "cat teh"), ("k", "the"), ("l", "teh")]
    frame = spark.createDataFrame(rows, "key string, text string")
    got = fix(frame, ["key"], words("the cat"))
    assert sorted((r.key, r.text, r.fixed_count) for r in got.collect()) == [
        ("k", "cat the", 1), ("k", "cat the", 1), ("k", "the", 0), ("k", "the a-the", 2), ("l", "the", 1),
    ]


def test_fix_of_compounds_and_wide_text(docs, words):
    text = "tehCat é-teh\r\n中teh teh"
    (row,) = fix(docs({"a.txt": text}), ["path"], words("the cat")).collect()
    assert row.text == "theCat é-the\r\n中teh the"


def test_edits_that_overlap_or_repeat(spark):
    frame = spark.createDataFrame([(1, "ab nbcd é")], "id int, text string")
    edits = spark.createDataFrame(
        [(1, 3, 7, "X"), (1, 4, 7, "Y"), (1, 3, 7, "X"), (1, 8, 10, "ü!"), (1, 0, 2, None)],
        "id int, start int, end int, new string",
    )
    (row,) = apply_edits(frame, edits, ["id"]).collect()
    assert (row.text, row.fixed_count, row.unfixed_count) == ("ab X ü!", 2, 1)


def test_round_trip_without_edits(spark, docs):
    none = spark.createDataFrame([], "path string, start int, end int, new string")
    got = apply_edits(docs(TEXTS), none, ["path"])
    assert {r.path: r.text for r in got.collect()} == TEXTS


def test_decisions(spark, docs, words):
    frame = docs({"a.txt": "teh teh teh teh wrod"})
    found = check(frame, ["path"], words("the ten word"))
    options = next(r.suggestions for r in found.collect() if r.word == "teh")
    assert options == ["the", "ten"]
    decisions = spark.createDataFrame(
        [
            ("a.txt", 0, 3, "skip", 0), ("a.txt", 4, 7, "replace", 2), ("a.txt", 8, 11, "replace", 3),
            ("a.txt", 12, 15, "replace", 0), ("a.txt", 16, 20, "add", 0),
        ],
        "path string, start int, end int, action string, choice int",
    )
    fixed, accepted = apply_decisions(frame, found, decisions, ["path"])
    row = fixed.first()
    assert (row.text, row.fixed_count) == ("teh ten teh teh wrod", 1)
    assert [r.word for r in accepted.collect()] == ["wrod"]
    assert new_personal_words(accepted, words("WROD")).count() == 0


def test_reports(spark, docs, words, tmp_path):
    frame = docs(TEXTS)
    found = check(frame, ["path"], words(DICTIONARY), path="path")
    report = json_report(frame, found, ["path"], F.col("path"))
    write_json_report(report, str(tmp_path / "json"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "json")).collect()]
    assert len(lines) == 5 and all(x["files_checked"] == 1 for x in lines)
    (one,) = [x for x in lines if x["errors"] and x["errors"][0]["file"] == "a.txt"]
    assert one["total_errors"] == 4
    assert [e["word"] for e in one["errors"]] == ["Teh", "teh", "qqqqqq", "é"]
    assert one["errors"][0] == {
        "file": "a.txt", "line": 1, "column": 1, "word": "Teh", "suggestions": ["the"], "context": "Teh cat",
    }
    write_flat_report(flat_report(found, ["path"]), str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True, multiLine=True)
    assert back.count() == 10
    fixed = fix(frame, ["path"], words(DICTIONARY), path="path")
    write_corrected(fixed, str(tmp_path / "fixed"))
    assert {r.path for r in spark.read.parquet(str(tmp_path / "fixed")).collect()} == {"a.txt", "b.md", "c.py"}


def test_personal_list_grows(spark, words, tmp_path):
    path = str(tmp_path / "personal")
    append_personal_words(words("one"), path)
    append_personal_words(words("two"), path)
    assert sorted(r.word for r in read_personal_words(spark, path).collect()) == ["one", "two"]
