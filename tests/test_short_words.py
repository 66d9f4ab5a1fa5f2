"""Source 4 without its limit: report_lines compares short words with all short words."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from wordmend.operators import suggest as module
from wordmend.plans.check import check

MANY = sorted({a + b for a in "abcdefghijk" for b in "abcdefghijk"} | {"zz", "mzx", "mmmm", "zx"})


@pytest.mark.parametrize("way", ["broadcast", "two rounds", "apart", "shuffled"])
def test_all_short_words_are_candidates(spark, monkeypatch, way):
    if way == "two rounds":
        monkeypatch.setattr(module, "FEW_CANDIDATES", 0)
    if way == "apart":
        monkeypatch.setattr(module, "_has_few_short", lambda entries: False)
    if way == "shuffled":
        monkeypatch.setattr(module, "FEW_CANDIDATES", 0)
        monkeypatch.setattr(module, "MANY_CANDIDATES", 0)
    known = spark.createDataFrame([(w,) for w in MANY if w != "zx"], "word string")
    asked = spark.createDataFrame([("zx",), ("é",), ("nzx",)], "word string")
    got = {r.word: r.suggestions for r in module.suggest(asked, known, 200, all_short=True).collect()}
    pairs = [w for w in MANY if len(w) == 2 and w not in ("zz", "zx")]
    assert got["zx"] == ["mzx", "zz", *pairs]
    assert got["é"] == sorted([*pairs, "zz"])
    assert got["nzx"] == ["mzx", "zz"]


def test_report_lines_has_no_limit_and_others_keep_theirs(spark):
    docs = spark.createDataFrame([(1, "zx")], "id int, text string")
    known = spark.createDataFrame([(w,) for w in MANY if w != "zx"], "word string")
    (row,) = check(docs, ["id"], known, all_short=True).collect()
    assert row.suggestions[:2] == ["mzx", "zz"]
    (row,) = check(docs, ["id"], known).collect()
    assert row.suggestions[:2] == ["aa", "ab"]
    statements = entry.oracle_sql()
    assert "r <= 100" not in statements["report_lines"] and "r <= 100" in statements["report_lines_file"]
