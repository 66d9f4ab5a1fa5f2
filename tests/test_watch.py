"""Files that arrive one after the other."""

from pyspark.sql import functions as F

from wordmend.plans import watch
from wordmend.plans.check import check
from wordmend.sources.documents import read_documents


def run(spark, tmp_path, words):
    query = watch.check_new_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), words("grey owls fly"))
    query.awaitTermination()
    assert query.exception() is None
    return [(p["batchId"], p["numInputRows"]) for p in query.recentProgress if p["numInputRows"]]


def found(spark, tmp_path):
    rows = watch.checked_files(spark, str(tmp_path / "out")).collect()
    return sorted((r.path.rsplit("/", 1)[1], r.word, r.line, r.start, *r.suggestions) for r in rows)


def test_only_new_files_are_read(spark, words, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("grey owlz\nflyy")
    (tmp_path / "in/b.py").write_text("x = 1 # gray")
    assert run(spark, tmp_path, words) == [(0, 2)]
    first = found(spark, tmp_path)
    assert [r[:2] for r in first] == [("a.txt", "flyy"), ("a.txt", "owlz"), ("b.py", "gray")]
    assert run(spark, tmp_path, words) == []
    assert found(spark, tmp_path) == first
    (tmp_path / "in/c.md").write_text("`code` nwe")
    (tmp_path / "in/copy.txt").write_text("grey owlz\nflyy")
    assert run(spark, tmp_path, words) == [(1, 2)]
    # The copy is listed, but its content was not checked again.
    rows = watch._table(spark, str(tmp_path / "out"), "found", watch._FOUND)
    assert {(r.word, r.batch) for r in rows.collect()} == {("flyy", 0), ("owlz", 0), ("gray", 0), ("nwe", 1)}
    whole = check(read_documents(spark, str(tmp_path / "in")), ["path"], words("grey owls fly"), path="path")
    want = sorted((r.path.rsplit("/", 1)[1], r.word, r.line, r.start, *r.suggestions) for r in whole.collect())
    assert found(spark, tmp_path) == want


def test_a_repeated_batch_adds_no_row(spark, words, tmp_path):
    out, dictionary = str(tmp_path / "out"), words("grey owls fly")
    docs = spark.createDataFrame([("a.txt", "grey owlz"), ("b.txt", "nwe")], "path string, text string")
    watch.check_batch(docs.where(F.col("path") == "a.txt"), 0, out, dictionary)
    for _ in range(2):
        watch.check_batch(docs, 1, out, dictionary)
        assert sorted((r.path, r.word) for r in watch.checked_files(spark, out).collect()) == [
            ("a.txt", "owlz"),
            ("b.txt", "nwe"),
        ]


def test_a_batch_that_failed_before_its_files_were_listed(spark, words, tmp_path):
    out, dictionary = str(tmp_path / "out"), words("grey")
    docs = spark.createDataFrame([("a.txt", "grey owlz")], "path string, text string")
    watch.check_batch(docs, 0, out, dictionary)
    spark.createDataFrame([], "path string, content string").write.mode("overwrite").parquet(
        out + "/files/batch=0"
    )
    assert watch.checked_files(spark, out).count() == 0
    watch.check_batch(docs, 0, out, dictionary)
    assert [r.word for r in watch.checked_files(spark, out).collect()] == ["owlz"]
