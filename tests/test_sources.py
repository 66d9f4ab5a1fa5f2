"""Files and dictionaries."""

import pytest

from wordmend.plans.report import append_personal_words
from wordmend.sources import dictionaries
from wordmend.sources.dictionaries import (
    build_dictionary,
    describe_dictionary,
    dictionary_catalog,
    install_dictionary,
    load_dictionary,
    load_word_table,
    read_dictionaries,
    update_dictionaries,
    words_in_order,
)
from wordmend.operators.tokens import tokens
from wordmend.sources.documents import read_documents, read_lines
from wordmend.sources.wordlists import read_personal_words


def test_read_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("one\r\ntwo é\n".encode())
    (tmp_path / "b.md").write_text("# x")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "one\r\ntwo é\n", "b.md": "# x"}


def test_missing_files_are_skipped(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    with pytest.warns(UserWarning, match="File not found"):
        got = read_documents(spark, [str(tmp_path / "a.txt"), str(tmp_path / "no.txt")])
    assert [r.text for r in got.collect()] == ["one"]
    with pytest.warns(UserWarning, match="File not found"):
        nothing = read_documents(spark, str(tmp_path / "no.txt"))
    assert nothing.columns == ["path", "text"] and nothing.count() == 0


def test_paths_are_as_given(spark, tmp_path):
    names = ["my file é.txt", "a+b %20.txt"]
    for name in names:
        (tmp_path / name).write_text("x")
    got = read_documents(spark, str(tmp_path)).collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in got) == sorted(names)


def test_dictionaries(spark, words, tmp_path):
    path = str(tmp_path / "dictionaries")
    build_dictionary(words("hello world test hello"), path, "en_US")
    build_dictionary(words("le la"), path, "fr_FR")
    assert [r.word for r in words_in_order(load_dictionary(spark, path, "en_US")).collect()] == [
        "hello", "test", "world",
    ]
    got = {r.language: r for r in dictionary_catalog(spark, path).collect()}
    assert {k: r.word_count for k, r in got.items()} == {"en_US": 3, "fr_FR": 2}
    assert all(r.size_bytes > 0 for r in got.values())
    assert got["fr_FR"].path.startswith(path) and got["fr_FR"].path.endswith("/language=fr_FR")
    assert load_word_table(spark, got["fr_FR"].path).count() == 2
    assert describe_dictionary(spark, path, "xx").count() == 0

    (tmp_path / "list.txt").write_text(" Alpha \n\nb\nbeta\nalpha\n")
    install_dictionary(spark, str(tmp_path / "list.txt"), path, "de_DE")
    assert describe_dictionary(spark, path, "de_DE").first().word_count == 2
    update_dictionaries(spark, {"en_US": str(tmp_path / "list.txt"), "xx": "unused"}, path)
    counts = {r.language: r.word_count for r in dictionary_catalog(spark, path).collect()}
    assert counts == {"en_US": 2, "fr_FR": 2, "de_DE": 2}


def installed(spark, path):
    rows = read_dictionaries(spark, path).collect()
    return {(r.language, r.word) for r in rows}


def test_a_failed_publication_changes_nothing(spark, words, tmp_path, monkeypatch):
    path = str(tmp_path / "dictionaries")
    build_dictionary(words("one two"), path, "en")
    build_dictionary(words("un"), path, "fr")
    before, catalog = installed(spark, path), sorted(dictionary_catalog(spark, path).collect())
    (tmp_path / "list.txt").write_text("new\nlist\n")
    sources = {"en": str(tmp_path / "list.txt"), "fr": str(tmp_path / "list.txt")}

    def lost(*_):
        raise RuntimeError("driver lost")

    monkeypatch.setattr(dictionaries, "_publish", lost)  # all words are written, the manifest is not
    with pytest.raises(RuntimeError):
        update_dictionaries(spark, sources, path)
    assert installed(spark, path) == before
    assert sorted(dictionary_catalog(spark, path).collect()) == catalog
    monkeypatch.undo()
    update_dictionaries(spark, sources, path)
    assert installed(spark, path) == {(lang, w) for lang in ("en", "fr") for w in ("new", "list")}


def test_readers_keep_the_version_they_began_with(spark, words, tmp_path):
    path = str(tmp_path / "dictionaries")
    build_dictionary(words("one two"), path, "en")
    reader = load_dictionary(spark, path, "en")
    build_dictionary(words("three"), path, "en")
    assert {r.word for r in reader.collect()} == {"one", "two"}
    assert {r.word for r in load_dictionary(spark, path, "en").collect()} == {"three"}


def test_a_batch_is_published_once(spark, words, tmp_path):
    path = str(tmp_path / "dictionaries")
    build_dictionary(words("one two"), path, "en", batch="first")
    build_dictionary(words("three"), path, "en", batch="second")
    build_dictionary(words("one two"), path, "en", batch="first")  # a job that is repeated late
    assert installed(spark, path) == {("en", "three")}
    # A batch that was half written before is written anew.
    (tmp_path / "dictionaries/words/batch=third/language=en").mkdir(parents=True)
    (tmp_path / "dictionaries/words/batch=third/language=en/part-0.parquet").write_text("broken")
    build_dictionary(words("four"), path, "en", batch="third")
    assert installed(spark, path) == {("en", "four")}


def test_nothing_installed(spark, tmp_path):
    path = str(tmp_path / "none")
    assert dictionary_catalog(spark, path).count() == 0
    assert load_dictionary(spark, path, "en").collect() == []


def test_the_catalog_reads_no_words(spark, words, tmp_path):
    path = str(tmp_path / "dictionaries")
    build_dictionary(words("one two"), path, "en")
    plan = dictionary_catalog(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "parquet" not in plan.lower() and "word#" not in plan
    # Publishing counts by the footers of the files: no column is read.
    (folder,) = (tmp_path / "dictionaries/words").glob("batch=*")
    plan = dictionaries._measured(spark, str(folder))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in plan
    (row,) = dictionary_catalog(spark, path).collect()
    size = sum(f.stat().st_size for f in folder.rglob("*.parquet"))
    assert (row.word_count, row.size_bytes) == (2, size)


def test_additions_to_a_personal_list_can_be_repeated(spark, words, tmp_path):
    path = str(tmp_path / "personal")
    append_personal_words(words("one two"), path, batch="a")
    append_personal_words(words("two three"), path)
    append_personal_words(words("one two"), path, batch="a")
    assert spark.read.option("recursiveFileLookup", "true").text(path).count() == 4
    assert {r.word for r in read_personal_words(spark, path).collect()} == {"one", "two", "three"}
    (tmp_path / "one.txt").write_text("Alone\n# not\n")
    assert [r.word for r in read_personal_words(spark, str(tmp_path / "one.txt")).collect()] == ["alone"]


def small_blocks(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")


@pytest.fixture
def blocks(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {name: spark.conf.get(name) for name in names}
    yield lambda size: small_blocks(spark, size)
    for name, value in before.items():
        spark.conf.set(name, value)


LARGE = {
    "a.txt": "one two é ünïcode\r\n\nlast word " * 9000 + "end",
    "b.py": "x = 1 # comment here\ny = 'a literal' # more\n" * 5000,
    "c.txt": "\ufeffmarked text\nwith more lines\n" * 1,
    "d.txt": "\ufeff" + "grey owls fly\n" * 5000 + "no end",
    "e.txt": "",
    "f.txt": "\n\n\n",
    "g.txt": "long " * 40_000 + "\nshort",
    "h.md": "# heading\n",
}


def test_large_files_are_read_in_many_tasks(spark, tmp_path, blocks):
    """The same words at the same places as whole files have, however they are divided."""
    for name, text in LARGE.items():
        (tmp_path / name).write_bytes(text.encode())
    columns = ["path", "word", "line", "column", "start", "end", "context"]
    whole = read_documents(spark, str(tmp_path)).where("path NOT LIKE '%.md'")
    want = tokens(whole, ["path"], path="path").select(*columns)
    expected = sorted(map(tuple, want.collect()))
    for size in (20_000, 3_001):
        blocks(size)
        lines = read_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() >= 40
        got = tokens(lines, ["path"], path="path", by_line=True).select(*columns)
        assert sorted(map(tuple, got.collect())) == expected
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")


def test_lines_of_large_files(spark, tmp_path, blocks):
    blocks(64)
    text = "".join(f"line {i}\n" for i in range(500))
    (tmp_path / "a+b é.txt").write_text(text)
    rows = sorted(read_lines(spark, str(tmp_path / "a+b é.txt")).collect(), key=lambda r: r.line)
    assert [(r.line, r.text) for r in rows] == [(i + 1, f"line {i}") for i in range(500)]
    assert all(text[r.line_start :].startswith(r.text + "\n") for r in rows)
    assert {r.path.rsplit("/", 1)[1] for r in rows} == {"a+b é.txt"}


def test_block_comments_need_whole_documents(spark, tmp_path):
    (tmp_path / "a.c").write_text("x")
    with pytest.raises(ValueError, match="whole documents"):
        tokens(read_lines(spark, str(tmp_path)), ["path"], path="path", by_line=True, block_comments=True)
