import glob

import duckdb

import __spark_entry__ as entry
from wordmend.operators.tokens import tokens
from wordmend.queries import entries
from wordmend.sources.documents import read_lines

MARK = "\ufeff"
LINES = [MARK + "marked é line", "", "two owls", MARK + "marked again", "last\r", *(f"line {i}" for i in range(300))]


def found(lines):
    rows = tokens(lines, ["path"], by_line=True).select("path", "word", "line", "column", "start", "end").collect()
    return sorted((r.path.split("/")[-2 if r.path.endswith(".txt") else -1], *r[1:]) for r in rows)


def test_pieces_of_a_file_are_read_as_one(spark, tmp_path):
    for part in ("part=0", "part=+1 é"):
        for kind in ("whole", "pieces"):
            (tmp_path / kind / part).mkdir(parents=True)
        (tmp_path / "whole" / part / "a.txt").write_bytes("".join(x + "\n" for x in LINES).encode())
        for nth, at in enumerate((0, 3, 3, 40)):
            some = LINES[at : (3, 3, 40, None)[nth]]
            (tmp_path / "pieces" / part / f"p-{nth}.txt").write_bytes("".join(x + "\n" for x in some).encode())
    for size in ("128m", "64"):
        before = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            whole = found(read_lines(spark, str(tmp_path / "whole")))
            assert found(read_lines(spark, str(tmp_path / "pieces"), pieces=True)) == whole
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_no_task_writes_a_whole_file_of_a_large_table(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "documents.parquet")
    rows = [(i, f"{MARK}owl{i % 7}\nsees\n" if i % 3 else f"fox{i % 5} runs") for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(12).write.parquet(folder)
    read = []
    monkeypatch.setattr(entries, "read_lines", lambda s, path, **more: read.append(path) or read_lines(s, path, **more))
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name in names:
            spark.conf.set(name, "1000")
        got = entries.large_file_words(spark, str(tmp_path)).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    files = glob.glob(f"{read[0]}/part=*/*.txt".removeprefix("file:"))
    assert len(files) >= 12
    database = duckdb.connect()
    database.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/*.parquet'")
    want = database.sql(entry.oracle_sql()["large_file_words"]).df()[list(got[0].asDict())]
    assert sorted(map(tuple, got)) == sorted(want.itertuples(index=False, name=None))
