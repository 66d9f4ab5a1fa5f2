"""Check files as they arrive: every content once, whatever its path.

``out`` holds ``found/batch=…`` (misspellings by content) and ``files/batch=…`` (paths and the content of
each), written in this order for every batch of the stream. A batch replaces its own folders, so
one that is repeated after a failure adds no row, and contents count as checked only when their
batch's list of files was written. A file that comes back under another path is listed again
but not checked again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wordmend.plans.check import check
from wordmend.runtime import stage
from wordmend.sources.documents import file_type, files_as_stream, source_lang

_FILES = "path string, content string, batch bigint"
_FOUND = (
    "content string, word string, line int, column int, start int, end int, context string, "
    "suggestions array<string>, batch bigint"
)


def _table(spark: SparkSession, out: str, name: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(f"{out.rstrip('/')}/{name}")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _content(path: Column, text: Column) -> Column:
    """What decides the result of a check: the text and the kind of file."""
    kind = F.concat_ws(" ", file_type(path), F.coalesce(source_lang(path), F.lit("")))
    return F.sha2(F.concat_ws("\n", kind, text), 256)


def check_batch(
    documents: DataFrame, batch: int, out: str, dictionary: DataFrame, **options: object
) -> None:
    """Check the documents ``(path, text)`` whose content no other batch had, and list all paths."""
    spark, folder = documents.sparkSession, f"{out.rstrip('/')}/{{}}/batch={batch}"
    marked = stage(
        documents.select("path", "text", _content(F.col("path"), F.col("text")).alias("content")),
        "arrived",
    )
    checked = _table(spark, out, "files", _FILES).where(F.col("batch") != batch)
    new = marked.dropDuplicates(["content"]).join(checked.select("content"), "content", "left_anti")
    found = check(new, ["content"], dictionary, path="path", **options)
    found.write.mode("overwrite").parquet(folder.format("found"))
    marked.select("path", "content").write.mode("overwrite").parquet(folder.format("files"))


def check_new_files(
    spark: SparkSession, source: str, out: str, dictionary: DataFrame, **options: object
) -> StreamingQuery:
    """Start a stream over the files in the folder ``source`` that ends when all were checked.

    Started again, it reads only files that came since.
    """

    def one(batch: DataFrame, number: int) -> None:
        check_batch(batch, number, out, dictionary, **options)

    return (
        files_as_stream(spark, source)
        .writeStream.foreachBatch(one)
        .option("checkpointLocation", f"{out.rstrip('/')}/progress")
        .trigger(availableNow=True)
        .start()
    )


def checked_files(spark: SparkSession, out: str) -> DataFrame:
    """``(path, word, line, column, start, end, context, suggestions)`` of all files so far."""
    files = _table(spark, out, "files", _FILES).select("path", "content").distinct()
    found = _table(spark, out, "found", _FOUND).drop("batch")
    return files.join(found, "content").drop("content")
