"""Dictionaries: sorted words by language, published as versions.

A folder of dictionaries holds ``words/batch=…/language=…`` (Parquet) and ``manifest`` (JSON, one file
for each publication). Words are written first; a batch is installed when its one manifest file
appears, with all its languages together. Readers take the newest batch of each language from the
manifest, so they see a language before or after a publication, never half of one, and a failed
publication changes nothing. The manifest also has the counts and bytes that the catalog shows.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmend.runtime import shuffle_tasks
from wordmend.sources.wordlists import read_word_list

_SCHEMA = "word string, language string, batch string"
_MANIFEST = "number bigint, batch string, language string, word_count bigint, size_bytes bigint"


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    """Everything that was ever published; ``number`` counts the publications."""
    try:
        return spark.read.schema(_MANIFEST).json(f"{path.rstrip('/')}/manifest")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MANIFEST)


def _installed(spark: SparkSession, path: str) -> DataFrame:
    """The newest entry of each language."""
    entry = F.struct(*(f.split()[0] for f in _MANIFEST.split(", ")))
    newest = F.max_by(entry, F.struct("number", "batch")).alias("e")
    return _manifest(spark, path).groupBy("language").agg(newest).select("e.*")


def read_dictionaries(spark: SparkSession, path: str) -> DataFrame:
    """``(word, language)`` of all installed languages. Only installed versions are read."""
    entries = _installed(spark, path).select("batch", "language").collect()
    if not entries:
        return spark.createDataFrame([], _SCHEMA).drop("batch")
    words = f"{path.rstrip('/')}/words"
    batches = sorted({e.batch for e in entries})
    rows = (
        spark.read.schema(_SCHEMA)
        .option("basePath", words)
        .parquet(*(f"{words}/batch={batch}" for batch in batches))
    )
    wanted = [
        (F.col("batch") == e.batch) & F.col("language").eqNullSafe(e.language) for e in entries
    ]
    return rows.where(reduce(lambda a, b: a | b, wanted)).select("word", "language")


def load_dictionary(spark: SparkSession, path: str, language: str) -> DataFrame:
    """The words of one installed language; only its partition is read."""
    return read_dictionaries(spark, path).where(F.col("language") == language).select("word")


def load_word_table(spark: SparkSession, path: str) -> DataFrame:
    """A dictionary from any Parquet table with a ``word`` column."""
    return spark.read.parquet(path).select(F.lower("word").alias("word"))


def words_in_order(dictionary: DataFrame) -> DataFrame:
    """All words in byte order."""
    return dictionary.select("word").distinct().orderBy("word")


def dictionary_rows(words: DataFrame, language: str) -> DataFrame:
    """Distinct lower-case words labelled with their language."""
    return words.select(F.lower("word").alias("word")).distinct().withColumn("language", F.lit(language))


def write_dictionaries(rows: DataFrame, path: str, batch: str | None = None) -> None:
    """Install ``rows(word, language)``, replacing the languages they contain.

    ``batch`` names the publication (letters, digits and hyphens; made up by default): one that is
    already installed is not published again, so that a job may be repeated. Range partitioning
    spreads a big language over several sorted files.
    """
    spark = rows.sparkSession
    batch = batch or uuid.uuid4().hex
    known = _manifest(spark, path)
    if known.where(F.col("batch") == batch).head(1):
        return
    number = (known.agg(F.max("number")).first()[0] or 0) + 1
    folder = f"{path.rstrip('/')}/words/batch={batch}"
    (
        rows.select("word", "language")
        .distinct()
        .repartitionByRange(shuffle_tasks(spark), "language", "word")
        .sortWithinPartitions("language", "word")
        .write.mode("overwrite")
        .partitionBy("language")
        .parquet(folder)
    )
    _publish(_measured(spark, folder), path, batch, number)


def _measured(spark: SparkSession, folder: str) -> DataFrame:
    """Words and bytes by language, from the footers of the files."""
    files = (
        spark.read.schema("word string, language string")
        .parquet(folder)
        .groupBy(
            "language",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_size").alias("size"),
        )
        .agg(F.count("*").alias("words"))
    )
    return files.groupBy("language").agg(
        F.sum("words").alias("word_count"), F.sum("size").alias("size_bytes")
    )


def _publish(measured: DataFrame, path: str, batch: str, number: int) -> None:
    """One file, which appears when its job commits."""
    entries = measured.withColumns({"number": F.lit(number), "batch": F.lit(batch)}).coalesce(1)
    entries.write.mode("append").json(f"{path.rstrip('/')}/manifest")


def build_dictionary(
    words: DataFrame, path: str, language: str, batch: str | None = None
) -> None:
    write_dictionaries(dictionary_rows(words, language), path, batch)


def install_dictionary(spark: SparkSession, source: str, path: str, language: str) -> None:
    """Build a language from a word-list file."""
    build_dictionary(read_word_list(spark, source), path, language)


def update_dictionaries(spark: SparkSession, sources: Mapping[str, str], path: str) -> None:
    """Rebuild every installed language that has a word list in ``sources``, all in one batch."""
    installed = {r.language for r in dictionary_catalog(spark, path).select("language").collect()}
    rows = None
    for language, source in sorted(sources.items()):
        if language in installed:
            one = dictionary_rows(read_word_list(spark, source), language)
            rows = one if rows is None else rows.unionByName(one)
    if rows is not None:
        write_dictionaries(rows, path)


def dictionary_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Installed languages with path, word count and bytes on disk. Only the manifest is read."""
    words = path.rstrip("/") + "/words/batch="
    folder = F.concat(F.lit(words), F.col("batch"), F.lit("/language="), F.col("language"))
    return _installed(spark, path).select(
        "language", folder.alias("path"), "word_count", "size_bytes"
    )


def describe_dictionary(spark: SparkSession, path: str, language: str) -> DataFrame:
    """The catalog row of one language; no row if it is not installed."""
    return dictionary_catalog(spark, path).where(F.col("language") == language)


def word_counts(rows: DataFrame) -> DataFrame:
    """Distinct words per language of a dictionary table."""
    return rows.distinct().groupBy("language").agg(F.count("*").alias("word_count"))
