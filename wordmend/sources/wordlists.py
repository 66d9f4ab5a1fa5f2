"""Word lists: raw lists, personal lists and the built-in words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmend.functions.patterns import BUILTIN_ENGLISH, BUILTIN_OTHER, ENGLISH

# Trims every kind of white space, not only blanks.
_TRIMMED = r"(?U)^\s+|\s+$"


def _lines(lines: DataFrame) -> DataFrame:
    return lines.select(F.lower(F.regexp_replace("value", _TRIMMED, "")).alias("word"))


def personal_words(lines: DataFrame) -> DataFrame:
    """Distinct words of a personal list: no blank lines, no ``#`` comments."""
    return _lines(lines).where((F.col("word") != "") & ~F.startswith("word", F.lit("#"))).distinct()


def listed_words(lines: DataFrame) -> DataFrame:
    """Words of a raw word list that are longer than one byte."""
    return _lines(lines).where(F.octet_length("word") > 1)


def read_personal_words(spark: SparkSession, path: str) -> DataFrame:
    """A personal list: a file, or a folder of files at any depth."""
    return personal_words(spark.read.option("recursiveFileLookup", "true").text(path))


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    return listed_words(spark.read.text(path))


def builtin_words(spark: SparkSession, language: str = "en_US") -> DataFrame:
    """The small built-in list of a language."""
    words = (BUILTIN_ENGLISH if language in ENGLISH else BUILTIN_OTHER).split()
    return spark.createDataFrame([(w,) for w in words], "word string")
