"""The given tables, shaped as the inputs the operators expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmend.operators.tokens import scan, without_context
from wordmend.operators.tokens import words as words_of
from wordmend.operators.words import known_words, unknown_words
from wordmend.runtime import stage
from wordmend.sources.documents import spread
from wordmend.sources.wordlists import builtin_words

DOC = ["doc_id"]
TURN = ["conv_id", "turn"]
# Extensions given to documents in turn, so that every file type occurs.
EXTENSIONS = ("txt", "md", "py", "rs", "js", "go", "java", "c", "cpp", "tsx", "MD", "log")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(spark: SparkSession, sf_dir: str, rounds: int = 1) -> DataFrame:
    return spread(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), rounds)


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "conversations"))


def positions_of(table: DataFrame, keys: list[str], **options: object) -> DataFrame:
    """Words with positions, without context."""
    return without_context(scan(table, keys, **options))


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of ``benchmark`` and the built-in list."""
    found = words_of(read(spark, sf_dir, "benchmark"), ["item_id"])
    words = found.select(F.lower("word").alias("word")).unionByName(builtin_words(spark))
    return stage(words.distinct(), "dictionary")


def personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the users' turns."""
    turns = conversations(spark, sf_dir).where(F.col("role") == "user")
    return words_of(turns, TURN).select(F.lower("word").alias("word")).distinct()


def unknown(spark: SparkSession, sf_dir: str, words: DataFrame) -> DataFrame:
    """Distinct lower-case words of ``documents`` that are not in ``words``."""
    tokens = words_of(documents(spark, sf_dir), DOC)
    return unknown_words(tokens, known_words(words)).select(F.col("w").alias("word")).distinct()


def with_path(table: DataFrame) -> DataFrame:
    """Give documents a path whose extension depends on their number."""
    pick = F.element_at(
        F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % len(EXTENSIONS) + 1).cast("int")
    )
    return table.withColumn("path", F.concat(F.lit("d"), F.col("doc_id"), F.lit("."), pick))


def decorate(before: str, after: str) -> Column:
    """Every line put between ``before`` and ``after``."""
    return F.array_join(
        F.transform(
            F.split("text", "\n", -1),
            lambda x: F.concat(F.lit(before), x, F.lit(after)),
        ),
        "\n",
    )
