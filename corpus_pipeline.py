"""From raw documents to packed training sequences: each stage works on what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmend.llm import language, mixing, neardup, packing, repeats
from wordmend.llm.columns import numbered, restored
from wordmend.runtime import stage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language. The predicted language replaces the given one."""
    plain, names = numbered(docs)
    model = language.fit(docs)
    found = language.predict(plain, model, names["text"])
    found = found.where(F.col("lang_pred") != language.UNKNOWN)
    predicted = F.col("lang_pred").cast(docs.schema["lang"].dataType)
    return found.withColumn(names["lang"], predicted).select(*restored(names))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one has; those with nothing left go."""
    plain, names = numbered(docs)
    text, size = names["text"], names["n_chars"]
    cut = repeats.without_repeats(plain, names["doc_id"], text)
    left = F.col(text).isNull() | (F.col("removed_words") == 0) | (F.trim(text) != "")
    length = F.char_length(text).cast(docs.schema["n_chars"].dataType)
    return cut.where(left).withColumn(size, length).select(*restored(names))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document taken twice is there twice."""
    plain, names = numbered(docs)
    mixed = mixing.mix(plain, names["doc_id"], names["text"], names["source"])
    return mixing.repeated(mixed).select(*restored(names))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 4096 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

# Models, sampling and tokenizers are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
