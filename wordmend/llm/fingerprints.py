"""Document fingerprints: I-Match over randomised lexicons.

The lexicon holds the words whose inverse document frequency lies in a band: not in more than
``MOST`` of all documents, nor in less than ``LEAST`` of them (or in one only). It has at most the
mean number of distinct words of a document divided by ``LEAST`` entries, at any number of
documents. A text is reduced to its distinct lexicon words in sorted order. Each of
``SUBSETS`` random subsets of the lexicon, on each of the levels ``SHARES``, keeps the words that
it has, and their hash is one part of the fingerprint. An edit changes the parts whose subset has
a changed word; on dense levels that is soon every part, on sparse levels many are empty, so the
likeness of two fingerprints is the share of equal parts on the level that shows most, empty ones
on both sides aside.

Defined results: a text without lexicon words has a fingerprint of its SHA-256, like only itself;
null is read as empty; equal texts have equal fingerprints; repeated rows are separate documents; a
row with a null key comes after all others, rows with equal keys are ordered by their text's hash;
the only document is its own next one; an empty table gives an empty table. Only the named columns
are used, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordmend.llm.words import mixed, slices, words
from wordmend.runtime import shuffle_tasks

LEAST, MOST = 0.001, 0.2
SHARES = (1 / 2, 1 / 8, 1 / 32, 1 / 128)
SUBSETS = 24

_ENOUGH = 4  # a level counts from so many parts on
_SEEDS = mixed(np.arange(1, len(SHARES) * SUBSETS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LIMITS = np.repeat([np.uint64(share * 2**32) for share in SHARES], SUBSETS)


# --- lexicon ---------------------------------------------------------------------------


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = []
        for part in slices(iter([batch])):
            found = words(part.column("text"))
            parts.extend(np.unique(found.of(row)) for row in range(len(part)))
        values, n = np.unique(np.concatenate(parts or [np.zeros(0, np.uint64)]), return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(values.view(np.int64)), pa.array(n)], names=["word", "n"]
        )


def lexicon(texts: DataFrame) -> np.ndarray:
    """Sorted hashes of the words in the band, from all of ``texts (text)``."""
    documents = texts.count()
    counts = texts.mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    band = counts.where(
        (F.col("n") >= max(2, LEAST * documents)) & (F.col("n") <= max(2, MOST * documents))
    )
    column = band.select("word").toArrow().column("word").to_numpy()
    return np.sort(column.astype(np.int64).view(np.uint64))


# --- fingerprints ----------------------------------------------------------------------


def parts_of(terms: np.ndarray) -> np.ndarray:
    """The parts for a text's distinct lexicon words; 0 if a subset has none of them."""
    parts = np.zeros(len(_SEEDS), np.uint64)
    seen = np.zeros(len(_SEEDS), bool)
    for first in range(0, len(terms), 4096):
        value = mixed(terms[None, first : first + 4096] ^ _SEEDS[:, None])
        inside = (value & np.uint64(0xFFFFFFFF)) < _LIMITS[:, None]
        seen |= inside.any(1)
        parts += np.where(inside, value >> np.uint64(7), np.uint64(0)).sum(1, dtype=np.uint64)
    return np.where(seen, mixed(parts) % np.uint64(0xFFFF) + np.uint64(1), 0).astype(">u2")


def fingerprint(text: bytes, found: np.ndarray, lexicon: np.ndarray) -> str:
    """From a text and the hashes of its words."""
    if len(lexicon) and len(found):
        distinct = np.unique(found)
        at = np.minimum(np.searchsorted(lexicon, distinct), len(lexicon) - 1)
        terms = distinct[lexicon[at] == distinct]
        if len(terms):
            return parts_of(terms).tobytes().hex()
    return "text-" + hashlib.sha256(text).hexdigest()


def likeness(a: str, b: str) -> float:
    """0 to 1: equal parts on the most telling level."""
    if a == b:
        return 1.0
    if len(a) != len(b) or a.startswith("text-") or b.startswith("text-"):
        return 0.0
    left, right = (np.frombuffer(bytes.fromhex(x), ">u2").reshape(len(SHARES), SUBSETS) for x in (a, b))
    filled = ((left != 0) | (right != 0)).sum(1)
    equal = ((left == right) & (left != 0)).sum(1)
    told = filled >= _ENOUGH
    return float((equal[told] / filled[told]).max()) if told.any() else 0.0


def fingerprints(
    documents: DataFrame, key: str = "doc_id", text: str = "text", lexicon_words: np.ndarray | None = None
) -> DataFrame:
    """``(key, fingerprint)`` of every document."""
    rows = documents.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    chosen = lexicon(rows.select("text")) if lexicon_words is None else lexicon_words
    sent = documents.sparkSession.sparkContext.broadcast(chosen)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(_fingerprints(batch.column("text"), sent.value))],
                names=["key", "fingerprint"],
            )

    schema = T.StructType(
        [
            T.StructField("key", documents.schema[key].dataType),
            T.StructField("fingerprint", T.StringType()),
        ]
    )
    return rows.mapInArrow(make, schema).withColumnRenamed("key", key)


def _fingerprints(column: pa.Array, chosen: np.ndarray) -> list[str]:
    found = words(column)
    raw = found.data
    return [
        fingerprint(raw[found.offsets[i] : found.offsets[i + 1]].tobytes(), found.of(i), chosen)
        for i in range(len(column))
    ]


# --- every document with the next one --------------------------------------------------


def _find(splits: list[int], value: Column) -> Column:
    """How many of the ascending ``splits`` are at most ``value``, by halving."""
    steps = [1 << k for k in range(max(1, len(splits)).bit_length() - 1, -1, -1)]
    ascending = F.array(*map(F.lit, splits)).cast("array<bigint>")
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, step: F.when(F.get(ascending, at + step - 1) <= value, at + step).otherwise(at),
    )


def beside_next(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, text, stretch, ahead)``, partitioned and sorted so that every row that is not
    ``ahead`` is followed by the document that comes next in descending order of the key.

    Keys (integers) are divided into stretches at approximate quantiles. The largest key of each
    stretch follows the stretch above it once more as ``ahead``, and the very first document
    follows the last one, so no task needs to know another.
    """
    spark = documents.sparkSession
    low = -(1 << 63)
    rows = documents.select(
        F.col(key).alias("key"),
        F.coalesce(text, F.lit("")).alias("text"),
        F.coalesce(F.col(key).cast("bigint"), F.lit(low)).alias("at"),
    )
    tasks = shuffle_tasks(spark)
    shares = F.array(*(F.lit(i / tasks) for i in range(1, tasks)))
    found = rows.agg(F.percentile_approx("at", shares, F.lit(20 * tasks)).alias("q")).first().q
    splits = sorted(set(found or [])) or [low]
    stretch = _find(splits, F.col("at"))
    tops = {r.stretch: r.top for r in rows.groupBy(stretch.alias("stretch")).agg(F.max("at").alias("top")).collect()}
    order = sorted(tops)
    follows = [(tops[s], order[(i + 1) % len(order)]) for i, s in enumerate(order)]
    ahead = spark.createDataFrame(follows, "at bigint, above int")
    # One row for each stretch: broadcast.
    return (
        rows.withColumn("stretch", stretch)
        .join(F.broadcast(ahead), "at", "left")
        .withColumn(
            "to",
            F.explode(
                F.when(
                    F.col("above").isNotNull(),
                    F.array(
                        F.struct(F.col("stretch").alias("stretch"), F.lit(False).alias("ahead")),
                        F.struct(F.col("above").alias("stretch"), F.lit(True).alias("ahead")),
                    ),
                ).otherwise(
                    F.array(F.struct(F.col("stretch").alias("stretch"), F.lit(False).alias("ahead")))
                )
            ),
        )
        .select("key", "text", "at", "to.stretch", "to.ahead")
        .repartition(tasks, "stretch")
        .sortWithinPartitions("stretch", "ahead", F.desc("at"), F.xxhash64("text"))
        .select("key", "text", "stretch", "ahead")
    )


def edited(text: str, following: str) -> str:
    """The last third replaced with as much of the beginning of the following text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def compare_edits(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``
    of every document."""
    chosen = lexicon(documents.select(F.coalesce(text, F.lit("")).alias("text")))
    sent = documents.sparkSession.sparkContext.broadcast(chosen)
    schema = T.StructType(
        [
            T.StructField("key", documents.schema[key].dataType),
            T.StructField("n_chars", T.LongType()),
            T.StructField("edited_sha256", T.StringType()),
            T.StructField("fingerprint", T.StringType()),
            T.StructField("edited_fingerprint", T.StringType()),
            T.StructField("near_edited", T.DoubleType()),
            T.StructField("near_next", T.DoubleType()),
        ]
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far, which waits for the next one
        for batch in slices(batches):
            rows = list(
                zip(
                    batch.column("key").to_pylist(),
                    batch.column("text").to_pylist(),
                    batch.column("stretch").to_pylist(),
                    batch.column("ahead").to_pylist(),
                    _fingerprints(batch.column("text"), sent.value),
                    strict=True,
                )
            )
            rows = [held, *rows] if held else rows
            held = rows[-1]
            pairs = [
                (row, after)
                for row, after in zip(rows, rows[1:], strict=False)
                if not row[3] and row[2] == after[2]
            ]
            changed = [edited(row[1], after[1]) for row, after in pairs]
            prints = _fingerprints(pa.array(changed, pa.string()), sent.value)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row[0] for row, _ in pairs], batch.column("key").type),
                    pa.array([len(row[1]) for row, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed], pa.string()),
                    pa.array([row[4] for row, _ in pairs], pa.string()),
                    pa.array(prints, pa.string()),
                    pa.array(
                        [likeness(row[4], p) for (row, _), p in zip(pairs, prints, strict=True)],
                        pa.float64(),
                    ),
                    pa.array([likeness(row[4], after[4]) for row, after in pairs], pa.float64()),
                ],
                names=schema.names,
            )

    return beside_next(documents, key, text).mapInArrow(compare, schema).withColumnRenamed("key", key)
