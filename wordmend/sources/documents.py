"""Documents: files or tables with a text column, and their file types."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordmend.functions.patterns import MARKDOWN_EXTENSIONS, SOURCE_EXTENSIONS
from wordmend.runtime import is_small, stage

MARKDOWN = "markdown"
SOURCE_CODE = "source_code"
PLAIN_TEXT = "plain_text"


def read_documents(spark: SparkSession, paths: str | Iterable[str]) -> DataFrame:
    """Files, folders or globs as ``documents(path, text)``, one row per file.

    Paths that do not exist are skipped with a warning; if none exists, the table is empty.
    """
    wanted = [paths] if isinstance(paths, str) else list(paths)
    try:
        files = spark.read.text(wanted, wholetext=True)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        found = _existing(spark, wanted)
        if not found:
            return spark.createDataFrame([], "path string, text string")
        files = spark.read.text(found, wholetext=True)
    return files.select(_decoded("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def files_as_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder as a stream of ``documents(path, text)``, each read once."""
    files = spark.readStream.schema("value string").text(folder, wholetext=True)
    return files.select(_decoded("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _decoded(path: str) -> Column:
    """A path that is given as a URI, in which a plus sign stands for itself."""
    return F.url_decode(F.replace(F.col(path), F.lit("+"), F.lit("%2B")))


def _existing(spark: SparkSession, paths: list[str]) -> list[str]:
    found = []
    for path in paths:
        try:
            spark.read.text(path)
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            warnings.warn(f"File not found: {path}", stacklevel=3)
        else:
            found.append(path)
    return found


_BOM = "\ufeff"
_PLACED = "path string, block bigint, text string, nth bigint, at bigint"


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of each line within its block, and the bytes before it there."""
    now, lines, size = None, 0, 0
    for batch in batches:
        if not len(batch):
            continue
        paths, blocks = batch.column("path"), batch.column("block")
        sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        keys = pc.binary_join_element_wise(blocks.cast(pa.string()), paths, " ").to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(batch)]
        nth, at = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
        for first, last in zip(edges, edges[1:], strict=False):
            if keys[first] != now:
                now, lines, size = keys[first], 0, 0
            ends = size + np.cumsum(sizes[first:last])
            nth[first:last] = lines + np.arange(last - first)
            at[first:last] = ends - sizes[first:last]
            lines, size = lines + last - first, int(ends[-1])
        yield pa.RecordBatch.from_arrays(
            [paths, blocks, batch.column("text"), pa.array(nth), pa.array(at)],
            names=["path", "block", "text", "nth", "at"],
        )


def read_lines(spark: SparkSession, paths: str | Iterable[str], pieces: bool = False) -> DataFrame:
    """Files of any size as ``(path, line, line_start, text)``, one row for each line.

    Files are read in blocks, each by a task of its own, which ends with a whole line. A first pass
    counts lines and bytes of the blocks; what stands before a block is the sum over those in
    front of it. A second pass numbers the lines within the blocks and adds that. Lines end at
    ``\\n``; a byte order mark stays in front of the first one.

    With ``pieces`` all files of a folder are one, in the order of their names, and end with whole lines.
    ``path`` is the folder's, lines and bytes are counted through all pieces. So a file need not be
    written by one task.
    """
    wanted = [paths] if isinstance(paths, str) else list(paths)
    raw = spark.read.option("lineSep", "\n").text(wanted)
    blocks = raw.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"),
        F.col("value").alias("text"),
    )
    sums = blocks.groupBy("path", "block", "size").agg(
        F.count("*").alias("lines"), F.sum(F.octet_length("text") + 1).alias("bytes")
    )
    # The reader leaves a byte order mark out, so that bytes are missing at the end.
    missing = F.col("size") - F.sum("bytes").over(Window.partitionBy("path"))
    mark = F.when((F.col("block") == 0) & (missing >= 2), 3).otherwise(0)
    whole = F.regexp_extract("path", "^(.*)/", 1) if pieces else F.col("path")
    sums = sums.select("*", _decoded("path").alias("name"), whole.alias("whole"), mark.alias("mark"))
    order = Window.partitionBy("whole").orderBy("name", "block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    bases = stage(
        sums.select(
            "path",
            "block",
            "whole",
            F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("lines_before"),
            F.coalesce(F.sum(F.col("bytes") + F.col("mark")).over(before), F.lit(0)).alias("bytes_before"),
            "mark",
        ),
        "blocks",
    )
    placed = blocks.drop("size").mapInArrow(_place, _PLACED)
    known = F.broadcast(bases) if is_small(bases) else bases
    is_first = F.col("nth") == 0
    start = F.col("bytes_before") + F.col("at") + F.when(is_first, 0).otherwise(F.col("mark"))
    text = F.when(is_first & (F.col("mark") > 0), F.concat(F.lit(_BOM), F.col("text")))
    return placed.join(known, ["path", "block"]).select(
        _decoded("whole").alias("path"),
        (F.col("lines_before") + F.col("nth") + 1).alias("line"),
        start.alias("line_start"),
        F.coalesce(text, F.col("text")).alias("text"),
    )


def spread(documents: DataFrame, rounds: int = 1) -> DataFrame:
    """Give every core work when a table is read in fewer parts than there are cores.

    Tokenizing happens where a document was read, and a small table is often one row group.
    Big files are read in many parts, so no table of more than about
    ``spark.sql.files.maxPartitionBytes`` for each core is ever shuffled.

    With ``rounds`` a table is also dealt out if it has fewer parts than that many for each core: 16 parts
    keep 12 cores waiting for the last four, and parts without a row group are counted too. For steps
    whose time is in the CPU; at most ``rounds`` times as much text is shuffled.
    """
    tasks = documents.sparkSession.sparkContext.defaultParallelism
    if documents.rdd.getNumPartitions() >= rounds * tasks:
        return documents
    return documents.repartition((3 + rounds) * tasks)


def extension(path: Column) -> Column:
    """Lower-cased extension; empty for none and for dot files."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def file_type(path: Column) -> Column:
    """``markdown``, ``source_code`` or ``plain_text``."""
    ext = extension(path)
    code = [e for group in SOURCE_EXTENSIONS.values() for e in group]
    return (
        F.when(ext.isin(*MARKDOWN_EXTENSIONS), MARKDOWN)
        .when(ext.isin(*code), SOURCE_CODE)
        .otherwise(PLAIN_TEXT)
    )


def source_lang(path: Column) -> Column:
    """The programming language of a source file, else null."""
    ext = extension(path)
    lang = F.lit(None).cast("string")
    for name, group in SOURCE_EXTENSIONS.items():
        lang = F.when(ext.isin(*group), name).otherwise(lang)
    return lang
