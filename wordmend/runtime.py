"""How the jobs meet the cluster: staging, checked broadcasts and skew-proof joins."""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only after its rows and text were measured to be below these.
BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 128 << 20
# What a row takes in a broadcast table beside its text.
_ROW_BYTES = 100

_TASKS_PER_SLOT = 3
# Text of a task whose words are gathered or sorted: they take twenty times as much in memory.
_DEALT_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder staged tables go to: ``spark.checkpoint.dir``, which all executors reach."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return folder


def stage(df: DataFrame, name: str, packed: bool = False) -> DataFrame:
    """Write ``df`` once and read it back.

    Used where a result feeds several later steps: the text is scanned once, a lost
    executor repeats only its own tasks, and readers still prune columns. ``packed`` is for
    words with contexts: those of neighbours overlap, which Zstandard uses better than the usual codec.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd" if packed else None)
    return spark.read.schema(df.schema).parquet(path)


def _sizes(df: DataFrame) -> tuple[Column, Column]:
    """Aggregates: rows of a table and the bytes they take when broadcast."""
    text = F.lit(_ROW_BYTES).cast("bigint")
    for name, kind in df.dtypes:
        if kind == "string":
            text = text + F.coalesce(F.octet_length(name), F.lit(0))
        elif kind == "array<string>":
            text = text + F.coalesce(F.octet_length(F.array_join(name, "")), F.lit(0))
    return F.count("*"), F.coalesce(F.sum(text), F.lit(0))


def measure(df: DataFrame) -> tuple[int, int]:
    """Rows of a table and the bytes they take when broadcast."""
    return tuple(df.agg(*_sizes(df)).first())


def fits(size: tuple[int, int]) -> bool:
    """May a table of this size be broadcast?"""
    return size[0] <= BROADCAST_ROWS and size[1] <= BROADCAST_BYTES


def is_small(df: DataFrame) -> bool:
    """Measure a table: may it be broadcast?"""
    return fits(measure(df))


def shuffle_tasks(spark: SparkSession) -> int:
    """Partitions for steps whose work is not proportional to their bytes.

    The number differs from that of ordinary shuffles: Spark would drop a repartitioning that
    an aggregate seems to provide already, and adaptive execution would then merge its
    partitions by size.
    """
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(usual, _TASKS_PER_SLOT * spark.sparkContext.defaultParallelism)
    return wanted + 1 if wanted == usual else wanted


def dealt_tasks(documents: DataFrame, text: str) -> int:
    """Partitions of so much text that the words of one are sorted in memory."""
    size = documents.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(shuffle_tasks(documents.sparkSession), math.ceil(size / _DEALT_BYTES))


_SAMPLED = 20  # keys for each range


def in_ranges(documents: DataFrame, keys: Sequence[str], tasks: int, name: str) -> DataFrame:
    """Add the column ``name``: ``repartition(tasks, name)`` puts the n-th range of keys into the n-th
    partition.

    Unlike ``repartitionByRange`` this can be done to two tables with the same ranges. The bounds
    come from a sample of the keys; a partition is hit by a number whose hash leads there.
    """
    spark = documents.sparkSession
    rows = documents.count()
    share = min(1.0, _SAMPLED * tasks / max(1, rows))
    place, size = F.struct(*keys), 64
    drawn = documents.select(place.alias("_k")).sample(share, 7) if share < 1 else documents.select(place.alias("_k"))
    every = F.greatest(F.lit(1), F.floor(F.size("_all") / tasks)).cast("int")
    listed = drawn.agg(F.array_sort(F.collect_list("_k")).alias("_all")).select(
        F.slice(F.filter("_all", lambda x, i: (i > 0) & (i % every == 0)), 1, tasks - 1).alias("_bounds")
    )
    hits: dict[int, int] = {}
    tried = 0
    while len(hits) < tasks:
        some = spark.range(tried, tried + 16 * tasks)
        for number, hit in some.select("id", F.pmod(F.hash("id"), F.lit(tasks))).collect():
            hits.setdefault(hit, number)
        tried += 16 * tasks
    numbers = spark.createDataFrame([([hits[i] for i in range(tasks)],)], "_numbers array<bigint>")
    coarse = F.filter("_bounds", lambda x, i: i % size == size - 1).alias("_coarse")
    bounds = stage(listed.crossJoin(numbers).select("*", coarse), "ranges")
    blocks = F.size(F.filter("_coarse", lambda x: x <= place))
    near = F.slice("_bounds", blocks * size + 1, size)
    nth = blocks * size + F.size(F.filter(near, lambda x: x <= place))
    found = documents.crossJoin(F.broadcast(bounds)).withColumn(name, F.get("_numbers", nth))
    return found.select(*documents.columns, name)


def salted_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    count: str,
    spread: Sequence[Column],
    how: str = "inner",
) -> DataFrame:
    """Join many rows with a table that has each key ``on`` once (keys are not null).

    ``count`` is the column of ``lookup`` with the number of fact rows of the key. A key with
    more rows than a task's even share is spread over several tasks by a hash of ``spread``.
    No more keys than tasks can be that heavy, so their list is small at any size.
    """
    total = lookup.agg(F.sum(count)).first()[0] or 0
    share = max(1, total // shuffle_tasks(facts.sparkSession))
    heavy = lookup.where(F.col(count) > share).select(
        *on, F.ceil(F.col(count) / share).cast("int").alias("_copies")
    )
    copies = F.coalesce("_copies", F.lit(1))
    left = facts.join(F.broadcast(heavy), [*on], "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*spread), copies).cast("int")
    )
    right = lookup.join(F.broadcast(heavy), [*on], "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), copies - 1))
    )
    return left.drop("_copies").join(right.drop("_copies"), [*on, "_salt"], how).drop("_salt")


# Cells that the pairs of a task's even share are divided into at least, so that they even out.
_CELLS_PER_TASK = 16


def two_sided_join(
    left: DataFrame, right: DataFrame, key: str, left_spread: Sequence[Column], right_spread: Sequence[Column]
) -> DataFrame:
    """Inner join on ``key`` (not null), which may have many rows on both sides.

    The pairs of a key are a rectangle. One with more pairs than a share is divided into a grid:
    its left rows are split by a hash of ``left_spread`` into as many parts as the grid has
    rows and copied to all of its columns, its right rows the other way round, so that every cell
    is a group of its own. The grid has the shape that copies the fewest rows. No more keys
    than there are shares can be that large, so their list is small at any size.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("_l")).join(
        right.groupBy(key).agg(F.count("*").alias("_r")), key
    )
    pairs = stage(counts.withColumn("_pairs", F.col("_l").cast("double") * F.col("_r")), "join-sizes")
    total = pairs.agg(F.sum("_pairs")).first()[0] or 0.0
    share = max(1.0, total / (_CELLS_PER_TASK * shuffle_tasks(left.sparkSession)))
    cells = F.col("_pairs") / share
    rows = F.greatest(F.lit(1.0), F.least(F.col("_l"), F.sqrt(cells * F.col("_l") / F.col("_r"))))
    grid = (
        pairs.where(F.col("_pairs") > share)
        .withColumn("_rows", F.ceil(rows).cast("int"))
        .withColumn("_columns", F.ceil(F.greatest(F.lit(1.0), cells / F.col("_rows"))).cast("int"))
        .select(key, "_rows", "_columns")
    )

    def dealt(side: DataFrame, spread: Sequence[Column], own: str, copied: str) -> DataFrame:
        part = F.pmod(F.xxhash64(*spread), F.coalesce(own, F.lit(1))).cast("int")
        others = F.sequence(F.lit(0), F.coalesce(copied, F.lit(1)) - 1)
        return (
            side.join(F.broadcast(grid), key, "left")
            .withColumn(f"{own}_at", part)
            .withColumn(f"{copied}_at", F.explode(others))
            .drop("_rows", "_columns")
        )

    # The work is in the pairs, not in the bytes, by which Spark would merge partitions.
    tasks, cell = shuffle_tasks(left.sparkSession), [key, "_rows_at", "_columns_at"]
    return (
        dealt(left, left_spread, "_rows", "_columns")
        .repartition(tasks, *cell)
        .join(dealt(right, right_spread, "_columns", "_rows").repartition(tasks, *cell), cell)
        .drop(*cell[1:])
    )


_LEVELS = 8  # classes of counts to a doubling


def frequent_rows(lookup: DataFrame, count: str) -> Column | None:
    """Which rows of ``lookup`` have the highest counts, as many as may be broadcast together.

    Only sums over classes of counts reach the driver, a few hundred at any size.
    """
    level = F.floor(F.log2(F.greatest(F.col(count), F.lit(1))) * _LEVELS)
    sizes = lookup.groupBy(level.alias("_level")).agg(*(s.alias(n) for s, n in zip(_sizes(lookup), "rb", strict=True)))
    rows = size = 0
    least = None
    for found in sorted(sizes.collect(), key=lambda row: -row._level):
        rows, size = rows + found.r, size + found.b
        if not fits((rows, size)):
            break
        least = found._level
    return None if least is None else level >= least


def join_by_key(
    facts: DataFrame, lookup: DataFrame, key: str, count: str, spread: list[Column]
) -> DataFrame:
    """Inner join of many rows with a table that has ``key`` once.

    It is broadcast if it is small. Otherwise its most frequent rows are, and only the facts of the
    others are shuffled: of words, few. ``facts`` are then read twice, so they should be staged.
    """
    if is_small(lookup):
        return facts.join(F.broadcast(lookup), key)
    frequent = frequent_rows(lookup, count)
    if frequent is None:
        return salted_join(facts, lookup, [key], count, spread)
    head = F.broadcast(lookup.where(frequent))
    others = facts.join(F.broadcast(lookup.where(frequent).select(key)), key, "left_anti")
    return facts.join(head, key).unionByName(
        salted_join(others, lookup.where(~frequent), [key], count, spread)
    )
