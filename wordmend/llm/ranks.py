"""Ranks inside groups of which one may hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A group with more rows than both is divided: no window holds more than about that many.
PART_ROWS = 1000
PART_SHARE = 10_000


def ranked(rows: DataFrame, by: Sequence[str], order: Column, name: str) -> DataFrame:
    """``rows`` with the rank (from 0) inside the groups ``by`` (not null), as column ``name``.

    Groups are divided by the 64-bit hash ``order``; the parts' first ranks are running sums over
    the counts of the parts. That table and the list of wide groups have at most one row for
    each group and ``PART_SHARE`` more. Equal hashes are ranked in any order.
    """
    keyed = rows.withColumn("_order", order)
    limit = max(PART_ROWS, -(-rows.count() // PART_SHARE))
    wide = (
        rows.groupBy(*by)
        .agg(F.count("*").alias("_n"))
        .where(F.col("_n") > limit)
        .select(*by, F.ceil(F.col("_n") / limit).cast("int").alias("_parts"))
    )
    part = F.pmod("_order", F.coalesce("_parts", F.lit(1))).cast("int")
    divided = keyed.join(F.broadcast(wide), [*by], "left").withColumn("_part", part).drop("_parts")
    group = [*by, "_part"]
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = (
        divided.groupBy(*group)
        .agg(F.count("*").alias("_n"))
        .select(*group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    )
    inside = F.row_number().over(Window.partitionBy(*group).orderBy("_order"))
    return (
        divided.join(first, group)
        .withColumn(name, F.col("_first") + inside - 1)
        .drop("_order", "_part", "_first")
    )
