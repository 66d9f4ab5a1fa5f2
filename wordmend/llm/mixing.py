"""Mixing sources to target weights by entropy balancing.

Every source gets a target number of words. Among all document rates that reach the targets and
stay within ``max_repeat``, the ones closest to 1 in relative entropy are
``min(max_repeat, exp(multiplier * size))``: one multiplier per source, found by Newton steps on
the convex dual. Rates are then rounded into whole copies.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a
document of size 0 is taken at the rate of its source, and adds no words; an empty table gives an
empty table; repeated rows are separate documents. Input columns named like an output column are
replaced, others are kept. Every choice depends on the rows' content only, so reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordmend.llm.columns import numbered, restored
from wordmend.runtime import stage

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEAT = 3
OUTPUT = ("size", "source_size", "target", "rate", "copies", "taken")

_SOURCE = ["_name", "_null"]  # null and the empty name are different sources
_WORD = r"[^\x20\x09-\x0D]+"
_STEPS = 60
_CORRECTIONS = 12
_NEAR = 0.001
_GROUP_ROWS = 1000
_GROUP_SHARE = 10_000


def text_size(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("bigint")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: int = MAX_REPEAT
) -> DataFrame:
    """``(source, source_size, target)`` from one row per source.

    Sources by code point, null last, take the weights in turn and share all words by them. A
    target stops at ``max_repeat`` times the source; the excess is shared again by weight. That
    is a water level: with sources in order of their stop per weight, the level that the rest
    would share rises as long as sources stop, and falls after that, so it is the highest one.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    stop = F.col("source_size") * F.lit(float(max_repeat))
    filling = Window.orderBy("_fill", F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    return (
        sizes.withColumn("_weight", F.element_at(F.array(*map(F.lit, map(float, weights))), turn + 1))
        .withColumn("_fill", stop / F.col("_weight"))
        .withColumn(
            "_level",
            (
                F.sum(F.col("source_size").cast("double")).over(everything)
                - F.coalesce(F.sum(stop).over(before), F.lit(0.0))
            )
            / F.sum("_weight").over(after),
        )
        .select(
            "source",
            "source_size",
            F.least(stop, F.col("_weight") * F.max("_level").over(everything)).alias("target"),
        )
    )


def _rate(multiplier: Column, size: Column, max_repeat: int) -> Column:
    """``min(max_repeat, exp(multiplier * size))``."""
    return F.exp(F.least(multiplier * size, F.log(F.lit(float(max_repeat)))))


def solve(cells: DataFrame, targets: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The multiplier of every source, by guarded Newton steps on the logarithm of the dual's
    gradient.

    ``cells`` has the number ``n`` of documents for every source and size. Each step is one
    distributed sum; only the number of unsolved sources comes back. A null multiplier means
    that every document is taken ``max_repeat`` times.
    """
    open_ended = F.lit(float("inf"))
    state = stage(
        targets.select(
            *_SOURCE,
            "target",
            (F.col("target") >= F.col("source_size") * float(max_repeat) * (1 - 1e-12)).alias("_full"),
            F.lit(0.0).alias("_x"),
            (-open_ended).alias("_lo"),
            open_ended.alias("_hi"),
            F.lit(False).alias("_done"),
        ).withColumn("_done", F.col("_full")),
        "mixing-state",
    )
    size = F.col("size").cast("double")
    for _ in range(_STEPS):
        rate = _rate(F.col("_x"), size, max_repeat)
        words = F.col("n") * size * rate
        free = F.col("_x") * size < math.log(max_repeat)
        sums = (
            cells.where("size > 0")
            .join(state.where(~F.col("_done")).select(*_SOURCE, "_x"), _SOURCE)
            .groupBy(*_SOURCE)
            .agg(
                F.sum(words).alias("_f"),
                F.sum(F.when(free, words * size).otherwise(0.0)).alias("_slope"),
            )
        )
        low, high = F.col("_f") < F.col("target"), F.col("_f") > F.col("target")
        lo = F.when(low, F.col("_x")).otherwise(F.col("_lo"))
        hi = F.when(high, F.col("_x")).otherwise(F.col("_hi"))
        newton = F.col("_x") - F.log(F.col("_f") / F.col("target")) * F.col("_f") / F.col("_slope")
        reach = F.greatest(F.abs("_x"), F.lit(1e-6))
        middle = (
            F.when((F.col("_lo") > -open_ended) & (F.col("_hi") < open_ended), (F.col("_lo") + F.col("_hi")) / 2)
            .when(F.col("_lo") > -open_ended, F.col("_lo") + reach)
            .otherwise(F.col("_hi") - reach)
        )
        inside = (F.col("_slope") > 0) & (newton > F.col("_lo")) & (newton < F.col("_hi"))
        solved = F.col("_f").isNull() | (F.abs(F.col("_f") - F.col("target")) <= 1e-8 * F.col("target"))
        state = stage(
            state.join(sums, _SOURCE, "left")
            .withColumns({"_lo": lo, "_hi": hi, "_done": F.col("_done") | solved})
            .withColumn("_x", F.when(F.col("_done"), F.col("_x")).when(inside, newton).otherwise(middle))
            .drop("_f", "_slope"),
            "mixing-state",
        )
        if not state.where(~F.col("_done")).head(1):
            break
    return state.select(
        *_SOURCE, F.when(~F.col("_full"), F.col("_x")).alias("multiplier")
    )


def _rounded(cells: DataFrame, max_repeat: int) -> DataFrame:
    """Whole numbers of copies ``total`` of all documents of a source and size.

    Along the sizes of a source, the running sum of the rates is rounded, so at most half a copy
    is ever owed. What is left is then given to, or taken from, the largest size that fits it,
    until it is within ``_NEAR`` of the target or no size fits.
    """
    by_size = Window.partitionBy(*_SOURCE).orderBy("size")
    owed = F.sum(F.col("n") * F.col("rate")).over(by_size)
    room = F.col("n") * max_repeat
    rounded = cells.withColumn("_owed", F.round(owed).cast("bigint")).withColumn(
        "total",
        F.greatest(
            F.lit(0),
            F.least(room, F.col("_owed") - F.coalesce(F.lag("_owed").over(by_size), F.lit(0))),
        ).cast("bigint"),
    )
    state = stage(rounded.drop("_owed"), "mixing-copies")
    for _ in range(_CORRECTIONS):
        missing = state.groupBy(*_SOURCE).agg(
            F.first("target").alias("target"),
            (F.first("target") - F.sum(F.col("total") * F.col("size"))).alias("_missing"),
        )
        missing = missing.where(F.abs("_missing") > _NEAR * F.col("target")).drop("target")
        near = state.join(missing, _SOURCE).withColumn(
            "_times", F.floor(F.abs("_missing") / F.col("size")).cast("bigint")
        )
        near = near.withColumn(
            "_move",
            F.when(F.col("_missing") > 0, F.least("_times", room - F.col("total")))
            .otherwise(-F.least("_times", "total"))
            .cast("bigint"),
        ).where((F.col("size") > 0) & (F.col("_move") != 0))
        best = near.groupBy(*_SOURCE).agg(
            F.max_by(F.struct("size", "_move"), "size").alias("_best")
        )
        if not best.head(1):
            break
        state = stage(
            state.join(best, _SOURCE, "left")
            .withColumn(
                "total",
                F.col("total")
                + F.when(F.col("size") == F.col("_best.size"), F.col("_best._move")).otherwise(0),
            )
            .drop("_best"),
            "mixing-copies",
        )
    return state


def mix(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    max_repeat: int = MAX_REPEAT,
) -> DataFrame:
    """The documents with ``size, source_size, target, rate, copies, taken``.

    ``copies`` says how often a document is taken (0 to ``max_repeat``), ``taken`` how many words
    that gives. ``repeated`` turns the result into the mixed rows.
    """
    plain, names = numbered(documents)
    origin = F.col(names[source])
    rows = plain.withColumns(
        {
            "size": text_size(F.col(names[text])),
            "_name": F.coalesce(origin, F.lit("")),
            "_null": origin.isNull(),
            "_order": F.xxhash64(F.col(names[key]).cast("string"), names[text]),
        }
    )
    slim = stage(rows.select("_name", "_null", "size", "_order"), "mixing-sizes")
    cells = stage(slim.groupBy("_name", "_null", "size").agg(F.count("*").alias("n")), "mixing-cells")
    sources = cells.groupBy("_name", "_null").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    named = sources.withColumn("source", F.when(~F.col("_null"), F.col("_name")))
    targets = stage(
        source_targets(named.select("source", "source_size"), weights, max_repeat).select(
            F.coalesce("source", F.lit("")).alias("_name"),
            F.col("source").isNull().alias("_null"),
            "source_size",
            "target",
        ),
        "mixing-targets",
    )
    multipliers = solve(cells, targets, max_repeat)
    rated = (
        cells.join(targets, _SOURCE)
        .join(multipliers, _SOURCE)
        .withColumn(
            "rate",
            F.coalesce(
                _rate(F.col("multiplier"), F.col("size").cast("double"), max_repeat),
                F.lit(float(max_repeat)),
            ),
        )
        .drop("multiplier")
    )
    copies = _rounded(rated, max_repeat)

    # A size with very many documents is divided by hash, so that no window holds it whole.
    limit = max(_GROUP_ROWS, (slim.count() + _GROUP_SHARE - 1) // _GROUP_SHARE)
    wide = cells.where(F.col("n") > limit).select(
        "_name", "_null", "size", F.ceil(F.col("n") / limit).cast("int").alias("_parts")
    )
    cell = ["_name", "_null", "size"]
    part = F.pmod("_order", F.coalesce("_parts", F.lit(1))).cast("int")

    def divided(table: DataFrame) -> DataFrame:
        return table.join(F.broadcast(wide), cell, "left").withColumn("_part", part).drop("_parts")

    along = Window.partitionBy(*cell).orderBy("_part")
    upto = F.floor(F.col("total") * F.col("_upto") / F.col("n")).cast("bigint")
    parts = (
        divided(slim)
        .groupBy(*cell, "_part")
        .agg(F.count("*").alias("_rows"))
        .join(copies, cell)
        .withColumn("_upto", F.sum("_rows").over(along))
        .withColumn("_here", upto - F.coalesce(F.lag(upto).over(along), F.lit(0)))
        .drop("_upto", "n", "total")
    )
    rank = F.row_number().over(Window.partitionBy(*cell, "_part").orderBy("_order"))
    extra = (rank <= F.col("_here") % F.col("_rows")).cast("bigint")
    return (
        divided(rows)
        .join(parts, [*cell, "_part"])
        .withColumn("copies", F.floor(F.col("_here") / F.col("_rows")) + extra)
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select(*restored(names, OUTPUT), *OUTPUT)
    )


def repeated(mixed: DataFrame) -> DataFrame:
    """Every row as often as its ``copies`` say, without the columns of ``mix``."""
    copy = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return mixed.where("copies > 0").withColumn("_copy", copy).drop("_copy", *OUTPUT)
