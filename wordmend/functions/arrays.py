"""Array expressions used to keep token positions inside one row."""

from __future__ import annotations

import functools
import weakref
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_built: weakref.WeakKeyDictionary[Any, dict] = weakref.WeakKeyDictionary()


def built_once(build: Callable[..., Any]) -> Callable[..., Any]:
    """For expressions of column names and options: built once for each Spark context.

    A large expression takes thousands of calls to the JVM, more time than small tables need.
    """

    @functools.wraps(build)
    def column(*names: object) -> Any:
        session = SparkSession.getActiveSession()
        if session is None:
            return build(*names)
        known = _built.setdefault(session.sparkContext, {})
        key = (build.__module__, build.__qualname__, names)
        if key not in known:
            known[key] = build(*names)
        return known[key]

    return column


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    An expression that is mentioned inside a lambda is evaluated for every element;
    binding it to a lambda variable first keeps it at one evaluation per row.
    """
    return F.transform(F.array(value), body).getItem(0)


_BLOCK = 16
_LEVELS = 4


def running_starts(lengths: Column) -> Column:
    """The sum of the elements before each element of an int array.

    Appending to an array copies it, so one long fold would be quadratic. The array is folded in
    blocks of a constant size, their totals in blocks again, and so on. The totals of the last level are
    folded as they are: of 16 million elements these are 4,096. Small blocks are copied less.
    """
    zero = F.array(F.lit(0))

    def add(acc: Column, x: Column) -> Column:
        return F.array_append(acc, F.element_at(acc, -1) + x)

    def fold(a: Column) -> Column:
        """0, then the running sums."""
        return F.aggregate(a, zero, add)

    def blocks(a: Column) -> Column:
        last = F.ceil(F.size(a) / _BLOCK).cast("int") - 1
        return F.transform(
            F.sequence(F.lit(0), last), lambda k: fold(F.slice(a, k * _BLOCK + 1, _BLOCK))
        )

    def sums(a: Column, levels: int) -> Column:
        """At least the sum before each element, and some of what follows."""
        if levels == 1:
            return fold(a)
        return F.when(F.size(a) <= _BLOCK, fold(a)).otherwise(
            let(blocks(a), lambda parts: shifted(parts, levels))
        )

    def shifted(parts: Column, levels: int) -> Column:
        totals = F.transform(parts, lambda x: F.element_at(x, -1))
        return let(
            let(totals, lambda t: sums(t, levels - 1)),
            lambda base: F.flatten(
                F.transform(
                    parts,
                    lambda x, k: F.transform(
                        F.slice(x, F.lit(1), F.size(x) - 1), lambda v: v + F.get(base, k)
                    ),
                )
            ),
        )

    def body(a: Column) -> Column:
        return F.slice(sums(a, _LEVELS), F.lit(1), F.size(a))

    return let(lengths, body)


def matches_and_gaps(text: Column, pattern: str) -> tuple[Column, Column]:
    """All matches of ``pattern`` and the text between them.

    There is always exactly one gap more than there are matches, so
    ``gap[0] match[0] gap[1] … gap[n]`` spells the input again.
    """
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def piece_lengths(gaps: Column, matches: Column) -> Column:
    """Bytes of each gap together with the match that follows it."""
    return F.zip_with(
        gaps,
        matches,
        lambda g, m: F.octet_length(g) + F.coalesce(F.octet_length(m), F.lit(0)),
    )
