"""String expressions: masking, byte slices, contexts and rewriting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from wordmend.functions.arrays import let, matches_and_gaps

CONTEXT_CHARS = 20
# A slice of this many bytes holds at least CONTEXT_CHARS + 1 whole characters.
CONTEXT_BYTES = 4 * (CONTEXT_CHARS + 1)


def blank(text: Column) -> Column:
    """Spaces of the same byte length; newlines stay."""
    def spaces(part: Column) -> Column:
        return F.repeat(F.lit(" "), F.octet_length(part))

    # By whole lines: a regular expression would replace character by character.
    several = F.array_join(F.transform(F.split(text, "\n", -1), spaces), "\n")
    return F.when(F.contains(text, F.lit("\n")), several).otherwise(spaces(text))


def without_return(line: Column) -> Column:
    """A line without its final carriage return."""
    last = F.char_length(line) - 1
    return F.when(F.endswith(line, F.lit("\r")), F.substring(line, F.lit(1), last)).otherwise(line)


def mask(
    text: Column,
    pattern: str,
    change: Callable[[Column], Column] = blank,
    hint: str | None = None,
) -> Column:
    """Pass every match of ``pattern`` through ``change`` (default: blank it).

    ``hint`` is a piece of text every match must contain; rows without it skip the regex.
    """

    def apply(t: Column) -> Column:
        found, gaps = matches_and_gaps(t, pattern)
        masked = F.array_join(
            F.zip_with(
                gaps, found, lambda g, m: F.concat(g, F.coalesce(change(m), F.lit("")))
            ),
            "",
        )
        return masked if hint is None else F.when(F.contains(t, F.lit(hint)), masked).otherwise(t)

    return let(text, apply)


def before(raw: Column, at: Column) -> Column:
    """Up to 21 characters in front of byte ``at`` of a line.

    Cutting by bytes first keeps the cost independent of the line's length.
    """
    first = F.greatest(at - CONTEXT_BYTES, F.lit(0))
    near = F.substring(raw, first + 1, at - first).cast("string")
    return F.substring(near, -CONTEXT_CHARS - 1, CONTEXT_CHARS + 1)


def after(raw: Column, at: Column) -> Column:
    """Up to 21 characters from byte ``at`` of a line on, without a final carriage return."""
    near = F.substring(raw, at + 1, F.lit(CONTEXT_BYTES)).cast("string")
    whole = F.when(
        F.endswith(near, F.lit("\r")), F.substring(near, F.lit(1), F.char_length(near) - 1)
    ).otherwise(near)
    return F.substring(whole, 1, CONTEXT_CHARS + 1)


def short_context(left: Column, word: Column, right: Column, both_ends: Column) -> Column:
    """A word with up to 20 characters on both sides, and ``...`` where text was cut.

    Plain text marks both cut ends; Markdown marks the left one, or else the right one.
    ``left`` and ``right`` are those of ``before`` and ``after``.
    """
    dots = F.lit("...")
    cut_left = F.char_length(left) > CONTEXT_CHARS
    cut_right = F.char_length(right) > CONTEXT_CHARS
    short = F.substring(right, 1, CONTEXT_CHARS)
    return F.concat(
        F.when(cut_left, F.concat(dots, F.substring(left, 2, CONTEXT_CHARS))).otherwise(left),
        word,
        F.when(cut_right & (both_ends | ~cut_left), F.concat(short, dots)).otherwise(short),
    )


def replace_ranges(text: Column, edits: Column) -> Column:
    """Rewrite byte ranges of ``text``.

    ``edits`` is an array of structs ``(start, end, new)`` sorted by start and free of
    overlaps. Slicing the binary form makes the cost linear in text and edits together.
    """

    def rebuild(s: Column) -> Column:
        def piece(e: Column, k: Column) -> Column:
            before = F.when(k > 0, F.get(s.e, k - 1).getField("end")).otherwise(F.lit(0))
            return F.concat(
                F.substring(s.raw, before + 1, e.getField("start") - before).cast("string"),
                e.getField("new"),
            )

        last = F.element_at(s.e, -1).getField("end")
        tail = F.substring(s.raw, last + 1, F.octet_length(s.raw) - last).cast("string")
        return F.concat(F.array_join(F.transform(s.e, piece), ""), tail)

    both = F.struct(text.cast("binary").alias("raw"), edits.alias("e"))
    return F.when(F.size(edits) > 0, let(both, rebuild)).otherwise(text)
