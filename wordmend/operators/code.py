"""Source code: the comments and string literals of one line as checkable fragments.

A fragment is a struct ``(at, text, base, base_at, whole)``: the byte offset of ``text`` in its
line, the text to take words from, the text their context is taken from, the byte offset of
``text`` in that, and whether that is the context as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wordmend.functions.arrays import let, matches_and_gaps, piece_lengths, running_starts
from wordmend.functions.patterns import C_STRING, ESCAPE_PAIR, PYTHON_STRING
from wordmend.functions.text import mask, without_return

NO_FRAGMENTS = "array<struct<at:int,text:string,base:string,base_at:int,whole:boolean>>"


def fragment(
    at: Column, text: Column, base: Column, base_at: Column | None = None, whole: bool = True
) -> Column:
    return F.named_struct(
        F.lit("at"),
        at.cast("int"),
        F.lit("text"),
        text,
        F.lit("base"),
        base,
        F.lit("base_at"),
        F.lit(0) if base_at is None else base_at.cast("int"),
        F.lit("whole"),
        F.lit(whole),
    )


def _none() -> Column:
    return F.array().cast(NO_FRAGMENTS)


def _tail(line: Column, chars: Column) -> Column:
    """The comment that follows the first ``chars`` characters of a line."""
    return let(
        F.substring(line, chars + 1, F.char_length(line)),
        lambda t: F.array(fragment(F.octet_length(line) - F.octet_length(t), t, t)),
    )


def c_comments(line: Column) -> Column:
    """Text after the first ``//``."""
    return F.when(
        F.contains(line, F.lit("//")), _tail(line, F.instr(line, "//") + 1)
    ).otherwise(_none())


def python_comments(line: Column) -> Column:
    """Text after the first ``#`` if an even number of quotes stands before it."""

    def body(before: Column) -> Column:
        quotes = F.char_length(before) - F.char_length(F.translate(before, "\"'", ""))
        return F.when(quotes % 2 == 0, _tail(line, F.char_length(before) + 1)).otherwise(_none())

    return F.when(
        F.contains(line, F.lit("#")),
        let(F.substring_index(line, "#", 1), body),
    ).otherwise(_none())


def _literals(line: Column, pattern: str) -> Column:
    """String literals. An escape pair is a gap between words."""

    def one(literal: Column, start: Column) -> Column:
        inner = F.when(
            F.startswith(literal, F.lit('"')),
            F.regexp_extract(literal, r'(?s)\A"((?:[^"\\]++|\\.)*+)', 1),
        ).otherwise(F.regexp_extract(literal, r"(?s)\A'((?:[^'\\]++|\\.)*+)", 1))
        # The context is the literal without its quotes: its text begins one byte earlier.
        return fragment(start, mask(literal, ESCAPE_PAIR, hint="\\"), inner, F.lit(-1))

    def body(s: Column) -> Column:
        return F.zip_with(
            s.found,
            F.zip_with(
                F.slice(s.gaps, F.lit(1), F.size(s.found)),
                F.slice(s.starts, F.lit(1), F.size(s.found)),
                lambda g, st: st + F.octet_length(g),
            ),
            one,
        )

    found, gaps = matches_and_gaps(line, pattern)
    parts = F.struct(
        found.alias("found"),
        gaps.alias("gaps"),
        running_starts(piece_lengths(gaps, found)).alias("starts"),
    )
    return F.when(line.rlike("[\"']"), let(parts, body)).otherwise(_none())


def c_strings(line: Column) -> Column:
    return _literals(line, C_STRING)


def python_strings(line: Column) -> Column:
    return _literals(line, PYTHON_STRING)


def code_fragments(line: Column, is_python: Column) -> Column:
    """Comments, then literals: a quote inside a comment is looked at as a literal again.

    The carriage return before a line break belongs to neither.
    """

    def both(text: Column) -> Column:
        return F.when(
            is_python, F.concat(python_comments(text), python_strings(text))
        ).otherwise(F.concat(c_comments(text), c_strings(text)))

    return let(without_return(line), both)
