"""Which words are misspelled: ignore rules and dictionary look-up."""

from __future__ import annotations

import re
import warnings
from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmend.functions.patterns import DEFAULT_IGNORE
from wordmend.runtime import is_small


def valid_patterns(spark: SparkSession, patterns: Sequence[str]) -> list[str]:
    """The patterns Java can compile; the others are skipped with a warning.

    All are tried in one job; if one fails, the halves are.
    """
    good = _compiled(spark, [p for p in dict.fromkeys(patterns) if p not in DEFAULT_IGNORE])
    known = {*good, *DEFAULT_IGNORE}
    for pattern in patterns:
        if pattern not in known:
            warnings.warn(f"Invalid regex pattern skipped: {pattern}", stacklevel=2)
    return [pattern for pattern in patterns if pattern in known]


def _compiled(spark: SparkSession, patterns: list[str]) -> list[str]:
    if not patterns:
        return []
    tried = [F.lit("x").rlike(_unicode(p)).alias(f"p{i}") for i, p in enumerate(patterns)]
    try:
        spark.range(1).select(*tried).collect()
    except PySparkException as problem:
        if "PATTERN" not in (problem.getCondition() or "").upper():
            raise
        half = len(patterns) // 2
        return _compiled(spark, patterns[:half]) + _compiled(spark, patterns[half:]) if half else []
    return patterns


def _unicode(pattern: str) -> str:
    """``\\w``, ``\\d`` and ``\\b`` mean Unicode classes in ignore rules."""
    return "(?U)" + pattern


_LITERAL = 3
_SIMPLE_ESCAPES = "wWdDsSbBAzZ"


def required_literal(pattern: str) -> str | None:
    """The longest text that every match of a simple pattern holds; nothing if it is shorter than
    ``_LITERAL`` characters, or if the pattern has groups, alternatives or anything unusual."""
    if any(sign in pattern for sign in ("|", "(", ")", "&&")):
        return None
    best = run = ""
    at = 0
    while at < len(pattern):
        sign, literal, end = pattern[at], "", at + 1
        if sign == "\\":
            literal, end = pattern[at + 1 : at + 2], at + 2
            if literal.isalnum() and literal not in _SIMPLE_ESCAPES:
                return None
            literal = "" if literal.isalnum() else literal
        elif sign == "[":
            inside = re.match(r"\[\^?(?:[^\[\]\\]|\\[^pPQ])+\]", pattern[at:])
            if not inside:
                return None
            end = at + inside.end()
        elif sign not in ".^$":
            literal = sign
        how_often = re.match(r"(?:[*?]|\{[^}]*\}|\+)[?+]?", pattern[end:])
        often = how_often.group() if how_often else ""
        # What need not occur, or may occur more than once, ends a run.
        run = run + literal if literal and not often.startswith(("*", "?", "{")) else ""
        best = max(best, run, key=len)
        if often or not literal:
            run = ""
        at = end + len(often)
    return best if len(best) >= _LITERAL else None


def is_ignored(word: Column, patterns: Sequence[str] = DEFAULT_IGNORE) -> Column:
    """One-byte words, numbers and words in which a pattern is found.

    Patterns that need a literal text are tried only on words that have three characters of it,
    which is one look-up for each place of a word, however many patterns there are.
    """
    ignored = (F.octet_length(word) <= 1) | word.rlike(r"^\p{N}+$")
    literals = {p: required_literal(p) for p in patterns if p not in DEFAULT_IGNORE}
    for pattern in patterns:
        if literals.get(pattern) is None:
            ignored = ignored | word.rlike(_unicode(pattern))
    some = [p for p, literal in literals.items() if literal]
    if some:
        starts = sorted({literals[p][:_LITERAL] for p in some})
        places = F.sequence(F.lit(1), F.char_length(word) - (_LITERAL - 1))
        has_start = F.exists(places, lambda i: F.substring(word, i, F.lit(_LITERAL)).isin(*starts))
        long_enough = F.char_length(word) >= _LITERAL
        any_of = word.rlike("(?U)" + "|".join(f"(?:{p})" for p in some))
        ignored = ignored | F.when(long_enough, F.when(has_start, any_of)).eqNullSafe(True)
    return ignored


def known_words(dictionary: DataFrame, personal: DataFrame | None = None) -> DataFrame:
    """Distinct lower-case words that are never misspelled, as column ``w``."""
    known = dictionary.select(F.col("word").alias("w"))
    if personal is not None:
        known = known.unionByName(personal.select(F.lower("word").alias("w")))
    return known.distinct()


def drop_known(tokens: DataFrame, known: DataFrame) -> DataFrame:
    """Tokens whose lower-cased word is not in ``known``, which must be small.

    ``known`` is broadcast, so no token is shuffled.
    """
    same = F.lower(tokens["word"]) == known["w"]
    return tokens.join(F.broadcast(known), same, "left_anti")


def vocabulary(
    tokens: DataFrame, ignore: Sequence[str] = DEFAULT_IGNORE
) -> DataFrame:
    """``(word, w, n)``: each distinct word as written, lower-cased, and its occurrences.

    Counting is combined before the shuffle, and the ignore rules run once per distinct word.
    """
    counts = tokens.groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(~is_ignored(F.col("word"), ignore)).select(
        "word", F.lower("word").alias("w"), "n"
    )


def unknown_words(
    tokens: DataFrame, known: DataFrame, ignore: Sequence[str] = DEFAULT_IGNORE
) -> DataFrame:
    """The part of the vocabulary that is not in ``known``."""
    if is_small(known):
        return vocabulary(tokens, ignore).join(F.broadcast(known), "w", "left_anti")
    return vocabulary(tokens, ignore).join(known, "w", "left_anti")
