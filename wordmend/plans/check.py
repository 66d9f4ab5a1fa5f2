"""Check documents: every misspelled word with its position, context and suggestions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmend.functions.patterns import DEFAULT_IGNORE, MAX_SUGGESTIONS
from wordmend.operators.suggest import suggest
from wordmend.operators.tokens import scan, with_context, without_context, words
from wordmend.operators.words import (
    drop_known,
    is_ignored,
    known_words,
    unknown_words,
    valid_patterns,
    vocabulary,
)
from wordmend.runtime import (
    dealt_tasks,
    frequent_rows,
    in_ranges,
    is_small,
    join_by_key,
    salted_join,
    stage,
)


def corrections(
    unknown: DataFrame, dictionary: DataFrame, k: int = MAX_SUGGESTIONS, all_short: bool = False
) -> DataFrame:
    """``(word, n, suggestions)`` for unknown vocabulary ``(word, w, n)``.

    Suggestions are made once per lower-cased word and shared by its spellings.
    """
    by_word = suggest(unknown.select(F.col("w").alias("word")), dictionary, k, all_short)
    return unknown.join(by_word.withColumnRenamed("word", "w"), "w").select(
        "word", "n", "suggestions"
    )


def misspelled_tokens(
    documents: DataFrame,
    keys: Sequence[str],
    dictionary: DataFrame,
    personal: DataFrame | None = None,
    ignore: Sequence[str] = DEFAULT_IGNORE,
    max_suggestions: int = MAX_SUGGESTIONS,
    context: bool = True,
    all_short: bool = False,
    **options: object,
) -> DataFrame:
    """Misspelled tokens with ``suggestions``.

    The text is read once: words that are not in the dictionaries are staged, then counted,
    then joined with the suggestions of the distinct words. If the dictionaries are too big
    to broadcast, they are compared with the counted vocabulary instead of with every token, and
    words are only staged if their suggestions cannot be broadcast either.
    """
    rules = valid_patterns(documents.sparkSession, ignore)
    entries = stage(dictionary.select("word").distinct(), "dictionary")
    known = known_words(entries, personal)
    finish = with_context if context else without_context
    found = scan(documents, keys, **options)
    if is_small(known):
        found = stage(finish(drop_known(found, known)), "unknown", packed=True)
        unknown = vocabulary(found, rules)
    else:
        found = finish(found)
        unknown = vocabulary(words(documents, keys, **options), rules).join(known, "w", "left_anti")
    unknown = stage(unknown, "vocabulary", packed=True)
    wanted = stage(corrections(unknown, entries, max_suggestions, all_short), "corrections", packed=True)
    if not is_small(known) and not is_small(wanted):
        found = stage(found, "words", packed=True)
    joined = join_by_key(found, wanted, "word", "n", [*map(F.col, keys), F.col("start")])
    return joined.select(*found.columns, "suggestions")


RANGE = "_range"


def placed_tokens(
    documents: DataFrame,
    keys: Sequence[str],
    dictionary: DataFrame,
    max_suggestions: int = MAX_SUGGESTIONS,
    context: bool = True,
    ranges: bool = False,
    all_short: bool = False,
    text: str = "text",
    **options: object,
) -> tuple[DataFrame, DataFrame]:
    """``documents`` dealt out by their keys, and their misspelled tokens as ``misspelled_tokens``
    has them, in the same partitions.

    For steps that bring the tokens of a document together: tokens with contexts and suggestions are
    many times the text, so the text is shuffled in their stead. It is scanned for the vocabulary,
    and again for tokens, which are not staged. If not all suggestions can be broadcast, the tokens
    of rare words are shuffled to them and back, and only these.

    With ``ranges`` partitions are ranges of the keys, numbered in their order, and tokens have the
    column ``RANGE``, by which they are partitioned.
    """
    rules = valid_patterns(documents.sparkSession, DEFAULT_IGNORE)
    entries = stage(dictionary.select("word").distinct(), "dictionary")
    known = known_words(entries)
    options = {"text": text, **options}
    counted = unknown_words(words(documents, keys, **options), known, rules)
    unknown = stage(counted.select("word", "w", "n"), "vocabulary", packed=True)
    wanted = stage(corrections(unknown, entries, max_suggestions, all_short), "corrections", packed=True)
    tasks = dealt_tasks(documents, text)
    by = [*keys]
    if ranges:
        documents, by = in_ranges(documents, keys, tasks, RANGE), [RANGE]
    dealt = documents.repartition(tasks, *by)
    carried = list(dict.fromkeys([*keys, *by]))
    finish = with_context if context else without_context
    place = [*carried, "word", "line", "column", "start", "end", *(["context"] if context else [])]

    def beside(lookup: DataFrame) -> DataFrame:
        found = scan(dealt, carried, **options).join(F.broadcast(lookup.drop("n")), "word")
        return finish(found).select(*place, "suggestions")

    if is_small(wanted):
        return dealt, beside(wanted)
    frequent = frequent_rows(wanted, "n")
    others = scan(documents, carried, **options)
    others = drop_known(others, known) if is_small(known) else others
    rare = wanted
    if frequent is not None:
        rare = wanted.where(~frequent)
        head = F.broadcast(wanted.where(frequent).select("word"))
        others = others.join(head, "word", "left_anti")
    others = finish(others.where(~is_ignored(F.col("word"), rules)))
    spread = [*map(F.col, keys), F.col("start")]
    back = salted_join(others, rare, ["word"], "n", spread).select(*place, "suggestions")
    back = back.repartition(tasks, *by)
    return dealt, back if frequent is None else beside(wanted.where(frequent)).unionByName(back)


def find(
    documents: DataFrame,
    keys: Sequence[str],
    dictionary: DataFrame,
    personal: DataFrame | None = None,
    ignore: Sequence[str] = DEFAULT_IGNORE,
    context: bool = False,
    **options: object,
) -> DataFrame:
    """Misspelled tokens without suggestions, for counts: nothing is staged or shuffled
    unless the dictionaries are too big to broadcast.
    """
    rules = valid_patterns(documents.sparkSession, ignore)
    known = known_words(dictionary, personal)
    finish = with_context if context else without_context
    found = scan(documents, keys, **options)
    if is_small(known):
        return finish(drop_known(found, known).where(~is_ignored(F.col("word"), rules)))
    counted = vocabulary(words(documents, keys, **options), rules)
    unknown = stage(counted.join(known, "w", "left_anti").select("word", "n"), "vocabulary")
    found = finish(found) if is_small(unknown) else stage(finish(found), "words", packed=True)
    spread = [*map(F.col, keys), F.col("start")]
    return join_by_key(found, unknown, "word", "n", spread).drop("n")


def check(
    documents: DataFrame,
    keys: Sequence[str],
    dictionary: DataFrame,
    personal: DataFrame | None = None,
    ignore: Sequence[str] = DEFAULT_IGNORE,
    max_suggestions: int = MAX_SUGGESTIONS,
    **options: object,
) -> DataFrame:
    """``(keys…, word, line, column, start, end, context, suggestions)``.

    ``options`` are those of ``operators.tokens.scan``: ``text``, ``path``, ``skip_regions``
    and ``block_comments``, and ``all_short`` of ``suggest``.
    """
    return misspelled_tokens(
        documents, keys, dictionary, personal, ignore, max_suggestions, **options
    )


def misspellings_per_document(
    documents: DataFrame, misspellings: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """``(keys…, error_count)`` for every document, 0 included.

    A zero row per document and the misspellings are counted together: one shuffle, partly
    aggregated before it, and no join that a frequent key could overload.
    """
    rows = documents.select(*keys, F.lit(0).alias("_one")).unionByName(
        misspellings.select(*keys, F.lit(1).alias("_one"))
    )
    return rows.groupBy(*keys).agg(F.sum("_one").alias("error_count"))


def summarize(misspellings: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: ``documents``, ``total_errors`` and whether the check ``passed``."""
    rows = documents.select(F.lit(1).alias("d"), F.lit(0).alias("e")).unionByName(
        misspellings.select(F.lit(0).alias("d"), F.lit(1).alias("e"))
    )
    total = F.coalesce(F.sum("e"), F.lit(0))
    return rows.agg(
        F.coalesce(F.sum("d"), F.lit(0)).alias("documents"),
        total.alias("total_errors"),
        (total == 0).alias("passed"),
    )
