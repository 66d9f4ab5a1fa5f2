"""Suggestions: ranked dictionary words for each distinct unknown word.

Four sources of candidates, earlier ones first:

1. words with the same first 3 characters and edit distance <= 2, nearest first
2. one-step variants of the word that are in the dictionary, in the order they are made
3. words with the same first 2 characters and edit distance <= 3, nearest first
4. for words of up to 3 characters: of the first 100 dictionary words whose length differs
   by at most 1, those with edit distance <= 2, nearest first; with ``all_short`` not of the
   first 100 but of all

Ties go to byte order, a candidate counts once, and the first k are kept. Stopping a source
early gives the same result as ranking the union of all four, which is what is done here.

Each word is turned into probes and each dictionary word into index entries, so that the
sources are equi-joins. With many candidates for a word sources 1 and 2 come first, and only words they
leave with fewer than k candidates are sent on to sources 3 and 4, which compare many more
pairs. A variant made behind the third character keeps the first three and is at most 2 edits
away, so source 1 has it already; only variants made at the first three are looked up.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordmend.functions.edits import (
    deletion_neighbours,
    leading_variants,
    letter_mask,
    may_be_within,
    variants,
)
from wordmend.functions.patterns import (
    MAX_SUGGESTIONS,
    SHORT_WORD,
    SHORT_WORD_CANDIDATES,
)
from wordmend.runtime import is_small, shuffle_tasks, two_sided_join

# Kinds of probes: words near by with the same 3 characters, words further away with the same
# 2, short words, all variants, variants made at the first characters, and one that every word
# finds, which keeps words without candidates in the result.
CLOSE, WIDE, SHORT, VARIANT, LEADING, ALWAYS = range(6)
_SIGNS = {CLOSE: "c", WIDE: "w", SHORT: "s", VARIANT: "v", LEADING: "v", ALWAYS: "a"}
# Characters that must be the same, and the greatest distance.
_REACH = {CLOSE: (3, 2), WIDE: (2, 3)}
_SHORT_DISTANCE = 2

_ALL_AT_ONCE = ((WIDE, LEADING, SHORT, ALWAYS),)
_IN_TURN = ((CLOSE, LEADING, ALWAYS), (WIDE, SHORT, ALWAYS))
# Candidates that the average word meets under its first two characters: up to the first number
# all sources are asked at once, beyond the second one pairs are found by common strings.
FEW_CANDIDATES, MANY_CANDIDATES = 300, 2000
# Longer dictionary words are joined on pieces, shorter ones on strings with letters left out.
LONG_WORD = 16
_LAST = 9
# Source and rank within it as one sortable number.
_SOURCE = 1 << 32
_LEADING_CHARS = 3


def _key(kind: int, value: Column) -> Column:
    return F.concat(F.lit(_SIGNS[kind]), value)


def with_features(words: DataFrame) -> DataFrame:
    """Length in characters and set of letters of each ``word``."""
    return words.withColumns(
        {"size": F.char_length("word"), "letters": letter_mask(F.col("word"))}
    )


def short_word_candidates(dictionary: DataFrame) -> DataFrame:
    """``(for_size, word)``: the first 100 words in byte order that are at most one
    character longer or shorter than ``for_size``, for sizes 1 to 3.
    """
    short = dictionary.select("word").where(F.char_length("word") <= SHORT_WORD + 1)
    return _first_short(short.distinct())


def _short(entries: DataFrame) -> DataFrame:
    """``(for_size, word)``: all words at most one character longer or shorter than ``for_size``."""
    size = F.char_length("word")
    sizes = [F.when(F.abs(size - n) <= 1, n) for n in range(1, SHORT_WORD + 1)]
    return (
        entries.where(size <= SHORT_WORD + 1)
        .select(F.explode(F.array(*sizes)).alias("for_size"), "word")
        .where(F.col("for_size").isNotNull())
    )


def _first_short(entries: DataFrame) -> DataFrame:
    order = Window.partitionBy("for_size").orderBy("word")
    return (
        _short(entries)
        .withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= SHORT_WORD_CANDIDATES)
        .select("for_size", "word")
    )


def _entries(words: DataFrame, key: Column) -> DataFrame:
    return with_features(words).select(
        key.alias("key"),
        F.col("word").alias("candidate"),
        F.col("size").alias("c_size"),
        F.col("letters").alias("c_letters"),
    )


def _fixed_entries(dictionary: DataFrame, all_short: bool = False) -> DataFrame:
    """Source 4, and one entry every word finds: at most 301 entries, or ``3 * MANY_CANDIDATES + 1``."""
    spark = dictionary.sparkSession
    listed = _short(dictionary) if all_short else _first_short(dictionary)
    short = _entries(listed, _key(SHORT, F.col("for_size").cast("string")))
    always = spark.range(1).select(
        _key(ALWAYS, F.lit("")).alias("key"),
        F.lit(None).cast("string").alias("candidate"),
        F.lit(0).alias("c_size"),
        F.lit(0).cast("bigint").alias("c_letters"),
    )
    return short.unionByName(always)


_PROBES = "array<struct<key:string,kind:int,rank:int>>"


def _probe(kind: int, value: Column, rank: Column | int = 0) -> Column:
    rank = F.lit(rank) if isinstance(rank, int) else rank
    return F.named_struct(
        F.lit("key"), _key(kind, value), F.lit("kind"), F.lit(kind), F.lit("rank"), rank
    )


def _probes(kinds: Sequence[int]) -> Column:
    """The probes of a word; those with a null key are dropped later."""
    word, size, is_open = F.col("word"), F.col("size"), F.col("open")
    single = []
    for kind in kinds:
        if kind == ALWAYS:
            single.append(_probe(kind, F.lit("")))
        elif kind == SHORT:
            short = is_open & (size <= SHORT_WORD)
            single.append(_probe(kind, F.when(short, size.cast("string"))))
        elif kind in _REACH:
            same = _REACH[kind][0]
            asks = is_open & (size >= same)
            single.append(_probe(kind, F.when(asks, F.left(word, F.lit(same)))))
        elif kind == LEADING:
            made = enumerate(leading_variants(word, _LEADING_CHARS))
            single += [_probe(kind, value, i) for i, value in made]
    probes = F.array(*single).cast(_PROBES)
    if VARIANT in kinds:
        every = F.transform(variants(word), lambda v, i: _probe(VARIANT, v, i))
        probes = F.concat(probes, every)
    return probes


def _close_enough(distance: int) -> Column:
    """The test a probe and an entry with the same key must pass."""
    kind = F.col("kind")
    short = (F.abs(F.col("size") - F.col("c_size")) <= 1) & (
        F.levenshtein("word", "candidate", _SHORT_DISTANCE) >= 0
    )
    near = (
        (F.abs(F.col("size") - F.col("c_size")) <= distance)
        & may_be_within(F.col("letters"), F.col("c_letters"), distance)
        & (F.levenshtein("word", "candidate", distance) >= 0)
        & ((kind != SHORT) | short)
    )
    return (kind >= VARIANT) | near


def _ranked(hits: DataFrame) -> DataFrame:
    """``(word, candidate, at)``; ``at`` is the source and the place within it as one number.

    What an earlier round found comes before everything else.
    """
    word, candidate, kind = F.col("word"), F.col("candidate"), F.col("kind")
    distance = F.levenshtein(word, candidate)
    same, reach = _REACH[CLOSE]
    close = (
        (F.col("size") >= same)
        & (F.left(word, F.lit(same)) == F.left(candidate, F.lit(same)))
        & (distance <= reach)
    )
    source = (
        F.when(kind == LEADING, 2)
        .when(kind == SHORT, 4)
        .when(kind == ALWAYS, _LAST)
        .when(close, 1)
        .otherwise(3)
    )
    rank = F.when(kind < VARIANT, distance).otherwise(F.col("rank"))
    at = source.cast("bigint") * _SOURCE + rank
    if "found" not in hits.columns:
        return hits.select("word", "candidate", at.alias("at"))
    this = F.array(F.struct(at.alias("at"), "candidate"))
    rows = F.when(kind == ALWAYS, F.concat("found", this)).otherwise(this)
    return hits.select("word", F.explode(rows).alias("_r")).select("word", "_r.candidate", "_r.at")


def _match(
    words: DataFrame, probes: Column, index: DataFrame, distance: int, two_sided: bool = False
) -> DataFrame:
    asked = words.select("*", F.explode(probes).alias("_p")).select(
        *words.columns, "_p.key", "_p.kind", "_p.rank"
    )
    if not two_sided:
        return asked.join(index, "key").where(_close_enough(distance))
    met = two_sided_join(
        asked.where("key IS NOT NULL"), index, "key", [F.col("word")], [F.col("candidate")]
    )
    return met.where(_close_enough(distance))


def _index(dictionary: DataFrame, kinds: Sequence[int]) -> DataFrame:
    """The entries of all words for prefix probes and look-ups."""
    word = F.col("word")
    keys = [
        F.when(F.char_length(word) >= same, _key(kind, F.left(word, F.lit(same))))
        for kind, (same, _) in _REACH.items()
        if kind in kinds
    ]
    if VARIANT in kinds or LEADING in kinds:
        keys.append(_key(VARIANT, word))
    return _entries(dictionary, F.explode(F.array(*keys))).where(F.col("key").isNotNull())


def _hits_by_broadcast(
    words: DataFrame, dictionary: DataFrame, kinds: Sequence[int], all_short: bool = False
) -> DataFrame:
    """All sources against a broadcast index: the words stay where they are."""
    index = _index(dictionary, kinds)
    if SHORT in kinds or ALWAYS in kinds:
        index = index.unionByName(_fixed_entries(dictionary, all_short))
    return _match(words, _probes(kinds), F.broadcast(index), _distance_of(kinds))


def _distance_of(kinds: Sequence[int]) -> int:
    return max([_REACH[k][1] for k in kinds if k in _REACH] or [_SHORT_DISTANCE])


def _hits_by_shuffle(
    words: DataFrame, dictionary: DataFrame, kinds: Sequence[int], all_short: bool = False
) -> DataFrame:
    """The same hits for a dictionary that is too big to broadcast.

    Equal prefixes would bring a large part of the dictionary together with a large part of
    the words. Words within edit distance t share a string that is left after at most t
    deletions, so words with the same prefix are joined on such a string of the rest. A pair
    can be found more than once. Short words have most such strings in common (all of up to
    three letters behind the prefix share the empty one), so a string may have many words on
    both sides, whose pairs are divided among tasks.
    """
    is_long = F.char_length("word") > LONG_WORD
    parts = []
    for kind in kinds:
        if kind in _REACH:
            parts.append(_deletion_hits(words, dictionary.where(~is_long), kind))
            parts.append(_piece_hits(words, dictionary.where(is_long), kind))
    looked_up = [k for k in kinds if k in (VARIANT, LEADING)]
    if looked_up:
        parts.append(_match(words, _probes(looked_up), _index(dictionary, looked_up), 0))
    fixed = [k for k in kinds if k in (SHORT, ALWAYS)]
    if fixed:
        index = F.broadcast(_fixed_entries(dictionary, all_short))
        parts.append(_match(words, _probes(fixed), index, _SHORT_DISTANCE))
    return reduce(DataFrame.unionByName, parts)


def _piece_hits(words: DataFrame, dictionary: DataFrame, kind: int) -> DataFrame:
    """Pairs of long words. Of ``distance + 1`` pieces of the dictionary word's rest, at least one
    stands unchanged in the other word, at most ``distance`` characters away from its place.
    """
    same, distance = _REACH[kind]
    head = F.left("word", F.lit(same))
    rest = F.substring("word", F.lit(same + 1), F.char_length("word"))
    around = F.array(*map(F.lit, range(-distance, distance + 1)))
    numbers = F.array(*map(F.lit, range(distance + 1)))

    def place(size: Column, i: Column) -> Column:
        return F.floor(size * i / (distance + 1)).cast("int")

    def key(size: Column, i: Column, piece: Column) -> Column:
        return F.concat_ws(" ", head, size.cast("string"), i.cast("string"), piece)

    def piece(size: Column, i: Column, shift: Column) -> Column:
        """The part of the word's rest where a piece of a rest of ``size`` may stand."""
        start, length = place(size, i) + shift, place(size, i + 1) - place(size, i)
        fits = (start >= 0) & (start + length <= F.char_length(rest))
        return F.when(fits, key(size, i, F.substring(rest, start + 1, length)))

    size = F.char_length(rest)
    own = F.transform(numbers, lambda i: piece(size, i, F.lit(0)))
    index = _entries(dictionary, F.explode(own))
    asked = F.flatten(
        F.transform(
            around,
            lambda more: F.flatten(
                F.transform(
                    numbers,
                    lambda i: F.transform(around, lambda shift: piece(size + more, i, shift)),
                )
            ),
        )
    )
    probes = F.transform(
        F.array_distinct(F.array_compact(asked)),
        lambda k: F.named_struct(
            F.lit("key"), k, F.lit("kind"), F.lit(kind), F.lit("rank"), F.lit(0)
        ),
    )
    long_enough = F.col("open") & (F.col("size") > LONG_WORD - distance)
    return _match(words.where(long_enough), probes, index, distance, two_sided=True)


def _short_hits(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Source 4 of all short words of a dictionary that has very many of them."""
    asked = words.where(F.col("size") <= SHORT_WORD)
    entries = dictionary.where(F.char_length("word") <= SHORT_WORD + 1)
    return _deletion_hits(asked, entries, SHORT)


def _deletion_hits(words: DataFrame, dictionary: DataFrame, kind: int) -> DataFrame:
    same, distance = _REACH.get(kind, (0, _SHORT_DISTANCE))
    head = F.left("word", F.lit(same))
    rest = F.substring("word", F.lit(same + 1), F.char_length("word"))
    keys = F.transform(deletion_neighbours(rest, distance), lambda d: F.concat(head, F.lit(" "), d))
    long_enough = F.char_length("word") >= same
    index = _entries(dictionary.where(long_enough), F.explode(keys))
    reachable = words.where(
        F.col("open") & long_enough & (F.col("size") <= LONG_WORD + distance)
    )
    probes = F.transform(
        keys,
        lambda k: F.named_struct(
            F.lit("key"), k, F.lit("kind"), F.lit(kind), F.lit("rank"), F.lit(0)
        ),
    )
    return _match(reachable, probes, index, distance, two_sided=True)


def prefix_matches(words: DataFrame, dictionary: DataFrame, size: int) -> DataFrame:
    """For each word: how many dictionary words share its first ``size`` characters, and the
    first and last of them in byte order. Only prefixes are joined, not pairs of words.
    """
    prefix = F.left("word", F.lit(size))
    groups = (
        dictionary.select("word")
        .where(F.char_length("word") >= size)
        .distinct()
        .groupBy(prefix.alias("prefix"))
        .agg(
            F.count("*").alias("candidates"),
            F.min("word").alias("first"),
            F.max("word").alias("last"),
        )
    )
    if is_small(groups):
        groups = F.broadcast(groups)
    asked = words.select("word").distinct().where(F.char_length("word") >= size)
    return asked.withColumn("prefix", prefix).join(groups, "prefix").drop("prefix")


def near_words(words: DataFrame, dictionary: DataFrame, kind: int) -> DataFrame:
    """``(word, candidate, distance)``: dictionary words with the same first 3 characters and
    distance <= 2 (``CLOSE``), or the same first 2 and distance <= 3 (``WIDE``).
    """
    hits = _hits(words, dictionary, [kind]).dropDuplicates(["word", "candidate"])
    return hits.select(
        "word", "candidate", F.levenshtein("word", "candidate").alias("distance")
    )


def variant_matches(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``(word, candidate, position)``: one-step variants that are dictionary words, with
    the place at which they are first made.
    """
    hits = _hits(words, dictionary, [VARIANT])
    return hits.groupBy("word", "candidate").agg(F.min("rank").alias("position"))


def _asked(words: DataFrame) -> DataFrame:
    # The work per word is far larger than its bytes, so the number of tasks is set here.
    tasks = shuffle_tasks(words.sparkSession)
    distinct = words.select("word").repartition(tasks, "word").distinct()
    return with_features(distinct).withColumn("open", F.lit(True))


def _candidates_per_word(entries: DataFrame) -> float:
    """Dictionary words with the first two characters of an average dictionary word."""
    buckets = entries.groupBy(F.left("word", F.lit(_REACH[WIDE][0])).alias("head")).count()
    return buckets.agg(F.sum(F.col("count") * F.col("count")) / F.sum("count")).first()[0] or 0.0


def _finder(
    entries: DataFrame, kinds: Sequence[int], candidates: float
) -> Callable[..., DataFrame]:
    """Every word meets all of its bucket if the index is small enough to be sent to all tasks
    and buckets are small; else words meet on common strings."""
    if candidates <= MANY_CANDIDATES and is_small(_index(entries, kinds)):
        return _hits_by_broadcast
    return _hits_by_shuffle


def _hits(words: DataFrame, dictionary: DataFrame, kinds: Sequence[int]) -> DataFrame:
    entries = dictionary.select("word").distinct()
    find = _finder(entries, kinds, _candidates_per_word(entries))
    return find(_asked(words), entries, kinds)


def _first_k(hits: DataFrame, k: int) -> DataFrame:
    """``(word, found)``: the k best candidates of each word as ``(at, candidate)``, in order.

    Words arrive partitioned by ``word``, and ranking keeps them so: nothing is shuffled, and
    at most k rows per word are gathered.
    """
    best = _ranked(hits).groupBy("word", "candidate").agg(F.min("at").alias("at"))
    order = Window.partitionBy("word").orderBy("at", "candidate")
    first = best.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
    one = F.struct(F.col("_n").cast("bigint").alias("at"), "candidate")
    found = F.array_sort(F.collect_list(F.when(F.col("candidate").isNotNull(), one)))
    return first.groupBy("word").agg(found.alias("found"))


def _has_few_short(entries: DataFrame) -> bool:
    """May every short word meet all short words of the dictionary?"""
    return entries.where(F.char_length("word") <= SHORT_WORD + 1).count() <= MANY_CANDIDATES


def suggest(
    words: DataFrame, dictionary: DataFrame, k: int = MAX_SUGGESTIONS, all_short: bool = False
) -> DataFrame:
    """``(word, suggestions)`` for every distinct lower-case ``word``; the array may be empty.

    With ``all_short`` source 4 has all short words of the dictionary.
    """
    entries = dictionary.select("word").distinct()
    candidates = _candidates_per_word(entries)
    rounds = _ALL_AT_ONCE if candidates <= FEW_CANDIDATES else _IN_TURN
    find = _finder(entries, sorted({kind for kinds in rounds for kind in kinds}), candidates)
    asked = _asked(words)
    apart = all_short and not _has_few_short(entries)
    for kinds in rounds:
        if apart and SHORT in kinds:
            others = find(asked, entries, [kind for kind in kinds if kind != SHORT])
            short = _short_hits(asked, entries).select(others.columns)
            found = _first_k(others.unionByName(short), k)
        else:
            found = _first_k(find(asked, entries, kinds, all_short), k)
        asked = with_features(found).withColumn("open", F.size("found") < k)
    return found.select("word", F.col("found.candidate").alias("suggestions"))
