"""Edit-distance helpers over one word per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wordmend.functions.arrays import let
from wordmend.functions.patterns import COMMON_TYPOS

_FROM = "".join(a for a, _ in COMMON_TYPOS)
_TO = "".join(b for _, b in COMMON_TYPOS)


def _up_to(last: Column) -> Column:
    """[1, 2, …, last], empty if last < 1."""
    return F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(
        F.array().cast("array<int>")
    )


def _drop_char(word: Column, i: Column) -> Column:
    return F.concat(
        F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.char_length(word))
    )


def _swap_chars(word: Column, i: Column) -> Column:
    return F.concat(
        F.substring(word, F.lit(1), i - 1),
        F.substring(word, i + 1, F.lit(1)),
        F.substring(word, i, F.lit(1)),
        F.substring(word, i + 2, F.char_length(word)),
    )


def _replace_char(word: Column, i: Column) -> Column:
    """Null if the letter is not in the list."""
    char = F.substring(word, i, F.lit(1))
    other = F.translate(char, _FROM, _TO)
    rest = F.substring(word, i + 1, F.char_length(word))
    return F.when(other != char, F.concat(F.substring(word, F.lit(1), i - 1), other, rest))


def deletions(word: Column) -> Column:
    """The word without its 1st, 2nd, … character."""
    return let(
        word,
        lambda w: F.transform(_up_to(F.char_length(w)), lambda i: _drop_char(w, i)),
    )


def adjacent_swaps(word: Column) -> Column:
    """The word with its 1st and 2nd, 2nd and 3rd, … character swapped."""
    return let(
        word,
        lambda w: F.transform(_up_to(F.char_length(w) - 1), lambda i: _swap_chars(w, i)),
    )


def typo_replacements(word: Column) -> Column:
    """One letter replaced by the letter it is commonly typed for, by position."""
    return let(
        word,
        lambda w: F.array_compact(
            F.transform(_up_to(F.char_length(w)), lambda i: _replace_char(w, i))
        ),
    )


def variants(word: Column) -> Column:
    """Every one-step variant in the order it is tried: deletions, swaps, replacements."""
    return F.concat(deletions(word), adjacent_swaps(word), typo_replacements(word))


def leading_variants(word: Column, limit: int) -> list[Column]:
    """The variants made at the first ``limit`` characters, in order; null where the word is
    too short or the letter is not in the list.
    """
    size = F.char_length(word)
    places = [F.lit(i) for i in range(1, limit + 1)]
    return (
        [F.when(size >= i, _drop_char(word, i)) for i in places]
        + [F.when(size > i, _swap_chars(word, i)) for i in places]
        + [_replace_char(word, i) for i in places]
    )


def letter_mask(word: Column) -> Column:
    """The letters of a word as 64 bits: 32 classes of letters, each with one bit for
    "occurs" and one for "occurs twice"."""

    def add(acc: Column, char: Column) -> Column:
        place = F.pmod(F.ascii(char), F.lit(32))
        once = F.call_function("shiftleft", F.lit(1).cast("bigint"), place)
        twice = F.call_function("shiftleft", F.lit(1).cast("bigint"), place + 32)
        return acc.bitwiseOR(F.when(acc.bitwiseAND(once) == 0, once).otherwise(twice))

    return F.aggregate(F.split(word, "", -1), F.lit(0).cast("bigint"), add)


def may_be_within(mask_a: Column, mask_b: Column, distance: int) -> Column:
    """Cheap necessary test for edit distance <= ``distance``.

    Every letter that one word has more of costs at least one edit, and one edit can settle
    at most one such letter of each word.
    """
    only_a = F.bit_count(mask_a.bitwiseAND(F.bitwise_not(mask_b)))
    only_b = F.bit_count(mask_b.bitwiseAND(F.bitwise_not(mask_a)))
    return (only_a <= distance) & (only_b <= distance)


def deletion_neighbours(word: Column, distance: int) -> Column:
    """Every string left after removing at most ``distance`` characters.

    Two words within edit distance t share at least one string of this kind for t, so
    equality of neighbours finds all pairs without comparing all of them.
    """
    level = F.array(word)
    out = level
    for _ in range(distance):
        level = let(
            level,
            lambda ws: F.array_distinct(F.flatten(F.transform(ws, deletions))),
        )
        out = F.concat(out, level)
    return F.array_distinct(out)
