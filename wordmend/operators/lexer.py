"""Source code as a state machine: comments and literals that may span lines.

The marks of a text (quotes, slashes, escapes, line breaks …) are folded with a state: what the
text is in at that point, and how deep. So nested comments (Rust), raw strings with any number of
hashes (Rust), template literals and raw strings in back-ticks (JavaScript, TypeScript, Go) and
triple quotes (Python, Java) are followed over lines, and marks inside of each other are not
mistaken. Other literals and line comments end with their line and are left to ``operators.code``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wordmend.functions.arrays import let, matches_and_gaps
from wordmend.functions.text import blank

CODE, LINE, COMMENT, DOUBLE, SINGLE, TICK, TRIPLE_DOUBLE, TRIPLE_SINGLE, RAW = range(9)
BLOCKS = (COMMENT, TICK, TRIPLE_DOUBLE, TRIPLE_SINGLE, RAW)
# Which languages have which literals.
NESTED = ("rust",)
RAW_STRINGS = ("rust",)
TICKS = ("go", "javascript", "typescript", "jsx", "tsx")
TEMPLATES = ("javascript", "typescript", "jsx", "tsx")
TRIPLE = ("python", "java")

_MARKS = r"(?s)\\.|[\"/*'`#\n]"
# With raw strings a quote comes with the hashes around it, as they may begin or end one.
# What can begin a mark is asked first, and last what stands before it.
_RAW_MARKS = (
    r"(?s)(?=[\\\"/*'`#\nbr])"
    r"(?:\\(?:[^\"]|\"#*+)|(?=b?r#*+\")(?<![\p{IsAlphabetic}\p{N}_])b?r#*+\"#*+|\"#*+|[/*'`#\n])"
)


def _int(value: int) -> Column:
    return F.lit(value).cast("int")


def _state(
    kind: Column | int, depth: Column | int = 0, last: Column | str = "", run: Column | int = 0
) -> Column:
    """``last``: a mark that the next one may complete; ``run``: quotes in a row."""

    def number(x: Column | int) -> Column:
        return (F.lit(x) if isinstance(x, int) else x).cast("int")

    text = F.lit(last) if isinstance(last, str) else last
    return F.struct(
        number(kind).alias("kind"),
        number(depth).alias("depth"),
        text.alias("last"),
        number(run).alias("run"),
    )


def _in(lang: Column, languages: tuple[str, ...]) -> Column:
    return lang.isin(*languages)


def _after(state: Column, mark: Column, near: Column, lang: Column) -> Column:
    """The state after a mark; ``near``: it follows the last one directly."""
    python = lang == "python"
    escape = F.startswith(mark, F.lit("\\"))
    # Outside of literals a backslash means nothing, and the character after it is a mark.
    sign = F.when(escape, F.substring(mark, F.lit(2), F.char_length(mark))).otherwise(mark)
    quote = F.contains(sign, F.lit('"'))
    next_to = near & ~escape
    before = F.when(next_to, state.last).otherwise(F.lit(""))
    hashes = F.char_length(F.substring_index(sign, '"', -1))
    opening = F.char_length(F.regexp_extract(sign, '^b?r(#*)"', 1))
    raw = _in(lang, RAW_STRINGS) & sign.rlike('^b?r#*"')
    triple = _in(lang, TRIPLE)
    run = F.when(next_to & (state.run > 0), state.run + 1).otherwise(_int(1))

    code = (
        F.when(sign == "\n", _state(CODE))
        .when(raw, _state(RAW, opening))
        .when(quote & triple & (before == '""'), _state(TRIPLE_DOUBLE))
        .when(quote, _state(DOUBLE, 0, '"'))
        .when((sign == "'") & python & (before == "''"), _state(TRIPLE_SINGLE))
        .when(sign == "'", _state(SINGLE, 0, "'"))
        .when((sign == "`") & _in(lang, TICKS), _state(TICK))
        .when((sign == "#") & python, _state(LINE))
        .when((sign == "/") & ~python, F.when(before == "/", _state(LINE)).otherwise(_state(CODE, 0, "/")))
        .when((sign == "*") & ~python & (before == "/"), _state(COMMENT, 1))
        .otherwise(_state(CODE))
    )
    deeper = _in(lang, NESTED) & (sign == "*") & (before == "/")
    closes = (sign == "/") & (before == "*")
    comment = (
        F.when(deeper, _state(COMMENT, state.depth + 1))
        .when(closes & (state.depth <= 1), _state(CODE))
        .when(closes, _state(COMMENT, state.depth - 1))
        .when(sign.isin("/", "*"), _state(COMMENT, state.depth, sign))
        .otherwise(_state(COMMENT, state.depth))
    )

    def literal(kind: int, ends: Column, empty: str) -> Column:
        """A literal of one line. One that ends at once may be the beginning of three quotes."""
        at_once = next_to & (state.last == empty[0])
        return (
            F.when(escape, _state(kind))
            .when(ends, F.when(at_once, _state(CODE, 0, empty)).otherwise(_state(CODE)))
            .when(sign == "\n", _state(CODE))
            .otherwise(_state(kind))
        )

    def three(kind: int, one: Column) -> Column:
        return (
            F.when(escape, _state(kind))
            .when(one & (run >= 3), _state(CODE))
            .when(one, _state(kind, 0, "", run))
            .otherwise(_state(kind))
        )

    ends_tick = (sign == "`") & ~(escape & _in(lang, TEMPLATES))
    return (
        F.when(state.kind == CODE, code)
        .when(state.kind == LINE, F.when(sign == "\n", _state(CODE)).otherwise(_state(LINE)))
        .when(state.kind == COMMENT, comment)
        .when(state.kind == DOUBLE, literal(DOUBLE, quote, '""'))
        .when(state.kind == SINGLE, literal(SINGLE, sign == "'", "''"))
        .when(state.kind == TICK, F.when(ends_tick, _state(CODE)).otherwise(_state(TICK)))
        .when(state.kind == TRIPLE_DOUBLE, three(TRIPLE_DOUBLE, quote))
        .when(state.kind == TRIPLE_SINGLE, three(TRIPLE_SINGLE, sign == "'"))
        .otherwise(F.when(quote & (hashes >= state.depth), _state(CODE)).otherwise(state))
    )


_BLOCK = 64


def _kinds(marks: Column, gaps: Column, lang: Column) -> Column:
    """What the text is in after each mark. Folded in blocks, as appending copies the array."""

    def one(acc: Column, x: Column) -> Column:
        return let(
            _after(acc.state, x.mark, x.near, lang),
            lambda s: F.struct(s.alias("state"), F.array_append(acc.out, s["kind"]).alias("out")),
        )

    items = F.zip_with(
        marks,
        F.slice(gaps, F.lit(1), F.size(marks)),
        lambda m, g: F.struct(m.alias("mark"), (g == "").alias("near")),
    )

    def fold(listed: Column) -> Column:
        def block(acc: Column, k: Column) -> Column:
            start = F.struct(acc.state.alias("state"), F.array().cast("array<int>").alias("out"))
            done = F.aggregate(F.slice(listed, k * _BLOCK + 1, F.lit(_BLOCK)), start, one)
            return let(
                done,
                lambda d: F.struct(d.state.alias("state"), F.array_append(acc.out, d.out).alias("out")),
            )

        blocks = F.sequence(F.lit(0), F.ceil(F.size(listed) / _BLOCK).cast("int") - 1)
        start = F.struct(
            _state(CODE).alias("state"), F.array().cast("array<array<int>>").alias("out")
        )
        folded = F.flatten(F.aggregate(blocks, start, block, lambda acc: acc.out))
        return F.when(F.size(listed) == 0, F.array().cast("array<int>")).otherwise(folded)

    return let(items, fold)


def split_blocks(text: Column, lang: Column) -> Column:
    """A struct of two versions of a text with equal bytes and line breaks: ``blocks``, in which all
    but block comments and literals over lines is blanked, and ``rest``, in which these are."""

    def versions(s: Column) -> Column:
        def of(i: Column) -> Column:
            now = F.when(i == 0, CODE).otherwise(F.get(s.kinds, i - 1))
            then = F.get(s.kinds, i)
            gap, mark = F.get(s.gaps, i), F.coalesce(F.get(s.marks, i), F.lit(""))
            inside = now.isin(*BLOCKS)
            edge = inside | F.coalesce(then.isin(*BLOCKS), F.lit(False))
            escapes = now.isin(TRIPLE_DOUBLE, TRIPLE_SINGLE) | ((now == TICK) & _in(lang, TEMPLATES))
            is_gap = escapes & F.startswith(mark, F.lit("\\"))  # an escape pair is a gap
            kept = inside & (now == F.coalesce(then, now)) & ~is_gap
            # What stands before a quote that ends a raw string is still inside.
            last = F.when(now == RAW, F.regexp_extract(mark, '^(b?r#*)"', 1)).otherwise(F.lit(""))
            after = F.substring(mark, F.char_length(last) + 1, F.char_length(mark))
            return F.struct(
                F.concat(
                    F.when(inside, gap).otherwise(blank(gap)),
                    F.when(kept, mark).otherwise(F.concat(last, blank(after))),
                ).alias("blocks"),
                F.concat(
                    F.when(inside, blank(gap)).otherwise(gap),
                    F.when(edge, blank(mark)).otherwise(mark),
                ).alias("rest"),
            )

        every = F.transform(F.sequence(F.lit(0), F.size(s.gaps) - 1), of)
        return let(
            every,
            lambda e: F.struct(
                F.array_join(F.transform(e, lambda x: x["blocks"]), "").alias("blocks"),
                F.array_join(F.transform(e, lambda x: x["rest"]), "").alias("rest"),
            ),
        )

    def parts(t: Column) -> Column:
        plain, raw = (matches_and_gaps(t, marks) for marks in (_MARKS, _RAW_MARKS))
        marks, gaps = (
            F.when(_in(lang, RAW_STRINGS), a).otherwise(b) for a, b in zip(raw, plain, strict=True)
        )
        return let(
            F.struct(marks.alias("marks"), gaps.alias("gaps")),
            lambda m: let(
                F.struct(
                    m.marks.alias("marks"),
                    m.gaps.alias("gaps"),
                    _kinds(m.marks, m.gaps, lang).alias("kinds"),
                ),
                versions,
            ),
        )

    return let(text, parts)
