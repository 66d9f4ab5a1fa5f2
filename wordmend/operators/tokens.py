"""Tokenizing: documents to positioned words.

Documents are split into lines and lines into words inside their own rows; nothing is
shuffled. Positions come from prefix sums over array elements (see ``functions.arrays``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordmend.functions.arrays import (
    built_once,
    let,
    matches_and_gaps,
    piece_lengths,
    running_starts,
)
from wordmend.functions.patterns import (
    BIG_SEGMENT,
    CODE_WORD,
    EMAIL,
    MARKDOWN_WORD,
    PLAIN_PART,
    SEGMENT,
    SHORT_LINE_BYTES,
    SHORT_TEXT_BYTES,
    URL,
)
from wordmend.functions.text import CONTEXT_BYTES, after, before, mask, short_context
from wordmend.operators.code import code_fragments, fragment
from wordmend.operators.lexer import split_blocks
from wordmend.operators.markdown import mask_markdown
from wordmend.sources.documents import (
    MARKDOWN,
    PLAIN_TEXT,
    SOURCE_CODE,
    file_type,
    source_lang,
)

# Text a match of a default rule must contain; lets most documents skip the regex.
_REGION_HINTS = {URL: "://", EMAIL: "@"}
_INTERNAL = ["_style", "_base", "_at", "_part", "_whole"]


def mask_regions(text: Column, patterns: Sequence[str]) -> Column:
    """Blank every stretch of text that matches one of ``patterns``."""
    for pattern in patterns:
        text = mask(text, "(?U)" + pattern, hint=_REGION_HINTS.get(pattern))
    return text


@built_once
def _line_starts(lines: str) -> Column:
    return running_starts(F.transform(lines, lambda x: F.octet_length(x) + 1))


@built_once
def _word_starts(gaps: str, matches: str) -> Column:
    return running_starts(piece_lengths(F.col(gaps), F.col(matches)))


def lines(documents: DataFrame, keys: Sequence[str], *texts: str) -> DataFrame:
    """One row per line: ``line`` (from 1), ``line_start`` (byte offset) and the line of each
    of ``texts``, which are versions of one text with equal byte lengths and line breaks.
    """
    arrays = [f"_{t}_lines" for t in texts]
    split = documents.select(
        *keys, *[F.split(t, "\n", -1).alias(a) for t, a in zip(texts, arrays, strict=True)]
    )
    starts = _line_starts(arrays[0])
    return split.select(
        *keys, F.posexplode(F.arrays_zip(*arrays, starts.alias("starts"))).alias("_n", "_line")
    ).select(
        *keys,
        (F.col("_n") + 1).alias("line"),
        F.col("_line.starts").alias("line_start"),
        *[F.col(f"_line.{a}").alias(t) for t, a in zip(texts, arrays, strict=True)],
    )


def _cut(scanned: Column, base: Column, at: Column, base_at: Column) -> Column:
    """A long fragment as several.

    A fragment travels with each of its words until their context is made, so its size must
    not depend on the length of the line. A segment brings just enough of its surroundings for
    the context of its first and last word.
    """

    def one(raw: Column, text: Column, start: Column) -> Column:
        before = F.least(start, F.lit(CONTEXT_BYTES))
        around = F.substring(
            raw, start - before + 1, before + F.octet_length(text) + CONTEXT_BYTES
        )
        return fragment(at + start - base_at, text, around.cast("string"), before, whole=False)

    def cut(s: Column) -> Column:
        starts = running_starts(F.transform(s.found, F.octet_length))
        return F.zip_with(s.found, starts, lambda text, x: one(s.raw, text, x + base_at))

    found = F.named_struct(
        F.lit("found"),
        F.regexp_extract_all(scanned, F.lit(SEGMENT), F.lit(0)),
        F.lit("raw"),
        base.cast("binary"),
    )
    return let(found, cut)


@built_once
def _segments(scanned: str, line: str) -> Column:
    """A line as fragments: one, or several if it is long."""
    whole = F.array(fragment(F.lit(0), F.col(scanned), F.col(line), whole=False))
    return F.when(F.octet_length(scanned) <= SHORT_LINE_BYTES, whole).otherwise(
        _cut(F.col(scanned), F.col(line), F.lit(0), F.lit(0))
    )


@built_once
def _fragments(blocks: bool) -> Column:
    code = code_fragments(F.col("_scan"), F.col("_python"))
    if blocks:
        code = F.concat(code, F.array(fragment(F.lit(0), F.col("_blocks"), F.col("_text"))))
    short = F.transform(
        code,
        lambda f: F.when(F.octet_length(f["text"]) <= SHORT_LINE_BYTES, F.array(f)).otherwise(
            _cut(f["text"], f["base"], f["at"], f["base_at"])
        ),
    )
    return F.when(F.col("_style") == SOURCE_CODE, F.flatten(short)).otherwise(
        _segments("_scan", "_text")
    )


@built_once
def _markdown(name: str) -> Column:
    return mask_markdown(F.col(name))


@built_once
def _split(text: str, lang: str) -> Column:
    return split_blocks(F.col(text), F.col(lang))


@built_once
def _word_arrays(style_name: str, text_name: str) -> tuple[Column, Column]:
    style, text = F.col(style_name), F.col(text_name)
    rules = {MARKDOWN: MARKDOWN_WORD, SOURCE_CODE: CODE_WORD, PLAIN_TEXT: PLAIN_PART}
    pairs = {name: matches_and_gaps(text, rule) for name, rule in rules.items()}

    def pick(side: int) -> Column:
        return (
            F.when(style == MARKDOWN, pairs[MARKDOWN][side])
            .when(style == SOURCE_CODE, pairs[SOURCE_CODE][side])
            .otherwise(pairs[PLAIN_TEXT][side])
        )

    return pick(0), pick(1)


def scan(
    documents: DataFrame,
    keys: Sequence[str],
    text: str = "text",
    path: str | None = None,
    skip_regions: Sequence[str] = (),
    block_comments: bool = False,
    positions: bool = True,
    by_line: bool = False,
) -> DataFrame:
    """``(keys…, word)``, and with ``positions`` also ``line``, ``column``, ``start``, ``end``
    and the helper columns from which ``with_context`` makes the context.

    With ``path`` the rules follow the file type; without it everything is plain text. With
    ``block_comments`` comments and literals of source code are followed over lines.

    With ``by_line`` a row is a line with ``line`` and ``line_start``, as ``read_lines`` gives them: plain
    text and source code are tokenized line by line anyway. Markdown and block comments are
    not, so the one is left out and the other refused.
    """
    if by_line and block_comments:
        raise ValueError("block comments need whole documents")
    place = ["line", "line_start"] if by_line else []
    kept = [F.col(path).alias("_path")] if path else []
    source = documents.select(*keys, *place, F.col(text).alias("_text"), *kept)
    versions = ["_text"]
    if path:
        lang = F.coalesce(source_lang(F.col("_path")), F.lit("")).alias("_lang")
        style = file_type(F.col("_path")).alias("_style")
        source = source.select(*keys, *place, "_text", style, lang).withColumn(
            "_python", F.col("_lang") == "python"
        )
        if by_line:
            source = source.where(F.col("_style") != MARKDOWN)
        body = F.when(F.col("_style") == MARKDOWN, _markdown("_text")).otherwise(F.col("_text"))
        if block_comments:
            is_code = F.col("_style") == SOURCE_CODE
            source = source.withColumn("_split", F.when(is_code, _split("_text", "_lang")))
            body = F.coalesce(F.col("_split.rest"), body)
            blocks = F.coalesce(F.col("_split.blocks"), F.col("_text"))
            source = source.withColumn("_blocks", mask_regions(blocks, skip_regions))
            versions.append("_blocks")
        source = source.withColumn("_scan", mask_regions(body, skip_regions))
        versions.append("_scan")
        carried = [*keys, "_style", "_python"]
    else:
        if skip_regions:
            source = source.withColumn("_scan", mask_regions(F.col("_text"), skip_regions))
            versions.append("_scan")
        carried = list(keys)

    place = [*keys, "_style"]
    if path or positions or by_line:
        place += ["line", "line_start", "_offset", "_base", "_base_at", "_whole"]
        if by_line:
            found = source.select(*carried, "line", "line_start", *versions)
        else:
            found = lines(source, carried, *versions)
        if path:
            fragments = _fragments(block_comments)
        else:
            found = found.withColumn("_style", F.lit(PLAIN_TEXT))
            fragments = _segments(versions[-1], "_text")
        found = found.select(
            *keys, "_style", "line", "line_start", F.explode(fragments).alias("_f")
        ).select(
            *keys,
            "_style",
            "line",
            "line_start",
            F.col("_f.at").alias("_offset"),
            F.col("_f.text").alias("_scan"),
            F.col("_f.base").alias("_base"),
            F.col("_f.base_at").alias("_base_at"),
            F.col("_f.whole").alias("_whole"),
        )
    else:
        # No word of plain text spans lines, so without positions they need not be split.
        whole = F.col(versions[-1])
        stretches = F.when(F.octet_length(whole) <= SHORT_TEXT_BYTES, F.array(whole)).otherwise(
            F.regexp_extract_all(whole, F.lit(BIG_SEGMENT), F.lit(0))
        )
        found = source.select(
            *keys, F.lit(PLAIN_TEXT).alias("_style"), F.explode(stretches).alias("_scan")
        )
    if path:
        matches, gaps = _word_arrays("_style", "_scan")
    else:
        matches, gaps = matches_and_gaps(F.col("_scan"), PLAIN_PART)

    arrays = found.select(*place, matches.alias("_matches"), gaps.alias("_gaps"))
    zipped = ["_matches", "_gaps"]
    if positions:
        arrays = arrays.withColumn("_starts", _word_starts("_gaps", "_matches"))
        zipped.append("_starts")
    pieces = arrays.select(
        *place, F.posexplode(F.arrays_zip(*zipped)).alias("_i", "_piece")
    ).where(F.col("_piece._matches").isNotNull())

    part = F.col("_piece._matches")
    gap = F.col("_piece._gaps")
    first = F.left(part, F.lit(1))
    # A later part of a camelCase word is reported with a small first letter.
    continued = (F.col("_style") == PLAIN_TEXT) & (F.col("_i") > 0) & (gap == "")
    word = F.when(
        continued,
        F.concat(F.left(F.lower(first), F.lit(1)), F.substring(part, F.lit(2), F.char_length(part))),
    ).otherwise(part)
    columns = [*keys, word.alias("word")]
    if positions:
        at = F.col("_piece._starts") + F.octet_length(gap)
        start = F.col("line_start") + F.col("_offset") + at
        columns += [
            "line",
            (F.col("_offset") + at + 1).alias("column"),
            start.alias("start"),
            (start + F.octet_length(part)).alias("end"),
            "_base",
            (F.col("_base_at") + at).alias("_at"),
            "_whole",
            part.alias("_part"),
        ]
    # Asked of the part as written, which is not made anew for each question; only a small first
    # letter can be shorter than it was, and an apostrophe or a hyphen stays one.
    long_enough = (F.octet_length(part) > 1) & (~continued | (F.octet_length(word) > 1))
    long_enough = (F.col("_style") == MARKDOWN) | long_enough
    starts_with_sign = F.startswith(part, F.lit("'")) | F.startswith(part, F.lit("-"))
    has_letter = ~starts_with_sign | (F.translate(part, "'-", "") != "")
    result = pieces.where(long_enough & has_letter).select(*columns, "_style")
    return result if positions else result.drop("_style")


@built_once
def _sides() -> tuple[Column, Column]:
    end = F.col("_at") + F.octet_length("_part")
    return before(F.col("_raw"), F.col("_at")), after(F.col("_raw"), end)


@built_once
def _context() -> Column:
    both_ends = F.col("_style") != MARKDOWN
    short = short_context(F.col("_left"), F.col("_part"), F.col("_right"), both_ends)
    return F.when(F.col("_whole"), F.col("_base")).otherwise(short)


def with_context(words: DataFrame) -> DataFrame:
    """Add ``context`` to scanned words. Best done after filters: it costs time per word.

    The context of a word in source code is its whole comment or literal. In one of more than
    ``SHORT_LINE_BYTES`` it is short like that of other text, or a long line would be copied for
    each of its words.
    """
    sides = words.withColumn("_raw", F.col("_base").cast("binary")).withColumns(
        dict(zip(("_left", "_right"), _sides(), strict=True))
    )
    context = _context()
    return sides.withColumn("context", context).drop(*_INTERNAL, "_raw", "_left", "_right")


def without_context(words: DataFrame) -> DataFrame:
    return words.drop(*_INTERNAL)


def tokens(documents: DataFrame, keys: Sequence[str], **options: object) -> DataFrame:
    """``(keys…, word, line, column, start, end, context)``, one row per word.

    ``start`` and ``end`` are UTF-8 byte offsets into the document; ``column`` counts bytes
    from 1. Options are those of ``scan``.
    """
    return with_context(scan(documents, keys, **options))


def words(documents: DataFrame, keys: Sequence[str], **options: object) -> DataFrame:
    """``(keys…, word)``, one row per word, for counts."""
    return scan(documents, keys, positions=False, **options)
