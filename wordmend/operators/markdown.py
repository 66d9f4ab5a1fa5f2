"""Markdown: blank everything that is not running text.

The block structure (``operators.blocks``) hides code and HTML blocks and blanks the marks of lists
and quotes. Inline code, tags, link targets, labels and entities are masked within each block.
Every step keeps byte offsets and line breaks, so the words that are left have their true positions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from wordmend.functions.arrays import let
from wordmend.functions.text import blank, mask
from wordmend.operators.blocks import STRUCTURE, TAG, blocks

# Escapes, autolinks and lone back-ticks are matched so that they cannot open something else.
_CODE_OR_TAG = (
    r"(?s)\\[!-/:-@\[-`{-~]"
    r"|(?<!`)(`++)(?:[^`\n]++|\n(?![ \t\r]*+\n)|(?!\1(?!`))`++)*+\1(?!`)"
    r"|`++"
    r"|<[A-Za-z][A-Za-z0-9+.\-]{1,31}:[^\s<>]*+>"
    rf"|{TAG}"
)


def _until(end: str) -> str:
    """To ``end``, or if that is missing, to the end of the paragraph."""
    return rf"(?:(?!{end})[^\n]|\n(?![ \t\r]*+\n))*+(?:{end})?"


# Other HTML that begins inside a paragraph, and how it ends.
_ENDS = {"<!--": "-->", "<?": "?>", "<![CDATA[": "]]>", "<!": ">"}
_INLINE = _CODE_OR_TAG + "".join(
    rf"|\Q{start}\E{_until(rf'\Q{end}\E')}" for start, end in _ENDS.items()
)
_TITLE = r"""(?:"(?:[^"\\]++|\\.)*+"|'(?:[^'\\]++|\\.)*+'|\((?:[^()\\]++|\\.)*+\))"""
# Definitions of link targets, which only the beginning of a paragraph can be.
_DEFINITIONS = (
    r"(?dm)\A(?: *\[[^\]\[\n]*[^\]\[\s][^\]\[\n]*\]:[ \t]*+\n?[ \t]*+(?:<[^<>\n]*+>|[^\s<]\S*+)"
    rf"(?:(?:[ \t]++|[ \t]*+\n[ \t]*+){_TITLE})?[ \t\r]*+$\n?)++"
)
_DEFINED = r"(?dm)^ *\[([^\]\[\n]++)\]:"
_TARGET = (
    r"(?s)(?<=\])\(\s*+(?:<[^<>\n]*+>|(?:[^\s()\\]++|\\.|\((?:[^\s()\\]++|\\.)*+\))*+)"
    rf"(?:\s++{_TITLE})?\s*+\)"
)
_LABEL = r"(?<=\])\[[^\]\[\n]*+\]"
_ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def _is_inline_code_or_html(found: Column) -> Column:
    opening = F.left(found, F.lit(1))
    closed_code = (opening == "`") & ~found.rlike(r"^`+$")
    closed_html = ~found.rlike(r"^<[A-Za-z][A-Za-z0-9+.\-]{1,31}:")
    for start, end in reversed(_ENDS.items()):
        closed_html = F.when(F.startswith(found, F.lit(start)), F.endswith(found, F.lit(end))).otherwise(
            closed_html
        )
    return closed_code | ((opening == "<") & closed_html)


def _when_found(pattern: str, change: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda t: F.when(t.rlike(pattern), change(t)).otherwise(t)


def _blank_closed(found: Column) -> Column:
    return F.when(_is_inline_code_or_html(found), blank(found)).otherwise(found)


def _inline(text: Column) -> Column:
    """What follows an opening without an end was passed over, so it is looked at again."""
    once = mask(text, _INLINE, _blank_closed)
    return let(once, _when_found("<[!?]", lambda t: mask(t, _CODE_OR_TAG, _blank_closed)))


def _named(label: Column) -> Column:
    """Labels are compared without case and runs of blanks."""
    return F.lower(F.trim(F.regexp_replace(label, r"\s+", " ")))


def _labels(pieces: Column) -> Column:
    """The labels that a document defines."""
    texts = F.filter(pieces, lambda p: ~p["hidden"] & F.contains(p["text"], F.lit("]:")))
    defined = F.transform(
        texts,
        lambda p: F.regexp_extract_all(
            F.regexp_extract(p["text"], _DEFINITIONS, 0), F.lit(_DEFINED), F.lit(1)
        ),
    )
    return F.transform(F.flatten(defined), _named)


def _spans(text: Column, labels: Column) -> Column:
    """The text of a block with everything but running text blanked."""

    def known(found: Column) -> Column:
        inside = _named(F.substring(found, F.lit(2), F.char_length(found) - 2))
        return F.when(F.array_contains(labels, inside), blank(found)).otherwise(found)

    out = let(text, _when_found("[`<]", _inline))
    out = mask(out, _TARGET, hint="](")
    out = mask(out, _LABEL, known, hint="][")
    out = mask(out, _DEFINITIONS, hint="]:")
    return mask(out, _ENTITY, hint="&")


def mask_markdown(text: Column) -> Column:
    """Markdown text with code, HTML, link targets and entities blanked."""

    def whole(s: Column) -> Column:
        masked = F.transform(
            s.pieces,
            lambda p: F.when(p["hidden"], blank(p["text"])).otherwise(_spans(p["text"], s.labels)),
        )
        return F.array_join(masked, "\n")

    flat = F.array(F.struct(text.alias("text"), F.lit(False).alias("hidden")))
    pieces = F.when(text.rlike(STRUCTURE), blocks(text)).otherwise(flat)
    both = let(pieces, lambda p: F.struct(p.alias("pieces"), _labels(p).alias("labels")))
    return let(both, whole)
