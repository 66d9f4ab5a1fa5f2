"""Markdown block structure: which lines are text, and where paragraphs begin.

The lines of a document are folded with a stack of open containers as state: quotes, and list items
with the column their content begins at. A line first closes the containers it does not go on
with, then opens new ones, and what is left of it opens, continues or ends a leaf: paragraph
(lazily continued over missing markers), heading, fenced or indented code, HTML block.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wordmend.functions.arrays import let
from wordmend.functions.text import without_return

# A document without a line like one of these is paragraphs only.
STRUCTURE = r"(?dm)^(?:[ \t]*+(?:[>#+*\-`~<=\[]|[0-9]{1,9}[.)])| {0,3}+\t| {4})"

# --- leaves ----------------------------------------------------------------------------

_NONE, _PARAGRAPH, _INDENTED, _FENCE, _HTML = range(5)
_QUOTE = -1

_RULE = r"^(?:(?:\* *){3,}|(?:- *){3,}|(?:_ *){3,})$"
_UNDERLINE = r"^(?:=+|-+) *$"
_HEADING = r"^#{1,6}(?: |$)"
_FENCE_OPENS = r"^(`{3,}(?=[^`]*$)|~{3,})"
_ITEM = r"^([-+*]|[0-9]{1,9}[.)])(?= |$)"
_MARKERS = r"^(?: *(?:>|(?:[-+*]|[0-9]{1,9}[.)])(?= |$)))+"
# Where tabs matter: the characters that may stand before the text of a line.
_BEFORE_TEXT = r"^[ \t>*+\-0-9.)]*+"

# Tags that open an HTML block which lasts until a blank line.
_BLOCK_TAGS = (
    "address article aside base basefont blockquote body caption center col colgroup dd "
    "details dialog dir div dl dt fieldset figcaption figure footer form frame frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav "
    "noframes ol optgroup option p param search section summary table tbody td tfoot th "
    "thead title tr track ul"
)
_ATTRIBUTES = (
    r"(?:\s++[A-Za-z_:][\w.:\-]*+"
    r"""(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'=<>`]++))?)*+"""
)
TAG = rf"(?:<[A-Za-z][A-Za-z0-9\-]*+{_ATTRIBUTES}\s*+/?>|</[A-Za-z][A-Za-z0-9\-]*+\s*+>)"
# Kinds of HTML blocks: how they begin, and what their last line holds. The last two end
# before a blank line, and only the very last cannot interrupt a paragraph.
_HTML_KINDS = (
    (r"(?i)^<(?:script|pre|style|textarea)(?=[\s>]|$)", r"(?i)</(?:script|pre|style|textarea)>"),
    (r"^<!--", "-->"),
    (r"^<\?", r"\?>"),
    (r"^<![A-Za-z]", ">"),
    (r"^<!\[CDATA\[", r"\]\]>"),
    (rf"(?i)^</?(?:{'|'.join(_BLOCK_TAGS.split())})(?=[\s>]|/>|$)", None),
    (rf"^{TAG} *$", None),
)
_TO_BLANK_LINE = len(_HTML_KINDS) - 2


def _expanded(line: Column) -> Column:
    """A line without its carriage return, with spaces for the tabs before its text."""

    def spaces(parts: Column) -> Column:
        widened = F.transform(
            F.slice(parts, F.lit(1), F.size(parts) - 1),
            lambda p: F.rpad(p, (F.char_length(p) / 4).cast("int") * 4 + 4, F.lit(" ")),
        )
        return F.concat(F.array_join(widened, ""), F.element_at(parts, -1))

    def widened(x: Column) -> Column:
        before = F.regexp_extract(x, _BEFORE_TEXT, 0)
        rest = F.substring(x, F.char_length(before) + 1, F.char_length(x))
        return F.concat(let(F.split(before, "\t", -1), spaces), F.rtrim(F.translate(rest, "\t", " ")))

    plain = without_return(line)
    return F.when(F.contains(line, F.lit("\t")), let(plain, widened)).otherwise(F.rtrim(plain))


def _from(line: Column, at: Column) -> Column:
    return F.when(at == 0, line).otherwise(F.substring(line, at + 1, F.char_length(line)))


def _indent(rest: Column) -> Column:
    # Blanks are one byte each, and bytes need not be counted.
    return F.octet_length(rest) - F.octet_length(F.ltrim(rest))


def _begins(text: Column, signs: str) -> Column:
    """Is the first character one of these (ASCII)? Spares most lines a regular expression."""
    return F.ascii(text).isin(*map(ord, signs))


def _is_rule(text: Column) -> Column:
    return _begins(text, "*-_") & text.rlike(_RULE)


def _is_underline(text: Column) -> Column:
    return _begins(text, "=-") & text.rlike(_UNDERLINE)


def _struct(**fields: Column) -> Column:
    return F.struct(*(value.alias(name) for name, value in fields.items()))


def _int(value: int) -> Column:
    return F.lit(value).cast("int")


# --- containers ------------------------------------------------------------------------


def _continued(state: Column, line: Column) -> Column:
    """How far the line goes on with the open containers: ``at, n, marks``."""

    def one(acc: Column, container: Column) -> Column:
        def step(rest: Column) -> Column:
            indent, blank = _indent(rest), F.trim(rest) == ""
            last_is_fresh = state.fresh & (acc.n + 1 == F.size(state.stack))
            after = F.substring(rest, indent + 2, F.lit(1))
            quoted = (indent <= 3) & (F.substring(rest, indent + 1, F.lit(1)) == ">")
            inside = F.when(blank, ~last_is_fresh).otherwise(indent >= container)
            at = F.when(
                container == _QUOTE, acc.at + indent + 1 + F.when(after == " ", 1).otherwise(0)
            ).otherwise(F.when(blank, acc.at).otherwise(acc.at + container))
            goes_on = F.when(container == _QUOTE, quoted).otherwise(inside)
            return F.when(
                goes_on,
                _struct(
                    at=at.cast("int"),
                    n=acc.n + 1,
                    marks=acc.marks + F.when(container == _QUOTE, 1).otherwise(0),
                    open=F.lit(True),
                ),
            ).otherwise(_struct(at=acc.at, n=acc.n, marks=acc.marks, open=F.lit(False)))

        return F.when(acc.open, let(_from(line, acc.at), step)).otherwise(acc)

    start = _struct(at=_int(0), n=_int(0), marks=_int(0), open=F.lit(True))
    return F.when(
        F.size(state.stack) == 0, start
    ).otherwise(F.aggregate(state.stack, start, one))


def _opened(line: Column, at: Column, marks: Column, in_paragraph: Column) -> Column:
    """New containers of the rest of a line: ``at, marks, new``."""
    start = _struct(
        at=at, marks=marks, new=F.array().cast("array<int>"), open=F.lit(True)
    )

    def one(acc: Column, _: Column) -> Column:
        def pushed(container: Column, width: Column, signs: Column) -> Column:
            return _struct(
                at=(acc.at + width).cast("int"),
                marks=(acc.marks + signs).cast("int"),
                new=F.array_append(acc.new, container.cast("int")),
                open=F.lit(True),
            )

        def item(s: Column) -> Column:
            after = _from(s.text, F.char_length(s.sign))
            empty = after == ""
            spaces = F.when(empty | (_indent(after) > 4), 1).otherwise(_indent(after))
            width = s.indent + F.char_length(s.sign) + spaces
            return pushed(width, F.when(empty, width - 1).otherwise(width), F.char_length(s.sign))

        def step(s: Column) -> Column:
            after = _from(s.text, F.char_length(s.sign))
            # Into a paragraph come neither empty items nor numbers other than one.
            barred = in_paragraph & (F.size(acc.new) == 0)
            barred = barred & ((after == "") | (s.sign.rlike(r"^\d") & ~s.sign.rlike("^0*1[.)]")))
            space = F.when(F.substring(s.text, F.lit(2), F.lit(1)) == " ", 1).otherwise(0)
            stop = _struct(at=acc.at, marks=acc.marks, new=acc.new, open=F.lit(False))
            return (
                F.when(s.indent > 3, stop)
                .when(F.startswith(s.text, F.lit(">")), pushed(_int(_QUOTE), s.indent + 1 + space, _int(1)))
                .when((s.sign == "") | barred | _is_rule(s.text), stop)
                .when(in_paragraph & (F.size(acc.new) == 0) & _is_underline(s.text), stop)
                .otherwise(item(s))
            )

        def parts(rest: Column) -> Column:
            text = F.ltrim(rest)
            return _struct(
                indent=_indent(rest), text=text, sign=F.regexp_extract(text, _ITEM, 1)
            )

        return F.when(
            acc.open, let(let(_from(line, acc.at), parts), step)
        ).otherwise(acc)

    def opening(rest: Column) -> Column:
        signs = F.translate(F.regexp_extract(rest, _MARKERS, 0), " ", "")
        some = let(
            F.char_length(signs),
            lambda n: F.when(n == 0, start).otherwise(
                F.aggregate(F.sequence(F.lit(1), n), start, one)
            ),
        )
        return F.when(_begins(F.ltrim(rest), ">-+*0123456789"), some).otherwise(start)

    return let(_from(line, at), opening)


# --- lines -----------------------------------------------------------------------------


def _html_kind(text: Column, in_paragraph: Column) -> Column:
    kind = F.lit(None).cast("int")
    for nth, (begins, _) in reversed(list(enumerate(_HTML_KINDS))):
        fits = text.rlike(begins)
        if nth == len(_HTML_KINDS) - 1:
            fits = fits & ~in_paragraph & ~text.rlike(_HTML_KINDS[0][0])
        kind = F.when(fits, nth).otherwise(kind)
    return F.when(F.startswith(text, F.lit("<")), kind)


def _html_ends(kind: Column, text: Column) -> Column:
    ends = text == ""
    for nth in range(_TO_BLANK_LINE):
        ends = F.when(kind == nth, text.rlike(_HTML_KINDS[nth][1])).otherwise(ends)
    return ends


_LINE = "struct<hidden:boolean,marks:int,begins:boolean>"


def _state(
    stack: Column, leaf: Column, kind: Column, fence: Column, fresh: Column,
    hidden: Column, marks: Column, begins: Column,
) -> Column:
    return _struct(
        stack=stack,
        leaf=leaf.cast("int"),
        kind=kind.cast("int"),
        fence=fence,
        fresh=fresh,
        line=_struct(hidden=hidden, marks=marks.cast("int"), begins=begins),
    )


def _line(state: Column, line: Column) -> Column:
    """The state after a line, with what the line is."""
    yes, no = F.lit(True), F.lit(False)

    def leaf(s: Column) -> Column:
        """What is left of a line after its containers."""

        def state_with(leaf: int, hidden: Column, **other: Column) -> Column:
            begins = other.get("begins", yes)
            kind, fence = other.get("kind", _int(0)), other.get("fence", F.lit(""))
            return _state(s.stack, _int(leaf), kind, fence, other.get("fresh", no), hidden, s.marks, begins)

        tip = (state.leaf == _PARAGRAPH) & ~s.new
        in_paragraph = tip & s.all
        html = _html_kind(s.text, tip)
        fence = F.when(_begins(s.text, "`~"), F.regexp_extract(s.text, _FENCE_OPENS, 1)).otherwise("")
        blank = s.text == ""
        fresh = blank & s.new & (F.get(s.stack, F.size(s.stack) - 1) != _QUOTE)
        lazy = _state(
            state.stack, _int(_PARAGRAPH), _int(0), F.lit(""), no, no, s.marks, no
        )
        indented = F.when(tip, lazy).otherwise(state_with(_INDENTED, yes))
        still_code = (state.leaf == _INDENTED) & s.all & ~s.new
        return (
            F.when(
                blank,
                F.when(still_code, state_with(_INDENTED, yes)).otherwise(
                    state_with(_NONE, no, fresh=fresh)
                ),
            )
            .when(s.indent > 3, indented)
            .when(_begins(s.text, "#") & s.text.rlike(_HEADING), state_with(_NONE, no))
            .when(fence != "", state_with(_FENCE, yes, fence=fence))
            .when(
                html.isNotNull(),
                F.when(
                    (html < _TO_BLANK_LINE) & _html_ends(html, s.text), state_with(_NONE, yes)
                ).otherwise(state_with(_HTML, yes, kind=html)),
            )
            .when(in_paragraph & _is_underline(s.text), state_with(_NONE, no, begins=no))
            .when(_is_rule(s.text), state_with(_NONE, no))
            .when(tip, lazy)
            .otherwise(state_with(_PARAGRAPH, no))
        )

    def opened(c: Column) -> Column:
        every = c.n == F.size(state.stack)
        in_paragraph = (state.leaf == _PARAGRAPH) & every

        def rest(o: Column) -> Column:
            new = F.size(o.new) > 0
            return let(
                let(
                    _from(line, o.at),
                    lambda r: _struct(
                        stack=F.concat(F.slice(state.stack, F.lit(1), c.n), o.new),
                        all=every,
                        new=new,
                        marks=o.marks,
                        indent=_indent(r),
                        text=F.trim(r),
                    ),
                ),
                leaf,
            )

        def closed(r: Column) -> Column:
            """A line of a block that containers and other marks do not matter to."""
            text = F.trim(r)
            run = F.char_length(state.fence)
            ends_fence = (
                (_indent(r) <= 3)
                & (text != "")
                & (F.replace(text, F.left(state.fence, F.lit(1)), F.lit("")) == "")
                & (F.char_length(text) >= run)
            )
            ends = F.when(state.leaf == _FENCE, ends_fence).otherwise(_html_ends(state.kind, text))
            after = F.when(ends, _NONE).otherwise(state.leaf)
            return _state(state.stack, after, state.kind, state.fence, no, yes, c.marks, yes)

        return F.when(
            every & state.leaf.isin(_FENCE, _HTML), let(_from(line, c.at), closed)
        ).otherwise(let(_opened(line, c.at, c.marks, in_paragraph), rest))

    return let(_continued(state, line), opened)


_BLOCK = 64


def _folded(lines: Column) -> Column:
    """What each line is. Lines are folded in blocks, as appending copies the array."""
    first = _state(
        F.array().cast("array<int>"), _int(_NONE), _int(0), F.lit(""), F.lit(False),
        F.lit(False), _int(0), F.lit(True),
    )
    bare = ("stack", "leaf", "kind", "fence", "fresh", "line")

    def one(acc: Column, line: Column) -> Column:
        return let(
            _line(acc.state, line),
            lambda s: _struct(state=s, out=F.array_append(acc.out, s["line"])),
        )

    def block(acc: Column, k: Column) -> Column:
        done = F.aggregate(
            F.slice(lines, k * _BLOCK + 1, F.lit(_BLOCK)),
            _struct(
                state=_struct(**{name: acc.state[name] for name in bare}),
                out=F.array().cast(f"array<{_LINE}>"),
            ),
            one,
        )
        return let(done, lambda d: _struct(state=d.state, out=F.array_append(acc.out, d.out)))

    blocks = F.sequence(F.lit(0), F.ceil(F.size(lines) / _BLOCK).cast("int") - 1)
    start = _struct(state=first, out=F.array().cast(f"array<array<{_LINE}>>"))
    return F.flatten(F.aggregate(blocks, start, block, lambda acc: acc.out))


def blocks(text: Column) -> Column:
    """The text in pieces that inline marks do not reach beyond, lines joined by newlines again.

    An array of structs ``(text, hidden)``: joined by newlines they are the text, but for container
    marks, which are blanked. ``hidden`` ones are code and HTML.
    """

    def unmarked(line: Column, marks: Column) -> Column:
        """A line without its first ``marks`` characters that are no blanks."""
        pattern = F.concat(F.lit(r"^(?:[ \t]*[^ \t]){"), marks.cast("string"), F.lit("}"))
        found = F.call_function("regexp_extract", line, pattern, F.lit(0))
        blanked = let(
            F.char_length(found), lambda n: F.concat(F.repeat(F.lit(" "), n), _from(line, n))
        )
        return F.when(marks == 0, line).otherwise(blanked)

    def grouped(s: Column) -> Column:
        clean = F.zip_with(s.lines, s.kinds, lambda line, kind: unmarked(line, kind.marks))
        firsts = F.filter(
            F.transform(s.kinds, lambda kind, i: F.when(kind.begins | (i == 0), i)),
            lambda i: i.isNotNull(),
        )

        def piece(p: Column) -> Column:
            return F.transform(
                p.firsts,
                lambda first, k: _struct(
                    text=F.array_join(
                        F.slice(
                            p.clean,
                            first + 1,
                            F.coalesce(F.get(p.firsts, k + 1), F.size(p.clean)) - first,
                        ),
                        "\n",
                    ),
                    hidden=F.get(s.kinds, first).hidden,
                ),
            )

        return let(_struct(clean=clean, firsts=firsts), piece)

    def of(lines: Column) -> Column:
        kinds = let(F.transform(lines, _expanded), _folded)
        return let(_struct(lines=lines, kinds=kinds), grouped)

    return let(F.split(text, "\n", -1), of)
