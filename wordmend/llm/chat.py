r"""Chat formatting: conversations as one string with a loss mask, and back.

A conversation is written as blocks, one for each run of turns of the same role:

    <turn>assistant<says/>first text<next/>second text</turn>

Inside roles and texts a backslash is doubled and a control string gets a backslash after its
``<``, so control strings occur in the formatted text only as controls, and dropping the backslash
before any character gives the original back. The loss mask lists the byte spans (UTF-8) of the
texts of the learned role.

Defined results: turns are ordered by number, null first, then by role and text; repeated rows
are separate turns; null roles and texts are read as empty; rows with a null key form one
conversation; an empty table gives an empty table. Only the named columns are used, so others may
have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordmend.functions.arrays import let, running_starts

OPEN, SAYS, NEXT, CLOSE = "<turn>", "<says/>", "<next/>", "</turn>"
CONTROLS = (OPEN, SAYS, NEXT, CLOSE)
LEARNED = "assistant"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:
        text = F.replace(text, F.lit(control), F.lit(control.replace("<", "<\\")))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _blocks(turns: Column) -> Column:
    """Adjacent turns of one role merged: ``array<struct<role, texts>>``."""

    def body(t: Column) -> Column:
        first = F.filter(
            F.sequence(F.lit(0), F.size(t) - 1),
            lambda i: (i == 0) | (F.get(t, i)["role"] != F.get(t, i - 1)["role"]),
        )
        return let(
            first,
            lambda starts: F.transform(
                starts,
                lambda at, k: F.struct(
                    F.get(t, at)["role"].alias("role"),
                    F.transform(
                        F.slice(t, at + 1, F.coalesce(F.get(starts, k + 1), F.size(t)) - at),
                        lambda x: x["text"],
                    ).alias("texts"),
                ),
            ),
        )

    return let(turns, body)


def _pieces(blocks: Column) -> Column:
    """The formatted text in order, cut so that every turn's text is a piece of its own."""
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.flatten(
                F.transform(
                    b["texts"],
                    lambda text, i: F.array(
                        F.struct(
                            F.when(i == 0, F.concat(F.lit(OPEN), b["role"], F.lit(SAYS)))
                            .otherwise(F.lit(NEXT))
                            .alias("text"),
                            F.lit(False).alias("learned"),
                        ),
                        F.struct(text.alias("text"), (b["role"] == LEARNED).alias("learned")),
                        F.struct(
                            F.when(i == F.size(b["texts"]) - 1, F.lit(CLOSE)).otherwise("").alias("text"),
                            F.lit(False).alias("learned"),
                        ),
                    ),
                )
            ),
        )
    )


def format_conversations(
    turns: DataFrame,
    key: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """``(key, formatted, loss_mask)``; the mask is ``array<struct<start int, length int>>`` in
    bytes of the formatted text."""
    ordered = F.array_sort(
        F.collect_list(
            F.struct(
                F.col(turn).isNotNull().alias("known"),
                F.col(turn).alias("turn"),
                F.coalesce(role, F.lit("")).alias("role"),
                F.coalesce(text, F.lit("")).alias("text"),
            )
        )
    )
    escaped = F.transform(
        "_turns", lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text"))
    )
    pieces = (
        turns.groupBy(key)
        .agg(ordered.alias("_turns"))
        .select(key, _pieces(_blocks(escaped)).alias("_pieces"))
    )
    lengths = F.transform("_pieces", lambda p: F.octet_length(p["text"]))
    spans = F.zip_with(
        running_starts(lengths),
        "_pieces",
        lambda at, p: F.struct(
            at.alias("start"), F.octet_length(p["text"]).alias("length"), p["learned"].alias("learned")
        ),
    )
    return pieces.select(
        key,
        F.array_join(F.transform("_pieces", lambda p: p["text"]), "").alias("formatted"),
        F.transform(
            F.filter(spans, lambda s: s["learned"]),
            lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")),
        ).alias("loss_mask"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: ``array<struct<role, text>>``."""
    blocks = F.filter(F.split(formatted, CLOSE, -1), lambda b: b != "")
    return F.flatten(
        F.transform(
            blocks,
            lambda b: let(
                F.split(F.substr(b, F.lit(len(OPEN) + 1)), SAYS, -1),
                lambda parts: F.transform(
                    F.split(F.get(parts, F.lit(1)), NEXT, -1),
                    lambda text: F.struct(
                        unescape(F.get(parts, F.lit(0))).alias("role"), unescape(text).alias("text")
                    ),
                ),
            ),
        )
    )


def masked_texts(formatted: Column, mask: Column) -> Column:
    """The original texts under a loss mask, in order."""
    return let(
        F.encode(formatted, "UTF-8"),
        lambda raw: F.transform(
            mask,
            lambda s: unescape(F.decode(F.substr(raw, s["start"] + 1, s["length"]), "UTF-8")),
        ),
    )
