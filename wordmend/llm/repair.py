"""Conversation structure repair: turns aligned with the strings of an alternating grammar.

The role initials of a sound conversation are ``(s?(ua)+)?``. That grammar has one string for each
feasible length: none, an even number of turns, or an odd number from three on that opens with
``s``. The turns are aligned with the string of each length by Wagner and Fischer's table: *keep* a
turn (0), *rerole* it to user or assistant (2), *delete* it (3), *insert* an empty turn of user or
assistant (2). A kept or reroled turn that is truncated costs 1 more; blank and duplicate turns must
be deleted. Costs are counted above what no alignment can avoid. A quick repair gives the incumbent:
only lengths and diagonals (Ukkonen's band) are filled on which a path can cost no more. For each
length of least cost the alignment is traced back, and of their audits (initials of the edits in
order: D, I, K, R) the one least in ASCII is taken. An audit determines the repaired conversation.

Faults of a turn (the first counts): *blank*: no character but blanks; *duplicate*: role and text
were seen earlier in the conversation; *truncated*: the last character that is no blank is not one
of ``.!?``.

Turns are spread by conversation, sorted by turn (nulls first, then role and text) and read as a
stream. A task holds the turns of one conversation, the unit of the result. A table is kept in
every ``sqrt(turns)``-th row and filled again between them for tracing back, so that its memory is
``sqrt(turns)`` times the width of the band. Equal patterns of short conversations are solved once
for each worker.

Defined results: null roles and texts read as one blank; an initial other than ``s``, ``u`` and ``a``
(or none) can be reroled or deleted only; null keys are one conversation; repeated rows are
duplicates; a key without turns has zeros, an empty audit and no turns; an empty table gives an
empty table. Other columns are not used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"

_NEVER = 1 << 28
_REMEMBERED, _SHORT = 1 << 16, 64
_OUT_BYTES = 1 << 22
_MAX_LONG = (1 << 63) - 1


def _quick(turns: str) -> int:
    """Cost above the unavoidable of a repair in one pass; ``turns`` has no lost ones."""
    cost = size = 0
    plain = turns.lower()
    opened = plain[:1] == "s"
    for i in range(opened, len(plain)):
        wanted, other = "ua" if size % 2 == 0 else "au"
        if plain[i] == wanted:
            size += 1
        elif plain[i] == other and plain[i + 1 : i + 2] != other:
            size += 2  # the missing turn is inserted before this one
            cost += INSERT
        else:
            size += 1
            cost += REROLE
    if size % 2:
        cost += INSERT
    if opened and not size:
        cost += 2 * INSERT
    return cost


class Alignment:
    """Wagner and Fischer's table of a pattern against the strings of all lengths.

    All strings end alike, so one table serves them: ``plain[i][r]`` is the least cost of turns
    ``i …`` against the last ``r`` symbols, ``opened[i][r]`` the same if the first of these is ``s``, which
    only a kept turn can give. Along a row both are indexed by the diagonal: turns left that may
    stay, less ``r``. Leaving a diagonal costs 2, so only those within half the budget are filled.
    """

    def __init__(self, pattern: str, budget: int) -> None:
        self.pattern = pattern
        may_stay = np.array([c != "x" for c in pattern] + [False])
        self.left = np.cumsum(may_stay[::-1])[::-1].astype(np.int64)
        self.reach = budget // 2
        self.diagonals = np.arange(-self.reach, self.reach + 1)
        self.ramp = INSERT * np.arange(len(self.diagonals))
        end = np.where(self.diagonals == 0, 0, _NEVER)
        rows = self._inserted(end, -self.diagonals), np.full(len(end), _NEVER)
        self.kept = {len(pattern): rows}
        step = max(1, math.isqrt(len(pattern)))
        for i in range(len(pattern) - 1, -1, -1):
            rows = self._row(i, *rows)
            if i % step == 0:
                self.kept[i] = rows

    def _inserted(self, best: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Insertions lead along the row, to fewer symbols."""
        best = np.where(left < 0, _NEVER, best)
        chained = np.minimum.accumulate((best + self.ramp)[::-1])[::-1] - self.ramp
        return np.where(left < 0, _NEVER, np.minimum(chained, _NEVER))

    def _row(self, i: int, plain: np.ndarray, opened: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left = self.left[i] - self.diagonals
        turn = self.pattern[i]
        if turn == "x":
            return self._inserted(plain, left), opened
        deletion = DELETE - CUT_OFF * turn.isupper()
        initial = turn.lower()
        fits = left % 2 == "ua".index(initial) if initial in "ua" else np.zeros(len(left), bool)
        stays = np.where(left >= 1, plain + np.where(fits, 0, REROLE), _NEVER)
        stays[1:] = np.minimum(stays[1:], plain[:-1] + deletion)
        opens = opened + 0
        opens[0], opens[1:] = _NEVER, opened[:-1] + deletion
        if initial == "s":
            opens = np.where((left >= 3) & (left % 2 == 1), np.minimum(opens, plain), opens)
        return self._inserted(stays, left), np.minimum(opens, _NEVER)

    def costs(self) -> dict[int, int]:
        """Least cost above the unavoidable for each length within reach."""
        plain, opened = self.kept[0]
        lengths = self.left[0] - self.diagonals
        cost = np.where(lengths % 2 == 1, opened, plain)
        return {int(k): int(c) for k, c in zip(lengths, cost, strict=True) if c < _NEVER}

    def audit(self, lengths: list[int]) -> str:
        """Of the alignments of least cost with these lengths, the audit that is least in ASCII.

        They are traced back together: those whose next edit is not the least one fall out. Equal
        beginnings have used as many turns, and an audit comes before those that go on from it.
        """
        edits: list[str] = []
        left = np.array(lengths)
        lane = left % 2
        i, total, rows = 0, len(self.pattern), {}

        def at(row: int, symbols: np.ndarray, lanes: np.ndarray) -> np.ndarray:
            place = self.left[row] - symbols + self.reach
            inside = (place >= 0) & (place < len(self.diagonals)) & (symbols >= 0)
            place = np.where(inside, place, 0)
            found = np.where(lanes == 1, rows[row][1][place], rows[row][0][place])
            return np.where(inside, found, _NEVER)

        while i < total or left.all():
            if i not in rows or (i < total and i + 1 not in rows):
                last = min((k for k in self.kept if k > i), default=total)
                rows = {last: self.kept[last]}
                for k in range(last - 1, i - 1, -1):
                    rows[k] = self._row(k, *rows[k + 1])
            here, turn = at(i, left, lane), self.pattern[i] if i < total else ""
            if turn:
                deletion = 0 if turn == "x" else DELETE - CUT_OFF * turn.isupper()
                goes = here == at(i + 1, left, lane) + deletion
                if goes.any():
                    edits.append("D")
                    i, left, lane = i + 1, left[goes], lane[goes]
                    continue
            goes = (lane == 0) & (here == at(i, left - 1, lane) + INSERT)
            if goes.any():
                edits.append("I")
                left, lane = left[goes] - 1, lane[goes]
                continue
            wanted = np.where(lane == 1, "s", np.where(left % 2 == 0, "u", "a"))
            keeps = wanted == turn.lower()
            edits.append("K" if keeps.any() else "R")
            left = (left[keeps] if keeps.any() else left) - 1
            i, lane = i + 1, np.zeros(len(left), np.int64)
        return "".join(edits)


def _solve(pattern: str) -> tuple[int, str]:
    stay = pattern.replace("x", "")
    unavoidable = DELETE * (len(pattern) - len(stay)) + CUT_OFF * sum(c.isupper() for c in stay)
    table = Alignment(pattern, _quick(stay))
    costs = {k: c for k, c in table.costs().items() if k % 2 == 0 or k >= 3}
    least = min(costs.values())
    return unavoidable + least, table.audit([k for k, c in costs.items() if c == least])


_remembered = lru_cache(maxsize=_REMEMBERED)(_solve)


def align(pattern: str) -> tuple[int, str]:
    """Least cost of a repair and its audit.

    ``pattern`` has a letter for each turn: ``x`` must be deleted, else ``s``, ``u``, ``a`` or ``o`` for
    its initial, a capital if it is truncated.
    """
    return _remembered(pattern) if len(pattern) <= _SHORT else _solve(pattern)


def repaired(audit: str, turns: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The turns (role, text) after the edits."""
    out: list[tuple[str, str]] = []
    odd = (len(audit) - audit.count("D")) % 2
    rest = iter(turns)
    for edit in audit:
        role, text = next(rest) if edit != "I" else ("", "")
        if edit == "D":
            continue
        if edit != "K":
            role = ("user", "assistant")[(len(out) - odd) % 2]
        out.append((role, text))
    return out


def _diagnosed(turns: list[tuple[str, str]]) -> tuple[str, int, int, int, int]:
    """Pattern of a conversation, and how many blank, duplicate, truncated and illegal there are."""
    letters, seen = [], set()
    blank = duplicate = truncated = illegal = 0
    before = None
    for role, text in turns:
        initial = role[:1]
        if before is not None and before + initial not in ("su", "ua", "au"):
            illegal += 1
        before = initial
        letter = initial if initial and initial in "sua" else "o"
        stripped = text.strip(BLANKS)
        if not stripped:
            letter, blank = "x", blank + 1
        elif (role, text) in seen:
            letter, duplicate = "x", duplicate + 1
        elif stripped[-1] not in ENDS:
            letter, truncated = letter.upper(), truncated + 1
        seen.add((role, text))
        letters.append(letter)
    return "".join(letters), blank, duplicate, truncated, illegal


def _gaps(numbers: list[int | None]) -> int:
    known = {n for n in numbers if n is not None}
    return min(max(known) - min(known) + 1 - len(known), _MAX_LONG) if known else 0


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_TURN = pa.struct([("role", pa.string()), ("text", pa.string())])


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Key, turn numbers and turns of each conversation of sorted rows."""
    key, numbers, turns, begun = None, [], [], False
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("_key", "_turn", "_role", "_text")]
        for this, number, role, text in zip(*columns, strict=True):
            if begun and this != key:
                yield key, numbers, turns
                numbers, turns = [], []
            key, begun = this, True
            if role is not None:  # else the row only names its conversation
                numbers.append(number)
                turns.append((role, text))
    if begun:
        yield key, numbers, turns


def _repair(key_type: pa.DataType):
    def batch(keys: list, counts: list, audits: list, done: list) -> pa.RecordBatch:
        flat = [turn for turns in done for turn in turns]
        sizes = np.concatenate(([0], np.cumsum([len(turns) for turns in done], dtype=np.int32)))
        roles, texts = (pa.array([turn[i] for turn in flat], pa.string()) for i in (0, 1))
        listed = pa.ListArray.from_arrays(
            pa.array(sizes, pa.int32()), pa.StructArray.from_arrays([roles, texts], fields=list(_TURN))
        )
        numbers = [pa.array(column, pa.int64()) for column in zip(*counts, strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, key_type), *numbers, pa.array(audits, pa.string()), listed],
            names=["_key", *_COUNTS, "audit", "turns"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])
        size = 0
        for key, numbers, turns in _conversations(batches):
            pattern, *faults = _diagnosed(turns)
            cost, audit = align(pattern)
            row = key, (_gaps(numbers), *faults, cost), audit, repaired(audit, turns)
            for column, value in zip(held, row, strict=True):
                column.append(value)
            size += 100 + sum(len(text) for _, text in turns)
            if size > _OUT_BYTES:
                yield batch(*held)
                held, size = ([], [], [], []), 0
        if held[0]:
            yield batch(*held)

    return run


def repair(
    rows: DataFrame,
    key: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    absent: str | None = None,
) -> DataFrame:
    """One row for each conversation: counts of faults, least cost, audit and repaired ``turns``.

    Rows for which the boolean column ``absent`` is true name a conversation but are no turns.
    """
    there = F.lit(True) if absent is None else ~F.coalesce(F.col(absent), F.lit(False))
    named = rows.select(
        F.col(key).alias("_key"),
        F.col(turn).cast("bigint").alias("_turn"),
        F.when(there, F.coalesce(F.col(role), F.lit(" "))).alias("_role"),
        F.when(there, F.coalesce(F.col(text), F.lit(" "))).alias("_text"),
    )
    spread = named.repartition("_key").sortWithinPartitions("_key", "_turn", "_role", "_text")
    key_type = rows.schema[key].dataType
    schema = T.StructType(
        [T.StructField("_key", key_type)]
        + [T.StructField(name, T.LongType()) for name in _COUNTS]
        + [
            T.StructField("audit", T.StringType()),
            T.StructField("turns", T.ArrayType(T.StructType().add("role", "string").add("text", "string"))),
        ]
    )
    return spread.mapInArrow(_repair(to_arrow_type(key_type)), schema).withColumnRenamed("_key", key)
