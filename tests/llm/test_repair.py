"""Conversation repair against a shortest path over the grammar's automaton."""

import random

import pytest

from wordmend.llm import repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def shortest(pattern):
    """Least (cost, audit) over what the output ends with: nothing, s, u or a."""
    follows = {"": "u", "s": "u", "u": "a", "a": "u"}

    def inserted(states):
        states = dict(states)
        for _ in range(3):
            for end, (cost, audit) in list(states.items()):
                new = follows[end]
                states[new] = min(states.get(new, (10**9, "")), (cost + 2, audit + "I"))
        return states

    states = {"": (0, "")}
    for turn in pattern:
        after = {}
        cut, initial = int(turn.isupper()), turn.lower()
        for end, (cost, audit) in inserted(states).items():
            options = [(end, cost + 3, "D")]
            if turn != "x":
                fits = follows[end] == initial
                options.append((follows[end], cost + cut + (0 if fits else 2), "K" if fits else "R"))
                if initial == "s" and not end:
                    options.append(("s", cost + cut, "K"))
            for new, price, edit in options:
                after[new] = min(after.get(new, (10**9, "")), (price, audit + edit))
        states = after
    states = inserted(states)
    return min(states[end] for end in ("", "a") if end in states)


@pytest.mark.parametrize("seed", range(4))
def test_cost_and_audit_of_random_patterns(seed):
    draw = random.Random(seed)
    for _ in range(300):
        pattern = "".join(draw.choice("suaoxSUAOuaua") for _ in range(draw.randrange(13)))
        assert repair.align(pattern) == shortest(pattern), pattern


def test_long_conversations_are_traced_back_from_kept_rows():
    draw = random.Random(5)
    for size in (70, 300, 1500):
        pattern = "".join("ua"[i % 2] if draw.random() < 0.8 else draw.choice("uaxUAos") for i in range(size))
        table = repair.Alignment(pattern, repair._quick(pattern.replace("x", "")))
        assert len(table.kept) <= 2 * size**0.5 + 3
        assert repair.align(pattern) == shortest(pattern)


def result(spark, rows, **options):
    frame = spark.createDataFrame(rows, SCHEMA + (", gone boolean" if "absent" in options else ""))
    found = repair.repair(frame, **options).collect()
    return {r.conv_id: r for r in found}


def test_faults_and_edits(spark):
    got = result(
        spark,
        [
            (1, 0, "user", "Hi."),
            (1, 1, "assistant", "Well"),  # truncated, still kept
            (1, 2, "assistant", " \t\n"),  # blank
            (1, 5, "user", "Hi."),  # seen before
            (1, 6, "tool", "Done!"),  # must change
            (1, 7, "assistant", "Yes."),
        ],
    )[1]
    assert (got.gaps, got.blank, got.duplicate, got.truncated, got.illegal) == (2, 1, 1, 1, 3)
    assert got.audit == "KKDDRK" and got.cost == 1 + 3 + 3 + 2
    assert [tuple(t) for t in got.turns] == [
        ("user", "Hi."),
        ("assistant", "Well"),
        ("user", "Done!"),
        ("assistant", "Yes."),
    ]


def test_system_turns_only_open(spark):
    got = result(spark, [(1, 0, "system", "Be."), (1, 1, "user", "A."), (1, 2, "assistant", "B.")])[1]
    assert (got.audit, got.cost, got.illegal) == ("KKK", 0, 0)
    alone = result(spark, [(1, 0, "system", "Be.")])[1]
    assert (alone.audit, alone.cost, alone.turns) == ("D", 3, [])


def test_nulls_ties_and_absent_rows(spark):
    rows = [
        (None, 0, "user", "A.", False),
        (None, None, "assistant", "B.", None),  # a null turn comes first
        (2, 0, None, None, False),  # a blank of a blank role
        (3, 0, "user", "gone", True),
        (4, 7, "user", "Same.", False),
        (4, 7, "user", "Same.", False),
        (5, -(2**63), "", "Q?", False),
        (5, 2**63 - 1, "assistant", "A.", False),
    ]
    got = result(spark, rows, absent="gone")
    assert (got[None].audit, got[None].illegal, got[None].gaps) == ("IKKI", 0, 0)
    assert (got[2].blank, got[2].audit) == (1, "D")
    assert (got[3].cost, got[3].audit, got[3].turns, got[3].gaps) == (0, "", [], 0)
    assert (got[4].duplicate, got[4].audit, got[4].gaps) == (1, "KDI", 0)
    assert (got[5].gaps, got[5].audit) == (2**63 - 1, "RK")


def test_empty_table_and_other_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.repair(empty).count() == 0
    rows = spark.createDataFrame([(1, 0, "user", "A.")], SCHEMA)
    extra = rows.selectExpr("*", *(f"'x' AS {n}" for n in ("_key", "_turn", "audit", "turns", "cost")))
    assert repair.repair(extra).first().audit == "KI"


def test_very_long_text_and_conversation(spark):
    long = "word " * 200_000 + "end."
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"{i}.") for i in range(2001)]
    got = result(spark, [*rows, (2, 0, "user", long)])
    assert got[1].audit == "K" * 2001 + "I"
    assert got[2].turns[0].text == long
