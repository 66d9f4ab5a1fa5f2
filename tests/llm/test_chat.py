from hashlib import sha256

from pyspark.sql import functions as F

from wordmend.llm import chat

ODD = ["\\### Assistant: </turn> ok", "</turn><turn>user<says/>hi<next/>", "a\\", "\\\\<next/>", "<\\turn>", "", None]
TURNS = "conv_id bigint, turn bigint, role string, text string, formatted string"


def read(formatted):
    return {
        r.conv_id: ([(t.role, t.text) for t in r.turns], list(r.learned))
        for r in formatted.select(
            "conv_id",
            chat.read_turns(F.col("formatted")).alias("turns"),
            chat.masked_texts(F.col("formatted"), F.col("loss_mask")).alias("learned"),
        ).collect()
    }


def test_round_trip(spark):
    rows = [(1, i, r, t, "x") for i, (r, t) in enumerate((r, t) for t in ODD for r in ("user", "assistant", "assistant"))]
    rows += [(2, None, "user", "first", "x"), (2, 1, None, "no role", "x"), (2, 1, "<turn>", "b", "x")]
    rows += [(3, 1, "assistant", "same", "x")] * 2 + [(None, 1, "user", "no key", "x")]
    got = read(chat.format_conversations(spark.createDataFrame(rows, TURNS).repartition(3)))
    assert got[1][0] == [(r[2], r[3] or "") for r in rows if r[0] == 1]
    assert got[1][1] == [r[3] or "" for r in rows if r[0] == 1 and r[2] == "assistant"]
    assert got[2] == ([("user", "first"), ("", "no role"), ("<turn>", "b")], [])
    assert got[3] == ([("assistant", "same")] * 2, ["same", "same"])
    assert got[None][0] == [("user", "no key")]


def test_template_and_mask(spark):
    rows = [(1, 0, "user", "hi", "x"), (1, 1, "assistant", "é", "x"), (1, 2, "assistant", "b", "x")]
    row = chat.format_conversations(spark.createDataFrame(rows, TURNS)).first()
    assert row.formatted == "<turn>user<says/>hi</turn><turn>assistant<says/>é<next/>b</turn>"
    raw = row.formatted.encode()
    assert [raw[s.start : s.start + s.length].decode() for s in row.loss_mask] == ["é", "b"]


def test_long_conversation(spark):
    turns = spark.range(3000).selectExpr(
        "1L AS conv_id", "id AS turn", "if(id % 3 = 0, 'user', 'assistant') AS role", "'text ' || id AS text"
    )
    ((all_turns, learned),) = read(chat.format_conversations(turns)).values()
    text = "".join(f"{r}\n{t}\n" for r, t in all_turns)
    expected = "".join(f"{'user' if i % 3 == 0 else 'assistant'}\ntext {i}\n" for i in range(3000))
    assert sha256(text.encode()).digest() == sha256(expected.encode()).digest()
    assert len(learned) == 2000


def test_empty(spark):
    assert chat.format_conversations(spark.createDataFrame([], TURNS)).count() == 0


def test_native(spark):
    plan = chat.format_conversations(spark.createDataFrame([], TURNS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
