"""Plain text: words, compounds, positions and contexts."""

import random

import regex
from pyspark.sql import functions as F

from wordmend.functions.arrays import running_starts
from wordmend.functions.patterns import EMAIL, URL
from wordmend.operators.tokens import tokens, words


def found(docs, text, **options):
    frame = docs({"a.txt": text})
    return tokens(frame, ["path"], **options).orderBy("start").collect()


def plain_words(text):
    """Brute force with Python's regex module: runs of word graphemes, then their parts."""
    out, line_at = [], 0
    for number, line in enumerate(text.split("\n"), 1):
        for run in regex.finditer(r"(?:(?=[\p{Alphabetic}'-])\X)+", line):
            for part in regex.finditer(r"[^-][^-\p{Uppercase}]*", run[0]):
                word = part[0]
                if part.start() and run[0][part.start() - 1] != "-":
                    word = word[0].lower()[0] + word[1:]
                if len(word.encode()) > 1 and regex.search(r"\p{Alphabetic}", word):
                    at = len(line[: run.start() + part.start()].encode())
                    size = len(part[0].encode())
                    out.append((word, number, at + 1, line_at + at, line_at + at + size))
        line_at += len(line.encode()) + 1
    return out


def test_sentence(docs):
    got = found(docs, "Seven grey owls, a fox? Yes.")
    assert [r.word for r in got] == ["Seven", "grey", "owls", "fox", "Yes"]
    assert got[0].line == 1 and got[0].column == 1


def test_compounds(docs):
    text = "oneBigOwl two_big_owls three-owls Red-Fox"
    assert [r.word for r in found(docs, text)] == [
        "one", "big", "owl", "two", "big", "owls", "three", "owls", "Red", "Fox",
    ]


def test_every_part_has_its_own_offset(docs):
    got = found(docs, "aBut-The endWord")
    assert [(r.word, r.start, r.end) for r in got] == [
        ("but", 1, 4), ("The", 5, 8), ("end", 9, 12), ("word", 12, 16),
    ]


def test_capitals_fall_apart(docs):
    got = found(docs, "README HTTPServer")
    assert [(r.word, r.start) for r in got] == [("server", 11)]


def test_byte_length_and_letters(docs):
    assert [r.word for r in found(docs, "é e a -- b '' -' it's")] == ["é", "it's"]


def test_lines_and_crlf(docs):
    got = found(docs, "Red owls\nGrey foxes\nOld crows")
    assert [r.line for r in got] == [1, 1, 2, 2, 3, 3]
    got = found(docs, "ab\r\ncd")
    assert [(r.word, r.line, r.column, r.start, r.context) for r in got] == [
        ("ab", 1, 1, 0, "ab"), ("cd", 2, 1, 4, "cd"),
    ]


def test_contexts_mark_both_cut_ends(docs):
    text = "0123456789 0123456789 word 0123456789 0123456789"
    (got,) = found(docs, text)
    assert got.context == "...23456789 0123456789 word 0123456789 01234567..."
    assert found(docs, "word é" + "x" * 3)[0].context == "word éxxx"
    accents = "é" * 15 + " " + "ö" * 10 + " word " + "ü" * 25
    assert found(docs, accents)[2].context == "..." + "é" * 8 + " " + "ö" * 10 + " word " + (
        "ü" * 19 + "..."
    )


def test_empty_and_wordless_documents(docs):
    assert found(docs, "") == []
    assert found(docs, "12 ? \n\n 3") == []


def test_against_brute_force(spark):
    rng = random.Random(7)
    # "e" with a combining accent is one unit.
    alphabet = [*"abzABZ\u00e9\u00c9\u00fc\u00df\u00e7\u00f1'--_ \n 19.,;\u4e2d\U0001d4b3\U0001f600", "e\u0301", *"abcdefg" * 3]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(300))) for _ in range(150)]
    # Long lines are cut into segments; blocks of prefix sums are crossed as well.
    texts.append(" ".join("".join(rng.choices("abcéÉ-", k=5)) for _ in range(4000)))
    texts.append("x" * 9000 + "é" * 3000 + " tail-End")
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in tokens(frame, ["id"]).orderBy("id", "start").collect():
        got.setdefault(r.id, []).append((r.word, r.line, r.column, r.start, r.end))
        line = texts[r.id].split("\n")[r.line - 1].encode()
        before = line[: r.column - 1].decode()
        after = line[r.column - 1 + r.end - r.start:].decode()
        word = line[r.column - 1:][: r.end - r.start].decode()
        assert r.context == (
            ("..." if len(before) > 20 else "") + before[-20:] + word + after[:20]
            + ("..." if len(after) > 20 else "")
        )
    for i, text in enumerate(texts):
        assert got.get(i, []) == plain_words(text), repr(text)
    counted = {r.id: r.n for r in words(frame, ["id"]).groupBy("id").agg(F.count("*").alias("n")).collect()}
    assert counted == {i: len(v) for i, v in got.items()}


def test_very_long_texts_are_counted_whole(spark):
    frame = spark.range(1).select("id", F.expr("repeat('someWord éé-x\\n', 120000) || 'tail'").alias("text"))
    got = {r.word: r.n for r in words(frame, ["id"]).groupBy("word").agg(F.count("*").alias("n")).collect()}
    assert got == {"some": 120000, "word": 120000, "éé": 120000, "tail": 1}


def test_skipped_regions_keep_positions(docs):
    text = "seé https://ex.com/pagé?q=one two me@host.example end"
    got = found(docs, text, skip_regions=[URL, EMAIL])
    assert [r.word for r in got] == ["seé", "two", "end"]
    for r in got:
        assert text.encode()[r.start:r.end].decode() == r.word
    assert "host" in [r.word for r in found(docs, text)]


def test_running_starts(spark):
    sizes = [0, 1, 31, 32, 33, 64, 65, 2000]
    rows = [(n, [i % 7 for i in range(n)]) for n in sizes]
    frame = spark.createDataFrame(rows, "n int, a array<int>")
    for r in frame.select("n", "a", running_starts(F.col("a")).alias("s")).collect():
        assert r.s == [sum(r.a[:i]) for i in range(r.n)]
