"""Ignore rules, personal lists and dictionary look-up."""

import random
import time

import pytest
from pyspark.sql import functions as F

from wordmend import runtime
from wordmend.functions.patterns import DEFAULT_IGNORE
from wordmend.operators.words import (
    drop_known,
    is_ignored,
    known_words,
    required_literal,
    unknown_words,
    valid_patterns,
)
from wordmend.sources.wordlists import builtin_words, listed_words, personal_words


def kept(words, text, *patterns):
    frame = words(text).where(~is_ignored(F.col("word"), patterns or DEFAULT_IGNORE))
    return [r.word for r in frame.collect()]


def test_ignore_rules(words):
    assert kept(words, "a é 12 ١٢ API api ABC_1 Éa ab" + "f" * 32) == ["é", "api", "Éa"]
    assert kept(words, "TODO fixme ÉTÉ") == ["fixme", "ÉTÉ"]


def test_classes_are_unicode(words):
    assert kept(words, "abc été x١y", r"^\w+$") == []
    assert kept(words, "v1 v١", r"\bv\d") == []


def test_patterns_see_the_original_case(words):
    assert kept(words, "Todo todo", "Todo") == ["todo"]


def test_invalid_patterns_are_skipped(spark):
    with pytest.warns(UserWarning, match="Invalid regex"):
        assert valid_patterns(spark, ["ok", "(", DEFAULT_IGNORE[0]]) == ["ok", DEFAULT_IGNORE[0]]


def test_many_invalid_patterns(spark):
    patterns = [f"w{i}" for i in range(40)] + ["(", "[a", "x{2", "*"]
    with pytest.warns(UserWarning) as warned:
        assert valid_patterns(spark, patterns) == patterns[:40]
    assert sum("Invalid regex" in str(w.message) for w in warned) == 4


@pytest.mark.parametrize(
    "pattern, literal",
    [
        ("owl", "owl"),
        (r"^grey\w+owls$", "grey"),
        (r"owls?", "owl"),
        ("ab*cde", "cde"),
        ("abc+d", "abc"),
        (r"a\.b\-c", "a.b-c"),
        ("[a-z]tion{2}s", "tio"),
        (r"\bfox\b", "fox"),
        ("ow", None),
        ("owl|fox", None),
        ("(owl)?fox", None),
        ("(?i)owl", None),
        (r"\p{L}owl", None),
        (r"\x41owl", None),
        (r"[\[x]owl", "owl"),
        ("[a[b]]owl", None),
    ],
)
def test_required_literals(pattern, literal):
    assert required_literal(pattern) == literal


def test_prefiltered_patterns_have_the_same_rows(spark):
    draw = random.Random(2)
    made = ["".join(draw.choices("abcé.-", k=draw.randrange(9))) for _ in range(3000)]
    parts = ["a", "b", "c", "é", r"\.", "-", "abc", "b?", "a+", "c*", "[ab]", ".", r"\w", "^", "$", "a{0,2}", "(b|c)"]
    patterns = ["".join(draw.choices(parts, k=draw.randrange(1, 6))) for _ in range(300)]
    patterns = valid_patterns(spark, [p for p in patterns if p.strip("^$")])
    assert sum(required_literal(p) is not None for p in patterns) > 50
    frame = spark.createDataFrame([(w,) for w in made], "word string")
    for few in (patterns[i : i + 10] for i in range(0, 100, 10)):
        each = F.lit(False)
        for p in few:
            each = each | F.col("word").rlike("(?U)" + p)
        plain = is_ignored(F.col("word"), ()) | each
        assert frame.where(is_ignored(F.col("word"), few) != plain).count() == 0


def test_a_thousand_patterns_cost_little_more_than_ten(spark):
    """Most words have none of the literals, whatever their number."""
    words = spark.range(150_000).select(F.concat(F.lit("q"), F.md5(F.col("id").cast("string"))).alias("word"))
    words = words.cache()
    words.count()

    def seconds(n):
        patterns = [f"^zz{'abcdefghij'[i % 10]}{i:04}x.*" for i in range(n)]
        rest = words.where(~is_ignored(F.col("word"), patterns))
        rest.agg(F.count("*")).collect()
        begun = time.perf_counter()
        assert rest.agg(F.count("*")).collect()[0][0] == 150_000
        return time.perf_counter() - begun

    assert seconds(1000) < 3 * seconds(10) + 0.5
    words.unpersist()


def test_personal_list(spark):
    lines = ["MyCompany", "", "# note", "  word  ", "#x", "word", "\tTab "]
    frame = spark.createDataFrame([(v,) for v in lines], "value string")
    assert sorted(r.word for r in personal_words(frame).collect()) == ["mycompany", "tab", "word"]


def test_raw_list(spark):
    frame = spark.createDataFrame([(v,) for v in [" Abc ", "a", "é", "", "abc"]], "value string")
    assert sorted(r.word for r in listed_words(frame).collect()) == ["abc", "abc", "é"]


def test_builtin_words(spark):
    assert builtin_words(spark).count() == 128
    assert builtin_words(spark, "en_GB").count() == 128
    assert builtin_words(spark, "fr_FR").count() == 10


def test_known_words_ignore_case(words):
    known = known_words(words("hello world test"), words("MyWord"))
    left = drop_known(words("Hello WORLD notfound myword Test"), known)
    assert [r.word for r in left.collect()] == ["notfound"]


@pytest.mark.parametrize("rows", [runtime.BROADCAST_ROWS, 0])
def test_unknown_words(words, monkeypatch, rows):
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", rows)
    got = unknown_words(words("Teh teh Teh cat ABC"), known_words(words("cat")))
    assert sorted((r.word, r.w, r.n) for r in got.collect()) == [("Teh", "teh", 2), ("teh", "teh", 1)]
