"""Suggestions against a plain restatement of the cascade."""

import random

import pytest
from pyspark.sql import functions as F

from wordmend import runtime
from wordmend.functions.edits import letter_mask, may_be_within, variants
from wordmend.operators import suggest as module
from wordmend.operators.suggest import (
    CLOSE,
    WIDE,
    near_words,
    prefix_matches,
    short_word_candidates,
    suggest,
    variant_matches,
)

TYPOS = dict(zip("aeiobcfgmst", "eiouvkvjnzd", strict=True))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def all_variants(w):
    out = [w[:i] + w[i + 1:] for i in range(len(w))]
    out += [w[:i] + w[i + 1] + w[i] + w[i + 2:] for i in range(len(w) - 1)]
    return out + [w[:i] + TYPOS[c] + w[i + 1:] for i, c in enumerate(w) if c in TYPOS]


def expected(word, dictionary, k):
    """The stages one after the other, stopping at k."""
    ordered = sorted(dictionary, key=lambda d: d.encode())
    out = []

    def add(candidates):
        for c in candidates:
            if c not in out and len(out) < k:
                out.append(c)

    def nearest(candidates, limit):
        near = [(distance(word, c), i, c) for i, c in enumerate(candidates)]
        return [c for d, _, c in sorted(near) if d <= limit]

    if len(word) >= 3:
        add(nearest([d for d in ordered if d.startswith(word[:3])], 2))
    add(v for v in all_variants(word) if v in dictionary)
    if len(word) >= 2:
        add(nearest([d for d in ordered if d.startswith(word[:2])], 3))
    if len(word) <= 3:
        add(nearest([d for d in ordered if abs(len(d) - len(word)) <= 1][:100], 2))
    return out


def random_words(rng, n, letters, longest):
    return {"".join(rng.choices(letters, k=rng.randint(1, longest))) for _ in range(n)}


@pytest.fixture(scope="module")
def vocabulary():
    rng = random.Random(11)
    dictionary = random_words(rng, 900, "abesté", 6) | random_words(rng, 300, "abes", 4)
    dictionary |= random_words(rng, 200, "abest", 9)
    asked = random_words(rng, 500, "abesté", 9) | {"a", "é", "zz", "zzzzzzzz", "ab" * 30}
    return sorted(dictionary), sorted(asked - dictionary)


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "word string")


@pytest.mark.parametrize("k", [1, 5])
@pytest.mark.parametrize("way", ["one round", "two rounds", "shuffled", "shuffled, pieces"])
def test_against_the_cascade(spark, vocabulary, monkeypatch, way, k):
    dictionary, asked = vocabulary
    if way != "one round":
        monkeypatch.setattr(module, "FEW_CANDIDATES", 0)
    if way.startswith("shuffled"):
        monkeypatch.setattr(module, "MANY_CANDIDATES", 0)
        monkeypatch.setattr(module, "LONG_WORD", 6 if "pieces" in way else 16)
    got = suggest(frame(spark, asked), frame(spark, dictionary), k).collect()
    assert len(got) == len(asked)
    known = set(dictionary)
    for r in got:
        assert r.suggestions == expected(r.word, known, k), r.word


@pytest.mark.parametrize("rows", [runtime.BROADCAST_ROWS, 0])
def test_candidates(spark, vocabulary, monkeypatch, rows):
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", rows)
    dictionary, asked = vocabulary
    for kind, same, limit in ((CLOSE, 3, 2), (WIDE, 2, 3)):
        got = near_words(frame(spark, asked), frame(spark, dictionary), kind).collect()
        want = {
            (a, d, distance(a, d))
            for a in asked for d in dictionary
            if len(a) >= same and a[:same] == d[:same] and distance(a, d) <= limit
        }
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    got = variant_matches(frame(spark, asked), frame(spark, dictionary)).collect()
    want = {(a, v, all_variants(a).index(v)) for a in asked for v in all_variants(a) if v in set(dictionary)}
    assert {tuple(r) for r in got} == want


def test_very_long_words(spark, monkeypatch):
    """300 letters: found by a piece, without making all strings with letters left out."""
    monkeypatch.setattr(module, "MANY_CANDIDATES", 0)
    rng = random.Random(5)
    long_words = ["".join(rng.choices("abcde", k=300)) for _ in range(5)]
    asked = [w[:50] + w[51:120] + "zz" + w[120:] for w in long_words] + [w[:-3] for w in long_words]
    got = near_words(frame(spark, asked), frame(spark, long_words), WIDE).collect()
    assert {tuple(r) for r in got} == {(a, w, 3) for a, w in zip(asked, long_words * 2, strict=True)}


def test_the_index_is_measured(spark, monkeypatch):
    """What is sent has several entries for each word, so fewer words than rows fit."""
    words = frame(spark, [f"word{i:03}" for i in range(100)])
    for rows, sent in ((250, False), (1000, True)):
        monkeypatch.setattr(runtime, "BROADCAST_ROWS", rows)
        find = module._finder(words, [CLOSE, WIDE, module.LEADING], 1.0)
        assert (find is module._hits_by_broadcast) == sent


def test_prefix_matches(spark):
    got = prefix_matches(frame(spark, ["abcx", "ab", "zzz"]), frame(spark, ["abc", "abd", "abcd", "abca"]), 3)
    assert [tuple(r) for r in got.collect()] == [("abcx", 3, "abc", "abcd")]


def test_short_words_try_only_the_first_hundred(spark):
    many = [f"{a}{b}" for a in "abcdefghijk" for b in "abcdefghijk"] + ["zz"]
    got = short_word_candidates(frame(spark, many)).where("for_size = 2").collect()
    assert sorted(r.word for r in got) == sorted(many)[:100]
    (row,) = suggest(frame(spark, ["zx"]), frame(spark, many), 200).collect()
    assert row.suggestions == sorted(many)[:100]


def test_variants_in_order(spark):
    (row,) = frame(spark, ["hello"]).select(variants(F.col("word")).alias("v")).collect()
    assert row.v == all_variants("hello")
    assert "hllo" in row.v and "ehllo" in row.v


def test_letter_mask_never_hides_a_near_word(spark, vocabulary):
    dictionary, asked = vocabulary
    pairs = [(a, d) for a in asked[::5] for d in dictionary[::5]]
    near = (
        spark.createDataFrame(pairs, "a string, d string")
        .where(F.levenshtein("a", "d") <= 2)
        .where(~may_be_within(letter_mask(F.col("a")), letter_mask(F.col("d")), 2))
    )
    assert near.count() == 0


def test_distance(spark):
    pairs = [("hello", "hello"), ("hello", "hallo"), ("hello", "hullo"), ("hello", "world"), ("é", "e")]
    got = spark.createDataFrame(pairs, "a string, b string").select(F.levenshtein("a", "b")).collect()
    assert [r[0] for r in got] == [0, 1, 1, 4, 1]


def _crowd(spark, letters=60):
    """Words of 3 to 5 letters under one prefix: all share the string that three deletions leave."""
    alphabet = [chr(0x4E00 + i) for i in range(letters)]
    ends = [*alphabet, *(a + b for a in alphabet for b in alphabet)]
    ends += [a + b + c for a in alphabet for b in alphabet for c in alphabet]
    return ["ab" + end for end in ends]


def test_keys_that_are_hot_on_both_sides(spark):
    dictionary = _crowd(spark)
    assert len(dictionary) > 200_000
    asked = [w + "x" for w in dictionary[5:200_000:25_000]]
    entries = spark.createDataFrame([(w,) for w in dictionary], "candidate string").withColumn(
        "key", F.left("candidate", F.lit(2))
    )
    words = spark.createDataFrame([(w,) for w in asked], "word string").withColumn(
        "key", F.left("word", F.lit(2))
    )
    met = runtime.two_sided_join(words, entries, "key", [F.col("word")], [F.col("candidate")])
    tasks = met.groupBy(F.spark_partition_id().alias("task")).count().collect()
    pairs = [r["count"] for r in tasks]
    assert sum(pairs) == len(asked) * len(dictionary)
    assert max(pairs) <= 2 * sum(pairs) / runtime.shuffle_tasks(spark)


def test_a_crowd_under_one_prefix_has_the_same_suggestions(spark, monkeypatch):
    monkeypatch.setattr(module, "MANY_CANDIDATES", 0)
    dictionary = _crowd(spark, 18) + ["zz"]
    asked = [w + "x" for w in dictionary[3::700]] + ["abx", "zzz", "qqq"]
    words, entries = (spark.createDataFrame([(w,) for w in x], "word string") for x in (asked, dictionary))
    got = {r.word: r.suggestions for r in module.suggest(words, entries).collect()}
    assert got == {w: expected(w, set(dictionary), 5) for w in asked}


@pytest.mark.parametrize("left, right", [(3000, 3), (3, 3000), (300, 300), (0, 5)])
def test_two_sided_join_has_the_rows_of_a_join(spark, left, right):
    a = spark.range(left).select(F.lit("k").alias("key"), F.col("id").alias("a"))
    a = a.unionByName(spark.createDataFrame([("m", 1), ("only", 2)], "key string, a bigint"))
    b = spark.range(right).select(F.lit("k").alias("key"), F.col("id").alias("b"))
    b = b.unionByName(spark.createDataFrame([("m", 1), ("m", 2)], "key string, b bigint"))
    got = runtime.two_sided_join(a, b, "key", [F.col("a")], [F.col("b")])
    assert got.columns == ["key", "a", "b"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, a.join(b, "key").collect()))
