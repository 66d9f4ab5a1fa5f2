import random

import numpy as np
import pyarrow as pa
import pytest

from wordmend.llm import language

SOUNDS = {"aa": "kal mor ti ran ose", "bb": "zhu xiq vlo wub gnu", "cc": "éna ôri çul âmé ïto"}


def text_in(lang, seed, n=60):
    random.seed(f"{lang}{seed}")
    return " ".join("".join(random.choices(SOUNDS[lang].split(), k=random.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rows = [(text_in(lang, i), lang) for lang in SOUNDS for i in range(40)]
    rows += [("no label", None), (None, "aa"), ("", "bb"), ("12 !!", "dd")]
    return language.fit(spark.createDataFrame(rows, "text string, lang string"))


def pieces(sample, text):
    """Greedy parse into the longest pieces that occur in the sample."""
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size <= len(text) and text[at : at + size] in sample:
            size += 1
        at += max(1, size - 1)
        n += 1
    return n


def test_automaton_parses_like_substring_search():
    random.seed(3)
    for _ in range(30):
        sample = "".join(random.choices("abc ", k=60)).strip() or "a"
        text = " ".join("".join(random.choices("abcd ", k=80)).split())
        letters = "abc"
        code = {c: i for i, c in enumerate(letters, 2)} | {" ": 0}
        automaton = language.SuffixAutomaton([code[c] for c in sample])
        one = language.Model(letters, ["x"], [automaton.edges()], [len(automaton.next)], [1.0])
        got = language.costs(one, one.tables(), pa.array([text]))[0, 0] * len(text)
        assert got == pytest.approx(pieces(sample, text))


def test_held_out_accuracy(spark, model):
    rows = [(lang, text_in(lang, 1000 + i, 8)) for lang in SOUNDS for i in range(50)]
    got = language.predict(spark.createDataFrame(rows, "truth string, text string"), model).collect()
    assert np.mean([r.truth == r.lang_pred for r in got]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_real_tables(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = language.fold(frame["doc_id"], 4) == 2
    found = language.predict(frame.where(held), language.fit(frame.where(~held))).toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.95


def test_odd_rows(clashing):
    model = language.fit(clashing)
    rows = language.predict(clashing, model).collect()
    assert len(rows) == clashing.count()
    for r in rows:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
        assert r.lang_pred != "und" or r.score == 0
    assert {r["key"] for r in rows} == {"x"}


def test_language_of_many_copies(spark):
    rows = [(text_in("aa", i), "aa") for i in range(40)]
    rows += [(text_in("bb", k), f"b{k}") for k in range(8) for _ in range(5000)]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert model.languages == ["aa", *(f"b{k}" for k in range(8))]


def test_languages_of_many_letters(spark):
    def text(lang, seed):
        random.seed(f"{lang}{seed}")
        if lang == "latin":
            return text_in("aa", seed, 200)
        first = {"x": 0x4E00, "y": 0x5E00, "z": 0x0430, "w": 0x0561}[lang]
        return " ".join("".join(chr(first + random.randrange(30 if lang in "zw" else 400)) for _ in range(5)) for _ in range(40))

    rows = [(text(lang, i), lang) for lang in ("latin", "x", "y", "z", "w") for i in range(60)]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"))
    held = [(lang, text(lang, 1000 + i)) for lang in ("latin", "x", "y", "z", "w") for i in range(20)]
    got = language.predict(spark.createDataFrame(held, "truth string, text string"), model).collect()
    assert [r.lang_pred for r in got] == [r.truth for r in got]
    # Letters that no sample has match nothing: every one is a piece.
    bits = language.costs(model, model.tables(), pa.array(["\u10d0\u10d1\u10d2" * 9]))[0]
    assert bits == pytest.approx(model.costs)


def test_sparse_automaton_parses_like_substring_search():
    random.seed(4)
    letters = "".join(chr(0x4E00 + i) for i in range(150))
    code = {c: i for i, c in enumerate(letters, 2)} | {" ": 0}
    sample = letters + "".join(random.choices(letters[:20], k=800))
    text = "".join(random.choices(letters[:30] + "\u9000", k=200))
    automaton = language.SuffixAutomaton([code[c] for c in sample])
    one = language.Model(letters, ["x"], [automaton.edges()], [len(automaton.next)], [1.0])
    got = language.costs(one, one.tables(), pa.array([text]))[0, 0] * len(text)
    assert got == pytest.approx(pieces(sample, text))


def test_long_text_is_read_whole(spark, model):
    text = text_in("aa", 1, 400) + " " + text_in("bb", 2, 4000)
    assert language.predict(spark.createDataFrame([(text,)], "text string"), model).first().lang_pred == "bb"


def test_nothing_labelled(spark, empty, odd):
    model = language.fit(empty)
    assert {r.lang_pred for r in language.predict(odd, model).collect()} == {"und"}
    assert language.predict(empty, model).count() == 0


def test_many_languages_share_a_bounded_sample(spark):
    """Sixty languages of the same letters: the automata together stay within the given letters."""
    languages = [f"l{i:02}" for i in range(60)]
    rows = []
    for name in languages:
        draw = random.Random(name)
        syllables = ["".join(draw.choices("abcdefgh", k=draw.choice((2, 3)))) for _ in range(9)]
        for _ in range(14):
            text = " ".join("".join(draw.choices(syllables, k=draw.choice((1, 2)))) for _ in range(60))
            rows.append((len(rows), text, name))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    known, asked = frame.where("doc_id % 7 <> 3"), frame.where("doc_id % 7 = 3")
    model = language.fit(known, letters_per_document=200, letters=120_000)
    assert model.languages == languages
    sizes = [2 ** cost - 1 for cost in model.costs]
    assert sum(sizes) <= 120_000 + 60 * 20 and max(sizes) <= 10 * 201
    found = language.predict(asked, model).collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.95 * len(found)


def test_tables_take_the_room_of_their_transitions():
    """Whatever the number of symbols; a column for each would be 4 * 53 bytes a state."""
    draw = random.Random(5)
    letters = "".join(chr(97 + i) for i in range(26)) + "".join(chr(0x3B1 + i) for i in range(25))
    code = {c: i for i, c in enumerate(letters, 2)} | {" ": 0}
    automaton = language.SuffixAutomaton([code[c] for c in letters + "".join(draw.choices(letters, k=20_000))])
    one = language.Model(letters, ["x"], [automaton.edges()], [len(automaton.next)], [1.0])
    (table,) = one.tables()
    size = sum(x.nbytes for x in vars(table).values() if isinstance(x, np.ndarray))
    assert size <= 16 * (len(automaton.next) + len(one.edges[0]))
    # The same transitions as the automaton's, and from the root without one.
    for state in draw.sample(range(len(automaton.next)), 500):
        for symbol in (0, 1, *range(2, len(letters) + 2)):
            row = automaton.next[state]
            begun = state == 0 or symbol not in row
            to = (automaton.next[0] if begun else row).get(symbol, 0)
            found = table.after(np.array([state]), table.own[[symbol]])[0]
            assert (found >> 2, found & 3) == (to, begun)
