import pyarrow as pa
import pytest
from llm_cases import low, sentences, words_of
from pyspark.sql import functions as F

from wordmend.llm import repeats
from wordmend.llm.words import words


def brute(rows):
    """Removed words of ``(key, text)`` rows in order of the key."""
    seen, removed = set(), []
    for _, text in rows:
        found = words(pa.array([text]))
        edges = [*repeats.sentence_starts(found), len(found.starts)]
        tokens = [low(bytes(found.data[a:b]).decode()) for a, b in zip(found.starts, found.ends, strict=True)]
        runs, last = set(), len(edges) - 1
        for i in range(last):
            ends = (j for j in range(i + 2, last + 1) if edges[j] - edges[i] >= repeats.MIN_WORDS)
            runs |= {(i, j) for j in [next(ends, None)] if j}
        for j in range(1, last + 1):
            starts = (i for i in range(j - 2, -1, -1) if edges[j] - edges[i] >= repeats.MIN_WORDS)
            runs |= {(i, j) for i in [next(starts, None)] if i is not None}
        gone = set()
        for i, j in sorted(runs):
            span = tuple(tokens[edges[i] : edges[j]])
            if span in seen:
                gone |= set(range(edges[i], edges[j]))
            seen.add(span)
        removed.append(len(gone))
    return removed


def test_real_tables(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(6)
    got = {r.doc_id: r for r in repeats.without_repeats(frame).collect()}
    rows = sorted((r.doc_id, r.text) for r in frame.collect())
    assert [got[k].removed_words for k, _ in rows] == brute(rows)
    for key, text in rows:
        raw = text.encode()
        for span in reversed(got[key].removed):
            raw = raw[: span.start] + raw[span.end :]
        assert raw.decode() == got[key].text


@pytest.mark.parametrize("parts", [1, 5])
def test_passage_inside_other_text(make, parts):
    passage = sentences(5, 500, 11)  # 55 words
    texts = [f"{sentences(6, 10 * i)} and then {i}x {passage} {sentences(4, 10 * i + 6)}" for i in range(20)]
    frame = make(*texts).repartition(parts, F.rand(3))
    got = {r.doc_id: r for r in repeats.without_repeats(frame).collect()}
    assert got[0].text == texts[0] and got[0].removed_words == 0
    for i in range(1, 20):
        assert got[i].text == texts[i].replace(passage + " ", "")
        assert got[i].removed_words == 55


def test_passage_without_punctuation(make):
    passage = " ".join(f"w{i * 7919 % 10007}" for i in range(300))
    got = repeats.without_repeats(make(f"Alpha {passage} omega.", f"Other start {passage} other end.")).collect()
    assert sorted(r.removed_words for r in got)[0] == 0
    assert max(r.removed_words for r in got) > 200


def made_up(n, seed, comma=""):
    return f"{comma} ".join(f"w{(i * 7919 + seed * 104729) % 1000003}" for i in range(n))


@pytest.mark.parametrize("size", [51, 55, 60])
def test_passage_of_one_sentence(make, size):
    passages = [f"P{made_up(size, 1 + k, ',')}." for k in range(40)]
    texts = [f"Begin {made_up(5, 500 + i)}. {passages[i // 2]} E{i} {made_up(5, 900 + i)}." for i in range(80)]
    got = {r.doc_id: r for r in repeats.without_repeats(make(*texts)).collect()}
    assert [got[i].removed_words for i in range(80)] == [0, size] * 40


@pytest.mark.parametrize("size", [51, 55, 60])
def test_passage_without_punctuation_in_other_text(make, size):
    texts = [f"{made_up(30, 500 + i)} {made_up(size, 1 + i // 2)} {made_up(30, 900 + i)}" for i in range(80)]
    got = {r.doc_id: r for r in repeats.without_repeats(make(*texts)).collect()}
    for i in range(1, 80, 2):
        assert got[i - 1].removed_words == 0
        assert size - 2 * repeats._WINDOW <= got[i].removed_words <= size


def test_short_repeats_stay(make):
    got = repeats.without_repeats(make("Just a short line. The end.", "Just a short line. The end."))
    assert [r.removed_words for r in got.collect()] == [0, 0]


def test_within_one_document(make):
    passage = sentences(5)
    (row,) = repeats.without_repeats(make(f"{passage}\n{passage}")).collect()
    assert len(words_of(row.text)) == len(words_of(passage)) and row.removed_words == 45


def test_marks_carry_over_batches():
    def batch(*rows):
        columns = zip(*((k, v, h, at, at + 1, bool(later)) for k, v, h, at, *later in rows), strict=True)
        names = ["key", "version", "hash", "start", "end", "later"]
        return pa.RecordBatch.from_arrays([pa.array(list(c)) for c in columns], names=names)

    batches = [batch((1, 0, 5, 0), (2, 0, 5, 0)), batch((3, 0, 5, 4), (1, 0, 6, 9)), batch((1, 0, 6, 9), (9, 0, 7, 1, True))]
    out = [tuple(r.values()) for b in repeats._mark(iter(batches)) for r in b.to_pylist()]
    assert out == [(2, 0, 0, 1), (3, 0, 4, 5), (9, 0, 1, 2)]


def test_odd_rows(clashing):
    found = repeats.without_repeats(clashing)
    rows = found.collect()
    assert len(rows) == clashing.count()
    assert set(found.columns) == set(clashing.columns)
    by_key = {}
    for r in rows:
        by_key.setdefault(r.doc_id, []).append(r)
    assert [r.removed_words for r in by_key[1]] == [0, 0]
    assert by_key[2][0].text.strip() == "" and by_key[2][0].removed_words == 108
    assert by_key[6][0].text is None and by_key[7][0].removed_words == 0


def test_empty(empty):
    assert repeats.without_repeats(empty).count() == 0
