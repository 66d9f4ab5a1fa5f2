import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wordmend.llm import packing
from wordmend.llm import words as W

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def tokenizer():
    return tokenizers.Tokenizer.from_file(packing.vocabulary_path(packing.VOCABULARY))


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END]


@pytest.mark.parametrize("piece", [1 << 18, 50])
def test_ids_are_the_tokenizers(tokenizer, monkeypatch, piece):
    monkeypatch.setattr(W, "_PIECE", piece)
    W._scale.clear()
    random.seed(piece)
    letters = "abcXYZ éÉÀß×÷ÿŒœ'<|>.,!12 \n\t\x0b\x1c\x85\xa0 “”—😀İΣς日本́­_"
    texts = ["".join(random.choices(letters, k=random.choice([0, 1, 3, 10, 60]))) for _ in range(1500)]
    texts += ["<|endoftext|> a <|ENDOFTEXT|>", "it's I'LL 's", None, "", "   ", " Éa" * 50]
    encoder = packing.Encoder(packing.vocabulary_path(packing.VOCABULARY))
    ids, first = encoder.ids(pa.array(texts))
    for i, text in enumerate(texts):
        assert [*ids[first[i] : first[i + 1]], packing.END] == ids_of(tokenizer, text)
    W._scale.clear()


def test_forgetting_changes_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "_REMEMBERED", 3)
    encoder = packing.Encoder(packing.vocabulary_path(packing.VOCABULARY))
    for text in ("one two three four five", "five six one", "one two"):
        assert encoder.ids(pa.array([text]))[0].tolist() == ids_of(tokenizer, text)[:-1]


def check_places(rows, sequence):
    """No gaps, no overlaps, nothing beyond the end."""
    for _, group in rows.groupby("sequence_id"):
        group = group.sort_values("offset")
        assert group.offset.tolist() == [0, *np.cumsum(group.length)[:-1]]
        assert group.length.sum() <= sequence


def test_pieces_of_odd_documents(clashing, tokenizer):
    rows = packing.pack(clashing, with_ids=True).toPandas()
    check_places(rows, packing.SEQUENCE)
    texts = [(r.doc_id, r.text) for r in clashing.select("doc_id", "text").collect()]
    expected = []
    for key, text in texts:
        ids = np.array(ids_of(tokenizer, text), "<u4")
        for piece, at in enumerate(range(0, len(ids), packing.SEQUENCE)):
            part = ids[at : at + packing.SEQUENCE]
            expected.append((key, piece, at, len(part), zlib.crc32(part.tobytes())))
    got = [
        (None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32)
        for r in rows.itertuples()
    ]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows.itertuples())


def test_sequences_hold_the_ids(make):
    packed = packing.pack(make("a b c", "d e", None, "f " * 50), sequence=20, with_ids=True)
    rows = packed.toPandas()
    joined = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    for r in rows.itertuples():
        assert joined[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)


def test_empty(empty):
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize(
    "counts",
    [
        {n: 1 + n % 5 for n in range(1, 4097)},
        {n: 10**7 for n in range(1, 4097, 3)},
        {n: 10**6 // n + 1 for n in range(1, 4097)},
        {4096: 3},
        {1: 1},
        {1400: 10, 1300: 5},
        {},
    ],
)
def test_plan_uses_every_piece_once(counts):
    plan = packing.best_two_fit(counts)
    used = {}
    for times, filling in plan:
        assert times > 0 and sum(length * n for length, n in filling.items()) <= packing.SEQUENCE
        for length, n in filling.items():
            used[length] = used.get(length, 0) + n * times
    assert used == counts
    sequences = sum(times for times, _ in plan)
    least = -(-sum(length * n for length, n in counts.items()) // packing.SEQUENCE)
    assert sequences <= max(least * 1.01 + 1, least if len(counts) > 3 else 7)


def test_two_pieces_replace_the_shortest():
    # 60 + 30 leaves 10; 30 goes for 25 + 14, which leaves 1.
    left = np.zeros(101, np.int64)
    left[[60, 30, 25, 14]] = 1
    assert packing._fill(left, 100) == {60: 1, 25: 1, 14: 1}


def test_places_of_many_equal_lengths(spark):
    cut = spark.range(5000).select("id", F.lit(7).cast("bigint").alias("length"))
    rows = packing.place(cut, 100).toPandas()
    check_places(rows, 100)
    assert rows.sequence_id.nunique() == -(-5000 // 14)
