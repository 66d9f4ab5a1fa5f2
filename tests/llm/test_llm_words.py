import random

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import WORD, low

from wordmend.llm import words as W


@pytest.mark.parametrize("piece", [7, 64, 1 << 18])
def test_words_and_hashes(monkeypatch, piece):
    monkeypatch.setattr(W, "_PIECE", piece)
    W._scale.clear()
    random.seed(piece)
    texts = ["".join(random.choices("ab Zé.1\n-😀", k=k)) for k in (0, 1, 5, 40, 300) for _ in range(30)]
    texts += [None, ""]
    found = W.words(pa.array(texts))
    seen = {}
    for i, text in enumerate(texts):
        expected = WORD.findall(low(text or ""))
        assert len(found.of(i)) == len(expected)
        for word, value in zip(expected, found.of(i), strict=True):
            assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)
    W._scale.clear()


def test_shingles_of_short_texts():
    five = np.arange(5, dtype=np.uint64)
    assert len(W.shingles(five)) == 1
    assert len(W.shingles(five[:3])) == 1
    assert len(W.shingles(five[:0])) == 0
    assert len(W.shingles(np.arange(9, dtype=np.uint64))) == 5


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 9, None, "", "y" * 30, "z"])], names=["text"])
    parts = list(W.slices(iter([batch]), 10))
    assert sum(len(p) for p in parts) == 5 and len(parts) > 1
