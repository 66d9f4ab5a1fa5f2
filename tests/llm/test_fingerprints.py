from hashlib import sha256

import numpy as np
import pytest
from llm_cases import words_of
from pyspark.sql import functions as F

from wordmend.llm import fingerprints
from wordmend.llm.words import hash_of


def check(frame, got):
    order = sorted(
        frame.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect(),
        key=lambda r: (-(r.doc_id if r.doc_id is not None else -(1 << 63)), r.h),
    )
    expected, nexts = [], {}
    for i, r in enumerate(order):
        after = order[(i + 1) % len(order)]
        third = len(r.text) // 3
        text = r.text[: len(r.text) - third] + after.text[:third]
        expected.append((r.doc_id, len(r.text), sha256(text.encode()).hexdigest()))
        nexts[r.doc_id, expected[-1][2]] = after
    assert sorted(((g.doc_id, g.n_chars, g.edited_sha256) for g in got), key=str) == sorted(expected, key=str)
    prints = {(g.doc_id, g.n_chars): g.fingerprint for g in got}
    for g in got:
        after = nexts[g.doc_id, g.edited_sha256]
        assert g.near_next == fingerprints.likeness(g.fingerprint, prints[after.doc_id, len(after.text)])
        assert g.near_edited == fingerprints.likeness(g.fingerprint, g.edited_fingerprint)


def test_real_tables(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
    got = fingerprints.compare_edits(frame).collect()
    check(frame, got)
    texts = {r.doc_id: r.text for r in frame.collect()}
    by_text = {}
    for g in got:
        by_text.setdefault(texts[g.doc_id], set()).add(g.fingerprint)
    assert all(len(prints) == 1 for prints in by_text.values())
    assert np.mean([g.near_edited for g in got]) > np.mean([g.near_next for g in got]) + 0.2
    alone = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(frame).collect()}
    assert alone == {g.doc_id: g.fingerprint for g in got}


def test_lexicon_is_the_band(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    texts = [set(words_of(r.text)) for r in frame.collect()]
    count = {w: sum(w in t for t in texts) for w in set().union(*texts)}
    low, high = max(2, fingerprints.LEAST * len(texts)), fingerprints.MOST * len(texts)
    expected = sorted(hash_of(w) for w, n in count.items() if low <= n <= high)
    assert fingerprints.lexicon(frame).tolist() == expected


def test_parts_follow_the_words_only():
    terms = np.sort(np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64))
    whole = fingerprints.parts_of(terms)
    assert (whole != 0).all()
    assert (fingerprints.parts_of(terms[:0]) == 0).all()
    one = fingerprints.parts_of(terms[:1])
    assert 0.2 < (one[:24] != 0).mean() < 0.8  # a half of the dense subsets has it


def test_likeness():
    assert fingerprints.likeness("text-a", "text-a") == 1.0
    assert fingerprints.likeness("text-a", "text-b") == 0.0
    terms = np.arange(1, 200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a, b = (fingerprints.parts_of(np.sort(t)).tobytes().hex() for t in (terms, terms[:190]))
    other = fingerprints.parts_of(np.sort(terms * np.uint64(3))).tobytes().hex()
    assert fingerprints.likeness(a, a) == 1.0
    assert fingerprints.likeness(a, b) > 0.5 > fingerprints.likeness(a, other)


def test_odd_rows(clashing):
    check(clashing, fingerprints.compare_edits(clashing).collect())


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few(make, n):
    frame = make(*["abc def", "ghijkl"][:n])
    got = fingerprints.compare_edits(frame).collect()
    assert len(got) == n
    if n:
        check(frame, got)
