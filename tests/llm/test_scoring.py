import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_cases import low
from pyspark.sql import functions as F

from wordmend.llm import scoring

sentencepiece = pytest.importorskip("sentencepiece")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", low(text or ""))


@pytest.fixture(scope="module")
def pieces():
    return scoring.Pieces.load()


def test_likelihood_is_the_sum_over_all_segmentations(pieces):
    weight = {}
    for spelling, w in zip(pieces.spellings, pieces.weights, strict=True):
        weight[spelling] = weight.get(spelling, 0) + math.exp(w)
    random.seed(4)
    some = ["".join(random.choices("etaoin é😀x", k=random.randint(1, 12))) for _ in range(50)] + ["x" * 90]
    spelled = [b" " + w.replace(" ", "").encode() for w in some]
    lattice = scoring.Lattice(pieces)
    got, expected = scoring.likelihoods(lattice, lattice.weights(pieces), spelled, np.ones(len(spelled)))
    for word, log in zip(spelled, got, strict=True):
        total = [1.0] + [0.0] * len(word)
        for j in range(1, len(word) + 1):
            total[j] = sum(total[i] * weight.get(word[i:j], 0) for i in range(j))
        assert log == pytest.approx(math.log(total[-1]))
    # Expected pieces spell every byte once.
    lengths = np.zeros(len(lattice.keys))
    lengths[lattice.group] = [len(s) for s in pieces.spellings]
    assert (expected * lengths).sum() == pytest.approx(sum(map(len, spelled)))


def check_base(rows, got):
    train = Counter()
    for r in rows:
        if r.trains:
            train.update([*tokens(r.text), None])
    n, types = sum(train.values()), len(train)
    expected = Counter()
    for r in rows:
        own = [*tokens(r.text), None]
        base = sum(math.log10((train[t] + 1) / (n + types + 1)) for t in own)
        expected[r.doc_id, len(own), sum(train[t] > 0 for t in own), n, round(base, 6)] += 1
    assert Counter((g.doc_id, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 6)) for g in got) == expected
    assert all(math.isfinite(g.score) and g.score <= 0 for g in got)


@pytest.mark.parametrize("broadcast", [1 << 21, 50])
def test_real_tables(spark, monkeypatch, broadcast):
    """With few words broadcast, the rest comes by the join: same results."""
    monkeypatch.setattr(scoring, "_BROADCAST", broadcast)
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    trains = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    got = scoring.score(frame, trains).collect()
    check_base(frame.select("doc_id", "text", trains.alias("trains")).collect(), got)
    held = {r.doc_id for r in frame.where(~trains).collect()}
    rates = [(g.base_score / g.n_tokens, g.score / g.n_tokens) for g in got if g.doc_id in held and g.n_tokens > 50]
    assert np.corrcoef(*zip(*rates, strict=True))[0, 1] > 0.3


def test_scores_tell_text_from_noise(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang = 'en'").limit(50)
    random.seed(1)
    rows = [(i, r.text) for i, r in enumerate(frame.collect())]
    noise = [(1000 + i, "".join(random.sample(t, len(t)))) for i, t in rows]
    both = spark.createDataFrame(rows + noise, "doc_id bigint, text string")
    got = {g.doc_id: g for g in scoring.score(both, F.col("doc_id") < 1000).collect()}
    rate = lambda i: got[i].score / len(dict(rows + noise)[i])
    assert np.mean([rate(i) > rate(1000 + i) for i, t in rows if len(t) > 100]) > 0.95


def test_odd_rows(clashing):
    trains = F.coalesce(F.col("doc_id"), F.lit(0)) % 2 == 1
    got = scoring.score(clashing, trains).collect()
    check_base(clashing.select("doc_id", "text", trains.alias("trains")).collect(), got)


def test_nothing_to_learn_from(odd, empty):
    got = scoring.score(odd, F.lit(False)).collect()
    assert {(g.n_known, g.train_tokens, g.base_score) for g in got} == {(0, 0, 0.0)}
    assert scoring.score(empty, F.lit(True)).count() == 0
