import numpy as np
import pytest
from pyspark.sql import functions as F

from wordmend.llm import neighbours

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, k=5):
    ids = np.array([i for i, _ in rows])
    matrix = np.array([v for _, v in rows], np.float32).astype(float)
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    expected = {}
    for at in np.flatnonzero(ids % 50 == 0):
        score = unit @ unit[at]
        order = [j for j in np.lexsort((ids, -np.round(score, 12))) if ids[j] != ids[at]][:k]
        expected[int(ids[at])] = [(int(ids[j]), score[j]) for j in order]
    return expected


def found(frame, k=5):
    got = {}
    for r in neighbours.search(frame, F.col("vec_id") % 50 == 0, k).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    return got


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST_SIZE", 100)
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(32).tolist()) for i in range(3000)]
    got, expected = found(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)), brute(rows)
    assert got.keys() == expected.keys()
    hits = [len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) for q in expected]
    assert sum(hits) >= 0.95 * 5 * len(expected)
    scores = {q: dict(v) for q, v in brute(rows, 3000).items()}
    assert all(abs(scores[q][i] - s) < 1e-12 for q, v in got.items() for i, s in v)


def test_every_query_has_k_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST_SIZE", 100)
    monkeypatch.setattr(neighbours, "RECALL", 0.5)  # many true neighbours are in no probed list
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(32).tolist()) for i in range(2000)]
    rows += [(0, rng.standard_normal(32).tolist()) for _ in range(300)]
    frame = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    ranks = neighbours.search(frame, F.col("vec_id") % 50 == 0).groupBy("query_id", "rank").count().collect()
    want = {(q, r): 1 if q else 301 for q in range(0, 2000, 50) for r in range(1, 6)}
    assert {(r.query_id, r["rank"]): r["count"] for r in ranks} == want


def test_scan_keeps_k_beyond_the_radius():
    rng = np.random.default_rng(5)
    index = neighbours.Index(rng.standard_normal((500, 64)), 4)
    for n in (0, 3, 500):
        assert len(neighbours.adaptive_scan(index.sample[:n], index.sample[0], 1e-9, 5)) == min(n, 5)


def test_one_vector_in_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART", 100)
    rng = np.random.default_rng(1)
    common = rng.standard_normal(8).tolist()
    rows = [(i, common if i % 3 == 0 else rng.standard_normal(8).tolist()) for i in range(900)]
    got, expected = found(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)), brute(rows)
    for q in expected:
        if q % 3 == 0:
            assert [i for i, _ in got[q]] == [i for i, _ in expected[q]]
            assert len({s for _, s in got[q]}) == 1


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (50, [0.0, 2.0], 1), (1, [1.0, 1.0], 1), (2, [1e30, 0.0], 1)]
    bad = [
        (100, None, 1), (150, [0.0, 0.0], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (5, [None, 1.0], 1),
        (6, [], 1), (7, [1.0, 2.0, 3.0], 1), (None, [1.0, 0.0], 1),
    ]
    frame = spark.createDataFrame(rows + bad, SCHEMA).selectExpr(
        "*", "'x' AS id", "'x' AS vector", "1 AS list", "2 AS rank", "3 AS score", "4 AS query_id"
    )
    got = found(frame)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {0: [2, 1, 50], 50: [1, 0, 0, 2]}
    assert got[0][1][1] == pytest.approx(0.5**0.5, abs=1e-15)


def test_empty_and_alone(spark):
    assert neighbours.search(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
    assert neighbours.search(spark.createDataFrame([(0, None, 1)], SCHEMA), F.lit(True)).count() == 0
    assert neighbours.search(spark.createDataFrame([(0, [1.0], 1)], SCHEMA), F.lit(True)).count() == 0


def test_scan_abandons_but_keeps_the_nearest():
    rng = np.random.default_rng(2)
    index = neighbours.Index(rng.standard_normal((2000, 64)), 4)
    query = index.sample[17]
    exact = ((index.sample - query) ** 2).sum(1)
    radius = float(np.sort(exact)[6])
    kept = neighbours.adaptive_scan(index.sample, query, radius, 5)
    assert len(kept) < 50
    assert len(set(np.argsort(exact)[:6]) & set(kept)) >= 5
