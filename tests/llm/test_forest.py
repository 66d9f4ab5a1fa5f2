"""Near-duplicate vectors against all pairs."""

import tracemalloc

import numpy as np
import pytest

from wordmend.llm import forest

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(ids, vectors, labels, threshold=forest.THRESHOLD):
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    linked = (units @ units.T >= threshold) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(linked, False)
    names = ids.copy()
    while True:
        new = np.array([min(n, names[row].min(initial=n)) for n, row in zip(names, linked)])
        if (new == names).all():
            return dict(zip(ids.tolist(), zip(linked.sum(1).tolist(), names.tolist())))
        names = new


def clustered(rng, size, dimensions=32, share=0.5, noise=0.05):
    """Vectors of which a share are near copies of few others."""
    vectors = rng.standard_normal((size, dimensions)).astype(np.float32)
    copies = rng.random(size) < share
    of = rng.integers(0, max(1, size // 10), size)
    vectors[copies] = vectors[of[copies]] + noise * rng.standard_normal((copies.sum(), dimensions))
    return vectors.astype(np.float32)


def run(spark, ids, vectors, labels, **options):
    rows = [(int(i), v.tolist(), int(k)) for i, v, k in zip(ids, vectors, labels)]
    found = forest.near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3), **options).collect()
    assert len(found) == len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)
    return {r.vec_id: (r.n_links, r.component_id) for r in found}


@pytest.mark.parametrize("part", [forest.PART, 300])
def test_recall(spark, part):
    """With small parts the top levels of trees divide every label."""
    rng = np.random.default_rng(3)
    vectors = clustered(rng, 3000)
    ids, labels = np.arange(3000) + 5, rng.integers(0, 2, 3000)
    got, want = run(spark, ids, vectors, labels, part=part), brute(ids, vectors.astype(float), labels)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.95 * sum(n for n, _ in want.values())
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.97 * len(want)


def test_pairs_at_the_threshold_are_found(spark):
    """All links between 0.93 and 0.95, where trees part most pairs."""
    rng = np.random.default_rng(9)
    base = rng.standard_normal((2000, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.standard_normal((2000, 32))
    other -= (other * base).sum(1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cosine = rng.uniform(0.93, 0.95, (2000, 1))
    vectors = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * other]).astype(np.float32)
    ids, labels = np.arange(4000), np.zeros(4000, int)
    got, want = run(spark, ids, vectors, labels), brute(ids, vectors.astype(float), labels)
    assert sum(n for n, _ in got.values()) >= 0.95 * sum(n for n, _ in want.values())


def test_one_dense_group_and_exact_copies(spark):
    """A third of all rows are near one vector, another third equals one."""
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((1500, 32)).astype(np.float32)
    vectors[:500] = vectors[0] + 0.02 * rng.standard_normal((500, 32))
    vectors[500:1000] = vectors[500]
    ids, labels = np.arange(1500), np.ones(1500, int)
    got, want = run(spark, ids, vectors, labels), brute(ids, vectors.astype(float), labels)
    assert {i: got[i] for i in range(500, 1000)} == {i: want[i] for i in range(500, 1000)}
    assert got == want


def test_no_pair_is_emitted():
    """A part returns at most a count and a link for each row."""
    rng = np.random.default_rng(4)
    units = forest._units(np.ones(16) + 0.01 * rng.standard_normal((700, 16)))
    homes = np.zeros((700, 1), np.int64)
    counts, roots = forest.links_of_part(units, np.ones(700, np.int64), homes, 0, 0.93, 1)
    assert (counts == 699).all() and (roots == 0).all()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1),
        (2, [2.0, 0.0], 1),
        (3, [1.0, 0.0], 2),  # another label
        (4, [1.0, 0.0], None),
        (5, [1.0, 0.0], None),
        (6, None, 1),
        (7, [], 1),
        (8, [0.0, 0.0], 1),
        (9, [nan, 1.0], 1),
        (10, [inf, 1.0], 1),
        (11, [None, 1.0], 1),
        (12, [1.0, 0.0, 0.0], 1),  # another length
        (None, [-1.0, 0.0], 1),
        (13, [-0.0, 1.0], 1),
        (13, [0.0, 1.0], 1),  # a repeated row
    ]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS node", "1 AS weight", "2 AS _key")
    got = sorted(map(tuple, forest.near_vectors(frame).collect()), key=str)
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11, 12, None)]
    linked = [(1, 1, 1, True), (2, 1, 1, False), (13, 1, 13, True), (13, 1, 13, True)]
    assert got == sorted(alone + linked, key=str)


def test_double_precision_and_empty_table(spark):
    schema = SCHEMA.replace("float", "double")
    rows = [(1, [1e300, 1e300], 1), (2, [1e-300, 1e-300], 1)]
    got = forest.near_vectors(spark.createDataFrame(rows, schema)).collect()
    assert [(r.n_links, r.component_id) for r in got] == [(1, 1), (1, 1)]
    assert forest.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_lists_of_any_width_are_compared_in_little_memory():
    """The lists of two rows may be long, and a leaf may hold very many pairs."""
    rng = np.random.default_rng(2)
    table = np.sort(rng.integers(0, 10_000, (300, 60)), 1)
    a, b = rng.integers(0, 300, (2, 20_000))
    tracemalloc.start()
    got = forest._first_common(forest._listed(table), a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    for i in range(0, 20_000, 100):
        both = set(table[a[i]].tolist()) & set(table[b[i]].tolist())
        assert got[i] == min(both, default=forest._NONE)


def test_units_are_made_when_asked_for():
    """A part holds its vectors once, as they are stored, and has the same links as of all units."""
    rng = np.random.default_rng(6)
    vectors = clustered(rng, 3000)
    weights, homes = rng.integers(1, 4, 3000), np.zeros((3000, 1), np.int64)
    want = forest.links_of_part(forest._units(vectors.astype(float)), weights, homes, 0, 0.93, 5)
    got = forest.links_of_part(forest.Vectors(vectors), weights, homes, 0, 0.93, 5)
    assert all((x == y).all() for x, y in zip(got, want, strict=True)) and got[0].any()
