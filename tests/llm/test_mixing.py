import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wordmend.llm import mixing


def water(sizes, weights=(5, 2, 1), stop=3):
    """Share by weight, stop at three times the size, share the excess again."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [n for n in sizes if n is None]
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    target, full, rest = {}, set(), sum(sizes.values())
    while True:
        open_ = [n for n in names if n not in full]
        total = sum(weight[n] for n in open_)
        target |= {n: rest * weight[n] / total for n in open_}
        over = [n for n in open_ if target[n] > stop * sizes[n]]
        if not over:
            return target
        for n in over:
            full.add(n)
            target[n] = stop * sizes[n]
            rest -= target[n]


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(i, " ".join(["w"] * (1 + i * i % 97)), f"s{i % 7}" if i % 11 else None) for i in range(700)]
    rows += [(1000 + i, "one two three", "s1") for i in range(350)]  # a third of all, one source and size
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    return mixing.mix(frame).toPandas()


def test_targets(mixed):
    sizes = defaultdict(int)
    for name, size in zip(mixed["source"], mixed["size"], strict=True):
        sizes[name] += size
    expected = water(sizes)
    for name, rows in mixed.groupby("source", dropna=False):
        name = name if isinstance(name, str) else None
        assert rows.target.iloc[0] == pytest.approx(expected[name])
        assert rows.source_size.iloc[0] == sizes[name]
        assert rows.taken.sum() == pytest.approx(expected[name], rel=0.02)
    assert mixed.target.groupby(mixed.source.fillna("-")).first().sum() == pytest.approx(sum(sizes.values()))


def test_rates_solve_the_dual(mixed):
    """Rates are exponential in the size up to the stop, and reach the target."""
    for _, rows in mixed.groupby("source", dropna=False):
        assert (rows["rate"] * rows["size"]).sum() == pytest.approx(rows.target.iloc[0], rel=1e-5)
        free = rows[rows["rate"] < 2.999]
        if len(free):
            tilt = free["rate"].map(math.log) / free["size"]
            assert tilt.max() - tilt.min() < 1e-6


def test_copies(mixed):
    assert (mixed.copies <= 3).all() and (mixed.copies >= 0).all()
    assert (mixed.taken == mixed.copies * mixed["size"]).all()


def test_reruns_agree_and_order_does_not_matter(spark):
    rows = spark.range(300).selectExpr(
        "id AS doc_id", "repeat('w ', int(id % 13)) AS text", "concat('s', id % 3) AS source"
    )
    first = mixing.mix(rows).select("doc_id", "taken").orderBy("doc_id").collect()
    again = mixing.mix(rows.repartition(7, F.rand(5))).select("doc_id", "taken").orderBy("doc_id").collect()
    assert first == again


def test_odd_rows(clashing):
    mixed = mixing.mix(clashing)
    rows = mixed.collect()
    assert len(rows) == clashing.count()
    assert sum(r.taken for r in rows) == pytest.approx(sum(r["size"] for r in rows), rel=0.7)
    assert {r["size"] for r in rows if r.text is None or r.text.strip() == ""} == {0}
    again = mixing.repeated(mixed)
    assert again.count() == sum(r.copies for r in rows)
    assert set(odd := clashing.columns) - set(again.columns) <= set(mixing.OUTPUT) and odd


def test_empty(empty):
    assert mixing.mix(empty).count() == 0


def test_native(odd):
    assert "Python" not in mixing.mix(odd)._jdf.queryExecution().toString()
