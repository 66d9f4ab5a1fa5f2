import math
from collections import Counter

import numpy as np
import pyarrow as pa

from wordmend.llm import neardup


def weights_of(weights, text):
    found, values = weights.of(neardup.words(pa.array([text])).of(0))
    return dict(zip(found.tolist(), values.tolist(), strict=True))


def test_every_step_of_frequency_counts(spark):
    """A shingle weighs less the more documents have it, also when these are few of all."""
    uses = Counter({f"alpha beta gamma delta t{n}": n for n in (1, 2, 5, 12, 30)})
    texts = [shared for shared, n in uses.items() for _ in range(n)]
    texts += [f"only here is one{i}" for i in range(100 - len(texts))]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    weights = neardup.corpus_weights(frame)
    for text, n in uses.items():
        ((_, weight),) = weights_of(weights, text).items()
        assert math.isclose(weight, math.log1p(100 / n))


def test_weights_do_not_depend_on_cells(spark, monkeypatch):
    texts = [f"a b c d e f{i % 7} g h i j{i % 3}" for i in range(60)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    usual = neardup.corpus_weights(frame)
    monkeypatch.setattr(neardup, "_CELLS", 2)
    monkeypatch.setattr(neardup, "_FILTERS", (4, 4))
    few = neardup.corpus_weights(frame)
    assert np.array_equal(usual.keys, few.keys) and np.array_equal(usual.values, few.values)
