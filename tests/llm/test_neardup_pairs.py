from wordmend.llm import neardup
from wordmend.runtime import stage


def test_pairs_are_numbered_once(spark):
    """Steps after the numbering do not read the pairs again, which would join them every time."""
    texts = stage(spark.createDataFrame([("a", "x y z"), ("b", "x y z w")], "node string, text string"), "texts")
    pairs = stage(spark.createDataFrame([("a", "b")], "pivot string, node string"), "raw-pairs")
    found = neardup.verified(pairs, texts, neardup.Weights(100, {}))
    assert not any("raw-pairs" in file for file in found.inputFiles())
    assert [(r.a, r.b) for r in found.collect()] == [("a", "b")]
