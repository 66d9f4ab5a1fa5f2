import pyarrow as pa
import pytest

from wordmend.llm import held, neardup, repeats

TEXTS = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([5]), pa.array(["some words here"])], names=["key", "version", "text"])


@pytest.mark.parametrize(
    "step",
    [
        neardup._cells(neardup._CELLS),
        neardup._signatures(neardup.Weights(1, {})),
        repeats._spans_of(repeats.MIN_WORDS),
        repeats._mark,
        repeats._cut(None, "text"),
    ],
    ids=["cells", "signatures", "spans", "mark", "cut"],
)
def test_steps_without_a_model_let_the_last_one_go(monkeypatch, step):
    monkeypatch.setattr(held, "_held", {"language": object()})
    batches = [TEXTS] if step not in (repeats._mark,) and step.__name__ != "cut" else []
    list(step(iter(batches)))
    assert not held._held
