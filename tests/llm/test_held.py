import weakref

import pyarrow as pa
import pytest

from wordmend.llm import held as module
from wordmend.llm import language, packing


class Model:
    pass


@pytest.fixture(autouse=True)
def empty_worker(monkeypatch):
    monkeypatch.setattr(module, "_held", {})


def test_a_worker_keeps_the_model_of_one_step():
    first = module.held("a", Model)
    assert module.held("a", Model) is first
    gone = weakref.ref(first)
    del first
    module.held("b", Model)
    assert gone() is None
    assert [*module._held] == ["b"]


def test_language_tables_and_remembered_items_are_not_kept_together(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de")])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)

    def kept(batches):
        from wordmend.llm import held

        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([name.split("-")[0] for name in held._held])], names=["name"])

    def names():
        return {r.name for r in spark.range(0, 40, 1, 8).mapInArrow(kept, "name string").collect()}

    model = language.fit(frame)
    for _ in range(2):
        assert language.predict(frame, model).count() == 2
        packing.pack(frame).collect()
    assert language.predict(frame, model).select("lang_pred").collect()
    workers = spark.range(0, 40, 1, 8).mapInArrow(
        lambda b: (pa.RecordBatch.from_arrays([pa.array([n])], names=["n"]) for n in [len(module._held)] if [*b]), "n long"
    )
    assert max(r.n for r in workers.collect()) <= 1
    assert names() <= {"language", "packing"}
