"""What an operator leaves in a worker goes when the next operator's tasks begin."""

import numpy as np
import pyarrow as pa

from rememora.llm import common, op02_toxicity as toxicity


class InProcess:
    """Stands for a DataFrame of one batch whose Arrow function runs here, as it does in a worker."""

    def __init__(self, batch):
        self.batch = batch

    def select(self, *_columns):
        return self

    groupBy = agg = select

    def mapInArrow(self, run, _schema):
        self.out = pa.Table.from_batches(list(run(iter([self.batch]))))
        return self

    def toPandas(self):
        return self.out.to_pandas()


def test_counting_lets_go_of_another_operators_cache(spark, monkeypatch):
    batch = pa.RecordBatch.from_pydict({"text": ["Ab cd", None, "", "été 42", "zz"] * 3})
    gone = []
    monkeypatch.setitem(common._kept, "packing", lambda: gone.append(1))
    whole = toxicity.character_counts(InProcess(batch), "text")
    assert gone == [1] and "packing" not in common._kept
    monkeypatch.setattr(toxicity, "_COUNTED_BYTES", 4)
    assert np.array_equal(whole, toxicity.character_counts(InProcess(batch), "text"))


def test_free_memory_is_handed_back_before_and_after_a_task(monkeypatch):
    back = []
    monkeypatch.setattr(common, "hand_back", lambda: back.append(1))
    with common.no_cycles():
        assert back == [1]
    assert back == [1, 1]
