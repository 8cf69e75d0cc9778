import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from corpus_pipeline import tokenizer_path

from strataloom.llm import packing, quality_bt

MOST_MB = 120


def batches():
    rng = np.random.default_rng(1)
    words = np.array(["".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in rng.integers(2, 11, 3000)])
    texts = [" ".join(words[rng.integers(0, len(words), 400)]) for _ in range(2000)]
    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(range(2000), pa.int64()), "text": pa.array(texts)})


class Plain:
    """A model whose score is the sum of the features."""

    lexical = [quality_bt.Lexical(np.linspace(-1, 1, quality_bt.BUCKETS))]
    scores = staticmethod(lambda x: x.sum(1))


STAGES = {
    "quality": (quality_bt, lambda: quality_bt.scored(Plain), "score"),
    "packing": (packing, lambda: packing.pieces(tokenizer_path(), packing.LONGEST, packing.END, True), "ids_crc32"),
}


@pytest.mark.parametrize("name", STAGES)
def test_a_worker_takes_little_memory_and_chunks_change_no_result(name, monkeypatch):
    module, stage, column = STAGES[name]
    run = lambda: [x for b in stage()(batches()) for x in b.column(b.schema.get_field_index(column)).to_pylist()]
    run()  # what stays in the worker is made
    tracemalloc.start()
    small = run()
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < MOST_MB
    monkeypatch.setattr(module, "CHUNK", 1 << 22)
    assert run() == small
