import numpy as np
import pyarrow as pa

from strataloom.llm import shared as S


def test_words_stay_in_their_document():
    data, offs = S.text_bytes(pa.array(["ab cd", "ef", None, " ", "g"]))
    starts, ends, first = S.words(data, offs, S.NOT_SPACE)
    assert [bytes(data[s:e]) for s, e in zip(starts, ends)] == [b"ab", b"cd", b"ef", b"g"]
    assert np.diff(first).tolist() == [2, 1, 0, 0, 1]


def test_hash_of_a_span_does_not_depend_on_its_place():
    data, _ = S.text_bytes(pa.array(["xxabcdyyabcd"]))
    prefix = S.prefix_hash(data)
    a, b, c = S.span_hash(prefix, np.array([2, 8, 3]), np.array([6, 12, 7]))
    assert a == b != c


def test_chunks_hold_long_texts_alone():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, "b" * 100, "c", "d"])], names=["text"])
    assert [rows.num_rows for _, _, rows in S.chunks(iter([batch]), 20)] == [1, 1, 2]


def test_tables_can_be_deleted(spark):
    table = S.materialise(spark.range(3))
    assert table.count() == 3
    path = table.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    S.clean(spark)
    import os

    assert not os.path.exists(path)
