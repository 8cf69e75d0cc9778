import math
import random

import pytest
from pyspark.sql import functions as F

from strataloom.llm.hard_negatives import hard_negatives, products, sorted_scores
from strataloom.llm.queries import op11_hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def label():
    return F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)")


def brute(rows, positives=5, negatives=5):
    use = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        use.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    out = []
    for n, (i, v, label) in enumerate(use):
        if i is None or i % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j is None, j or 0, other, m) for m, (j, w, other) in enumerate(use)]
        for p in sorted(s for s in scored if s[3] == label and s[4] != n)[:positives]:
            below = sorted(s for s in scored if s[3] != label and 80 * -p[0] <= 100 * -s[0] <= 100 * -p[0])[:negatives]
            out += [(i, None if p[1] else p[2], r + 1, None if s[1] else s[2], -p[0], -s[0]) for r, s in enumerate(below)]
    return sorted(out, key=str)


def rows_of(seed=5):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, 0.4) for _ in range(4)], r.randint(0, 2)) for i in range(0, 900, 5)]
    rows += [(i, [round(r.gauss(0, 0.4), 1) for _ in range(4)], r.randint(0, 2)) for i in range(1, 900, 3)]  # many ties
    same = [0.5] * 4
    odd = [(None, same, 1), (None, same, 1), (100, same, 1), (100, same, 1), (100, [0.1, 0.5, 0.5, 0.5], 2), (-100, [0.3, 0.2, 0.1, 0.4], 1)]
    odd += [(901, None, 1), (902, [1.0, 2.0, 3.0, 4.0], None), (903, [math.nan, 1.0], 1), (904, [math.inf, 1.0], 1), (905, [None, 1.0], 1)]
    odd += [(906, [], 1), (1000, [], 1), (907, [0.5], 2), (1100, [0.5] * 6, 2)]  # other lengths
    return rows + odd


@pytest.mark.parametrize("block_bytes", [1 << 20, 400])
def test_brute_force(spark, block_bytes):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("score", F.lit("x")).withColumn("anchor", F.lit(1))
    got = hard_negatives(df, F.col("vec_id") % 100 == 0, label(), block_bytes=block_bytes)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_large_numbers(spark):
    rows = rows_of() + [(908, [1e5, 2.0, 3.0, 4.0], 1), (909, [3e5, 1e6, 1.0, 1.0], 0), (1200, [1e3, 2e3, 0.0, 0.0], 0)]
    got = hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0, label())
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_beyond_64_bits(spark):
    rows = [(0, [1e300], 1), (1, [1e300], 1), (2, [1e200], 2), (3, [-1e300], 2)]
    got = hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0, F.col("label")).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2, 2**63 - 1, 2**63 - 1)]


def test_no_rows(spark):
    assert hard_negatives(spark.createDataFrame([], SCHEMA), F.col("vec_id") == 0, F.col("label")).collect() == []
    assert hard_negatives(spark.createDataFrame([(0, [1.0], 1)], SCHEMA), F.col("vec_id") == 0, F.col("label")).collect() == []


def test_products_are_exact():
    import numpy as np

    for most in (5, 10**4, 10**7, 2**40):
        a = np.random.default_rng(most).integers(-most, most, (3, 9))
        want = a.astype(object) @ a.T.astype(object)
        assert (products(a, a) == np.clip(want, -(2**63), 2**63 - 1)).all()
    score, column = sorted_scores(np.array([[2**62, -(2**62), 5, 5]]))
    assert column.tolist() == [[0, 2, 3, 1]] and score.tolist() == [[2**62, 5, 5, -(2**62)]]


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(map(tuple, op11_hard_negatives(spark, folder).collect()), key=str) == brute(rows)
