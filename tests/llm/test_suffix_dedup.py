import hashlib
import random
from collections import defaultdict

import pytest

from strataloom.llm.suffix_dedup import suffix_dedup


def brute(rows, length):
    places = defaultdict(int)
    texts = [(k, (t or "").encode()) for k, t in rows]
    for _, b in texts:
        for i in range(len(b) - length + 1):
            places[b[i : i + length]] += 1
    out = []
    for k, b in texts:
        hit = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if places[b[i : i + length]] > 1:
                hit[i : i + length] = b"\1" * length
        kept = bytes(x for x, h in zip(b, hit) if not h)
        spans = sum(1 for i in range(len(hit)) if hit[i] and (i == 0 or not hit[i - 1]))
        out.append((k, len(b), sum(hit), spans, hashlib.sha256(kept).hexdigest()))
    return out


def made(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    para = lambda n: " ".join(word() for _ in range(n))
    shared = [para(rng.randint(8, 60)) for _ in range(6)]
    rows = [(None, None), (1, ""), (2, None), (3, "short"), (4, "a" * 300), (5, "a" * 150 + "b" + "a" * 200), (6, "ab" * 200)]
    for i in range(10, 60):
        parts = [para(rng.randint(1, 40))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared)[rng.randint(0, 9) :], para(rng.randint(0, 20))]
        rows.append((i, " ".join(parts)))
    rows += [rows[20], rows[20], (99, rows[21][1]), (100, rows[22][1] + "x"), (20, "other text under a doc_id that is taken " * 3)]
    return rows


@pytest.mark.parametrize("seed,hot", [(1, 4096), (2, 4096), (3, 2), (4, 1)])
def test_same_as_brute_force(spark, seed, hot):
    rows = made(seed)
    docs = spark.createDataFrame([(k, t, 7) for k, t in rows], "doc_id long, text string, n_bytes int")
    got = suffix_dedup(docs, length=60, gram=16, hot=hot, with_text=False).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, 60), key=key)


def test_empty_table(spark):
    assert suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_carried_columns_with_clashing_names(spark):
    text = "".join(chr(97 + i * i % 23) for i in range(300))
    docs = spark.createDataFrame([(1, text, 10, 20, "a", "b", 1.5), (2, "x" + text, 11, 21, "c", None, None)], "doc_id long, text string, v int, key int, spans string, more string, `a.b` double")
    got = suffix_dedup(docs, length=60, gram=16, carry=["v", "key", "spans", "more", "a.b"]).orderBy("doc_id").collect()
    assert [tuple(r)[6:] for r in got] == [(10, 20, "a", "b", 1.5), (11, 21, "c", None, None)]
    assert [r.kept_text for r in got] == ["", "x"]
