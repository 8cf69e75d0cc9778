import hashlib
import random
import re

import pytest

from strataloom.llm.queries import op12_substring_dedup
from strataloom.llm.substring_dedup import substring_dedup


def brute(rows, length):
    """rows in the order of documents."""
    seen, out = set(), []
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for s in range(len(words) - length + 1):
            key = tuple(words[s : s + length])
            if key in seen:
                gone[s : s + length] = [True] * length
            seen.add(key)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc_id, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(seed):
    r = random.Random(seed)
    texts = []
    for _ in range(150):
        words = r.choice([["a"], ["a", "b"], ["a", "b", "c", "d"], [f"w{k}" for k in range(60)], ["é", "日本", "x y", "\x1c"]])
        texts.append(r.choice([" ", "  ", "\n", "\t \x0b"]).join(r.choice(words) for _ in range(r.randint(0, r.choice([10, 60, 400])))))
    for _ in range(100):
        some, other = r.choice(texts).split(" "), r.choice(texts)
        a, b = sorted((r.randint(0, len(some)), r.randint(0, len(some))))
        texts.append(" ".join(some[a:b]) + " " + other)
    row = " ".join(f"{k} of nine hundred and" for k in range(300))  # one seed again and again, all windows different
    texts += ["q " * 3000, "p q " * 1500, row, row[200:], " ".join(reversed(row.split(" ")))]
    r.shuffle(texts)
    return [(7 * i - 300, x) for i, x in enumerate(texts)]


@pytest.mark.parametrize("length, gram", [(20, 6), (8, 3), (5, 5)])
def test_brute_force(spark, length, gram):
    plain = " ".join(map(str, range(100)))
    rows = rows_of(length) + [(9000, None), (9001, ""), (9002, "one two"), (9003, plain), (None, "x " + plain)]
    df = spark.createDataFrame([(*x, 1, "s") for x in rows], "doc_id long, text string, lo int, words string").repartition(5)
    got = substring_dedup(df, length, gram)
    assert sorted(map(tuple, got.drop("kept_text", "removed").collect()), key=str) == brute(rows, length)


def test_text_and_spans(spark):
    base = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(base)), (2, "new " + " ".join(base[10:40]) + " end"), (3, " ".join(base[:25] + base))]
    got = {r.doc_id: r for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].removed == [] and got[2].kept_text == "new end" and [tuple(x) for x in got[2].removed] == [(1, 30)]
    assert got[3].kept_text == "" and got[3].n_removed == 85


def test_one_of_equal_rows_keeps_its_words(spark):
    text = " ".join(map(str, range(30)))
    rows = [(5, text)] * 3 + [(5, "short"), (5, "short"), (None, text), (None, text), (5, " ".join(map(str, range(40, 80))))]
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(-1, 30, 30)] * 2 + [(5, 1, 0)] * 2 + [(5, 30, 0), (5, 30, 30), (5, 30, 30), (5, 40, 0)])


def test_empty_table(spark):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    assert sorted(map(tuple, op12_substring_dedup(spark, folder).collect()), key=str) == brute(rows, 20)
