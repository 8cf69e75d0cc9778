"""run() against brute force over rows with null and repeated doc_ids."""

import os
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as P
from strataloom.llm import decontam, minhash
from strataloom.llm.queries import tokenizer_path
from strataloom.llm.shared import table

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


def stripped(rows, length=200):
    """The rows without bytes of strings that occur at two places or more."""
    texts = [(r[1] or "").encode() for r in rows]
    places = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for r, b in zip(rows, texts):
        hit = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if places[b[i : i + length]] > 1:
                hit[i : i + length] = b"\1" * length
        text = bytes(x for x, h in zip(b, hit) if not h).decode("utf-8", "ignore")
        out.append((r[0], text, *r[2:4], len(text)))
    return out


def brute(rows, bench):
    """Near-dedup, suffix dedup and decontamination of rows in the order of COLUMNS."""
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, str(r)))
    rows = [r for r, (*_, kept) in zip(rows, minhash.brute_force([(i, r[1]) for i, r in enumerate(rows)])) if kept]
    rows = stripped(rows)
    return [r for r, found in zip(rows, decontam.brute_force([(i, r[1]) for i, r in enumerate(rows)], bench)) if not found[-1]]


def test_null_and_repeated_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [tuple(r) for r in table(spark, FOLDER, "documents").select(*P.COLUMNS).collect()]
    bench = [tuple(r) for r in table(spark, FOLDER, "benchmark").select("item_id", "text").collect()]
    leak = next(t for _, t in bench if len(t.split()) > 20)
    rows = [(None if i % 9 == 4 else r[0], *r[1:]) for i, r in enumerate(rows)]
    rows += rows[10:40]  # the same rows again
    rows += [(rows[i][0], rows[i + 50][1] and "other " + rows[i + 50][1][::-1], *rows[i][2:]) for i in range(40, 60)]  # another text under a doc_id that is taken
    rows += [(None, leak, "en", "web", len(leak)), (rows[41][0], leak + " end", "en", "web", len(leak) + 4), (None, None, "en", "web", 0), (None, None, "en", "web", 0)]
    for name in ("labels", "benchmark"):
        table(spark, FOLDER, name).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = table(spark, str(tmp_path), "documents")

    def through(docs):
        for _, stage in P.STAGES[1:-1]:
            docs = stage(spark, docs, str(tmp_path))
        return docs

    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted(map(tuple, through(docs).collect()), key=key) == sorted(brute(rows, bench), key=key)

    accepted = [tuple(r) for r in P.quality_classifier(spark, docs, str(tmp_path)).collect()]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = Counter((i, tuple(tokenizer.encode(t, add_special_tokens=False).ids + [1])) for i, t, *_ in brute(accepted, bench))
    assert any(i is None for i, _ in want)
    got = P.run(spark, str(tmp_path)).collect()
    assert sum(r.length for r in got) == sum(len(ids) * n for (_, ids), n in want.items())
    pieces = Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in got)
    spans = {(r.doc_id, r.start, r.length, r.doc_tokens) for r in got}
    for (i, ids), n in want.items():
        for j, s, size, total in spans:
            if j == i and total == len(ids):
                pieces[j, s, size, zlib.crc32(np.array(ids[s : s + size], "<u4").tobytes())] -= n
    assert all(n <= 0 for n in pieces.values()) and sum(r.doc_tokens == r.length + r.start for r in got) == sum(want.values())
