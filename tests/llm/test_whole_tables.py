"""The registered queries over the smallest folder, against brute force."""

import os
import zlib

import duckdb
import pytest

from strataloom.llm import decontam, minhash, quality_rules
from strataloom.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path

from .test_suffix_dedup import brute as brute_suffix

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]


def rows(spark, name, n=None):
    return sorted(tuple(r)[:n] for r in QUERIES[name](spark, FOLDER).collect())


def test_suffix_dedup(spark, docs):
    assert rows(spark, "op4_suffix_dedup") == sorted(brute_suffix(docs, 200))


def test_decontamination(spark, docs):
    bench = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    assert rows(spark, "op8_decontamination", 6) == sorted(decontam.brute_force(docs, bench))


def test_quality_rules(spark, docs):
    assert rows(spark, "op9_quality_rules", 7) == sorted(quality_rules.brute_force(docs))


def test_minhash(spark, docs):
    assert rows(spark, "op10_minhash") == sorted(minhash.brute_force(docs, 4))


def test_packing(spark, docs):
    import numpy as np
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = {k: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for k, t in docs}
    got = QUERIES["op7_packing"](spark, FOLDER).collect()
    assert sum(r.length for r in got) == sum(map(len, want.values()))
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{FOLDER}/pages.parquet'")
    frame = QUERIES[name](spark, FOLDER)
    got = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(map(str, got.fetchall())) == sorted(str(tuple(r[c] for c in names)) for r in frame.collect())


def test_pipeline(spark):
    import corpus_pipeline as P
    from strataloom.llm.shared import table

    docs = table(spark, FOLDER, "documents")
    kept = [docs.count()]
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs.withColumn("extra", docs.doc_id), FOLDER)
        assert docs.columns == P.COLUMNS
        kept.append(docs.count())
    packed = P.STAGES[-1][1](spark, docs, FOLDER)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert kept == sorted(kept, reverse=True) and kept[-1] > 0.5 * kept[0]
