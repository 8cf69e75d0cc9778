"""Queries over whole texts, against plain Python."""

import math
import re

import duckdb
import pytest

from strataloom.plans import QUERIES, SQL

TEXTS = {1: "alpha " + "x " * 300 + "beta", 2: "beta gamma " + "y " * 200 + "alpha", 3: "Gamma Delta line\nGamma Delta line\nGamma Data", 14: "alpha alone"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    html = 'href="/beta" href="/nowhere" href="/alone" href="/nowhere"'
    spark.createDataFrame([(7, html)], "page_id long, html string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([(i,) for i in range(1, 121)], "p_partkey long").write.parquet(f"{path}/part.parquet")
    return path


def rows(spark, name, folder):
    return sorted(tuple(r) for r in QUERIES[name](spark, folder).collect())


def test_references(spark, folder):
    tokens = [(w, d, i + 1) for d, text in TEXTS.items() for i, w in enumerate(text.split(" "))]
    symbols = {w for w, _, i in tokens if i == 1}
    uses = sorted(x for x in tokens if x[0] in symbols and x[2] > 1)
    ranks = [sum(u[0] == x[0] and u <= x for u in uses) for x in uses]
    assert rows(spark, "join_refs_tokens", folder) == [(*x, n) for x, n in zip(uses, ranks) if n <= 80]
    assert ("beta", 1, 302, 1) in rows(spark, "join_refs_tokens", folder)


def test_doc_links(spark, folder):
    assert rows(spark, "join_doc_links", folder) == [(7, "nowhere", 2)]


def test_slugs(spark, folder):
    want = []
    for d, text in TEXTS.items():
        seen: dict[str, int] = {}
        for i, x in enumerate(text.split("\n")):
            slug = re.sub(r"\s", "-", re.sub(r"[^\w\s-]", "", x.strip().lower()))
            n = seen[slug] = seen.get(slug, -1) + 1
            want.append((d, i + 1, f"{slug}-{n}" if n else slug))
    assert rows(spark, "win_slug_dedup", folder) == sorted(want)


def test_lockfile(spark, folder):
    want = [(k, "a", f"1.{k % 3}", k % 2 == 0) for k in range(1, 121)] + [(k, "b", "2.0", False) for k in range(1, 121)]
    assert rows(spark, "src_lockfile", folder) == sorted(want)


def test_saved_bytes_of_odd_texts(spark, tmp_path):
    """A missing and an empty text saved all bytes, and a vertical tab was white space, which it is not in SQL."""
    texts = [None, "", " ", "\x0b\x0b", "a\x0b\x0b  b", "a\u00a0\u00a0b", "a \t\r\n\f b"]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    got = {r.doc_id: r.value for r in QUERIES["fn_byte_saving"](spark, str(tmp_path)).collect()}
    base = duckdb.connect()
    base.sql(f"CREATE VIEW documents AS FROM '{path}/*.parquet'")
    want = dict(base.sql(SQL["fn_byte_saving"]).fetchall())
    assert math.isnan(got.pop(1)) and math.isnan(want.pop(1))
    assert got == want and got[0] is None and got[3] == 0
