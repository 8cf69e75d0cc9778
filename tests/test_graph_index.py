"""An index brought up to date after random edits is the index built anew."""

import random

from pyspark.sql import functions as F

from strataloom.operators import graph_index as GI

SCHEMA = "path string, text string, size_bytes long, mtime_ms long"


def text_of(r):
    n = r.randint(0, 6)
    return "\n".join(
        r.choice([f"export function run{r.randint(0, 9)}(a) {{", f"import x from './f{r.randint(0, 20)}'", f"const y = run{r.randint(0, 9)}(Box{r.randint(0, 3)})", f"class Box{r.randint(0, 3)} {{", "from pkg.mod import z", f"await import('../src/f{r.randint(0, 20)}.ts')", "key: 1"])
        for _ in range(n)
    )


def state(spark, folder):
    out = {}
    for name in (*GI.TABLES, "resolved", "references"):
        rows = GI.read(spark, folder, name)
        out[name] = sorted(map(str, rows.select(sorted(rows.columns)).collect()))
    return out


def test_updates_equal_a_rebuild(spark, tmp_path):
    r = random.Random(4)
    tree = {f"{d}/f{i}.{e}": (text_of(r), 1) for d in ("src", "docs", "pkg") for i in range(12) for e in [r.choice(["ts", "py", "md", "yaml"])]}
    tree["pkg/mod.py"] = ("def z():", 1)
    frame = lambda: spark.createDataFrame([(p, t, len(t), m) for p, (t, m) in tree.items()], SCHEMA)
    folder = str(tmp_path / "index")
    GI.build(frame(), folder, buckets=5)
    for turn in (2, 3):
        for p in r.sample(sorted(tree), 6):
            tree[p] = (text_of(r), turn)
        for p in r.sample(sorted(tree), 4):
            del tree[p]
        tree |= {f"new/g{turn}{i}.ts": (text_of(r), turn) for i in range(3)}
        before = GI.changes(spark, folder, frame()).groupBy("state").count().collect()
        assert GI.status(spark, folder, frame()).first().status == "stale"
        got = GI.update(frame(), folder, buckets=5)
        assert got["new"] == 3 and got["gone"] and {k: v for k, v in got.items() if v} == {x["state"]: x["count"] for x in before}
        again = str(tmp_path / f"again{turn}")
        GI.build(frame(), again, buckets=5)
        assert state(spark, folder) == state(spark, again)
    one = GI.status(spark, folder, frame()).first()
    assert (one.status, one.stale_files, one.files_indexed) == ("fresh", 0, len(tree)) and one.references_indexed > 0


def test_only_changed_texts_are_parsed(spark, tmp_path):
    rows = [(f"src/f{i}.ts", f"export function run{i}() {{", 5, 1) for i in range(30)]
    folder = str(tmp_path / "index")
    GI.build(spark.createDataFrame(rows, SCHEMA), folder, buckets=4)
    rows[3] = ("src/f3.ts", "export function other() {", 6, 1)
    rows = rows[:-1]
    listing = spark.createDataFrame(rows, SCHEMA).withColumn("text", F.when(F.col("path") == "src/f3.ts", F.col("text")).otherwise(F.raise_error(F.lit("read"))))
    assert GI.update(listing, folder, buckets=4) == {"new": 0, "changed": 1, "gone": 1}
    assert {r.name for r in GI.read(spark, folder, "symbols").collect()} == {f"run{i}" for i in range(29) if i != 3} | {"other"}


def test_paths(spark):
    rows = spark.createDataFrame([("a/b", "../c", "a/c"), ("", "./x", "x"), ("a", "../../y", "../y"), ("a/b", ".", "a/b"), ("a", "./b//c", "a/b/c")], "f string, t string, want string")
    assert all(r.got == r.want for r in rows.withColumn("got", GI.joined_path(F.col("f"), F.col("t"))).collect())
