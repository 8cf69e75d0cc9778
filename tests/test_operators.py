"""Golden cases of the operators, by hand."""

import json

from pyspark.sql import functions as F

from strataloom.functions import predicates as P
from strataloom.functions import text as T
from strataloom.operators import compact as C
from strataloom.operators import diffs as D
from strataloom.operators import evaluation as E
from strataloom.operators import graph as G
from strataloom.operators import raster as X
from strataloom.operators import receipts as A
from strataloom.operators import retrieve as R
from strataloom.operators import route as O
from strataloom.operators import stats as S


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(column).first()[0]


def test_token_estimates(spark):
    x = F.col("x")
    assert one(spark, T.estimate_tokens(x), x="") == 0
    assert one(spark, T.estimate_tokens(x), x="abcde") == 2
    assert one(spark, T.estimate_tokens(x), x="привет мир") == 4
    assert one(spark, T.estimate_tokens_mixed(x), x="") == 1


def test_clamp_and_unique(spark):
    x = F.col("x")
    got = one(spark, T.clamp_head_tail(x, 100), x="a" * 72 + "b" * 200 + "c" * 18)
    assert got == "a" * 72 + "\n\n[... omitted 200 chars ...]\n\n" + "c" * 18
    assert one(spark, F.array_join(T.unique_ci(F.split(x, ","), 2), "|"), x=" A,a,,b ,B,c") == "A|b"


def test_log_with_a_needle(spark):
    info = "\n".join(f"info line {i}" for i in range(500))
    text = f"{info}\n$ npm run build\nsrc/server.ts:42:11 - error TS2304: Cannot find name 'x'\n    at run (src/server.ts:42:11)\n{info}"
    row = C.log_summary(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()[0]
    assert "TS2304" in row.root_cause and row.files == ["src/server.ts"] and row.savings_pct >= 60 and row.commands == ["$ npm run build"]


def test_compression_keeps_query_terms(spark):
    text = "\n\n".join([f"Generic product prose number {i} that says nothing at all about it." for i in range(40)] + ["The flux capacitor must be fixed before launch."])
    row = C.compress(spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string"), ("flux",), 0.1).orderBy("doc_id").collect()
    assert "flux capacitor" in row[0].compact and row[0].savings_pct >= 50
    assert row[1].units_kept == 0


def test_verdicts(spark):
    rows = [("p", 0.1), ("p", 0.1), ("p", 0.1), ("n", 0.9), ("n", 0.9), ("s", 0.1), ("s", 0.3), ("s", 0.05)]
    got = C.aggregate_compression(spark.createDataFrame(rows, "k string, ratio double"), ["k"]).collect()
    assert {r.k: r.verdict for r in got} == {"p": "PASS", "n": "FAIL_NO_SAVING", "s": "FAIL_STOCHASTIC"}


def test_paths_and_addresses(spark):
    x = F.col("x")
    assert one(spark, P.filter_reason(x), x="a/.env") == "sensitive-path"
    assert one(spark, P.filter_reason(x), x="a/b.PNG") == "binary-extension"
    assert one(spark, P.filter_reason(x), x="a/b.ts") is None
    for url, want in {"http://10.0.0.1/": "private", "http://172.20.1.1/": "private", "http://172.40.1.1/": None, "ftp://x.org": "protocol", "http://[::1]/": "private", "https://user@example.org:8080/x": None, "http://localhost/": "private"}.items():
        assert one(spark, P.url_guard(x), x=url) == want, url


def test_unicode_word_edges(spark):
    x = F.col("x")
    assert one(spark, P.matches(x, r"\bfix\b"), x="to FIX it") is True
    assert one(spark, P.matches(x, r"\bt\b"), x="été") is True  # edges are ASCII, so é is no letter


def test_lockfile_last_wins(spark):
    schema = "name string, version string, place int"
    old = spark.createDataFrame([("a", "1.0.0", 1), ("a", "1.5.0", 2), ("b", "1.0.0", 3), ("same", "1.0.0", 4)], schema)
    new = spark.createDataFrame([("a", "2.0.0", 1), ("c", "1.0.0", 2), ("same", "1.0.0", 3)], schema)
    got = {r.name: (r.change, r.major_bump) for r in D.lockfile_diff(old, new).collect()}
    assert got == {"a": ("changed", True), "b": ("removed", False), "c": ("added", False)}


def test_mirror_issues(spark):
    docs = spark.createDataFrame([("a", "A", "1"), ("b", "B", "2"), ("c", "C", "3")], "path string, title string, hash string")
    mirrors = spark.createDataFrame([("a", "A", "0"), ("b", "X", ""), ("gone", None, None)], "path string, title string, hash string")
    got = {r.path: r.issues for r in D.mirror_diff(docs, mirrors).collect()}
    assert got == {"a": ["stale"], "b": ["title_mismatch"], "c": ["missing_mirror"], "gone": ["missing_source"]}


def test_recall_and_rank(spark):
    expected = spark.createDataFrame([("q", "x"), ("q", "y"), ("none", "z")], "case_id string, path string")
    returned = spark.createDataFrame([("q", "a", 1), ("q", "y", 2), ("q", "x", 7)], "case_id string, path string, rank int")
    got = {r.case_id: r for r in E.evaluate(expected, returned, expected.select("case_id").distinct()).collect()}
    assert (got["q"].recall5, got["q"].recall10, got["q"].first_rank, got["q"].reciprocal) == (0.5, 1.0, 2, 0.5)
    assert (got["none"].passed, got["none"].reciprocal) == (False, 0.0)


def test_cycles_once(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (2, 1), (4, 4)], "src int, dst int")
    assert sorted(r[0] for r in G.cycles(edges, 4).collect()) == [[1, 2], [1, 2, 3], [4]]


def test_orphans(spark):
    files = spark.createDataFrame([("README.md",), ("a.md",), ("b.md",)], "path string")
    links = spark.createDataFrame([("README.md", "a.md"), ("b.md", "b.md")], "src string, target string")
    assert [r.path for r in G.orphans(files, links).collect()] == ["b.md"]


def test_wilson_and_holm(spark):
    frame = spark.createDataFrame([(15, 15), (0, 0), (0, 15)], "k int, n int")
    low, high = S.wilson(F.col("k"), F.col("n"))
    got = [(round(r[0], 3), round(r[1], 3)) for r in frame.select(low, high).collect()]
    assert got == [(0.796, 1.0), (0.0, 1.0), (0.0, 0.204)]
    rows = S.holm(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "l string, p double"), "l", "p").collect()
    assert [(r.l, round(r.adjusted_p, 4)) for r in sorted(rows, key=lambda r: r.p)] == [("a", 0.03), ("c", 0.06), ("b", 0.06)]


def test_bootstrap_is_reproducible(spark):
    rows = spark.createDataFrame([("g", f, v) for f, v in (("a", 0.95), ("b", 0.6), ("c", 0.75)) for _ in range(3)], "g string, f string, b double")
    a, b = (S.bootstrap(rows, "g", "f", "b", 300).collect() for _ in range(2))
    assert a == b and round(a[0].point, 4) == 0.7667 and a[0].low < a[0].point < a[0].high


def test_normal_cdf(spark):
    got = spark.createDataFrame([(0.0,), (1.959964,), (-1.0,)], "x double").select(S.normal_cdf(F.col("x"))).collect()
    assert [round(r[0], 4) for r in got] == [0.5, 0.975, 0.1587]


def test_raster_square(spark):
    x, y = F.col("id") % 64, F.floor(F.col("id") / 64)
    base = spark.range(64 * 64).select(F.lit("i").alias("image"), x.cast("int").alias("x"), y.cast("int").alias("y"), F.lit(34).alias("r"), F.lit(48).alias("g"), F.lit(72).alias("b"))
    new = base.withColumn("r", F.when(F.col("x").between(10, 21) & F.col("y").between(10, 21), 250).otherwise(F.col("r")))
    diff = X.pixel_diff(base, new).first()
    assert (diff.changed, diff.changed_pct, diff.passed) == (144, 3.516, False)
    assert [tuple(r)[1:6] for r in X.components(X.changed_mask(base, new)).collect()] == [(10, 10, 21, 21, 144)]


def test_canonical_receipt(spark):
    receipt = {"schema_version": "1", "action": {"type": "click", "selector": 'é"\n', "value": None}, "pre_state": {"url": "u", "dom_region_hash": "h"}, "post_state": {"url": "u", "dom_region_hash": "h", "changed": True, "stable": True, "navigated": False}, "errors": {"console": ["x"], "network": [], "selector_not_found": False, "timeout": False, "action_failed": None}}
    schema = "receipt struct<schema_version:string,action:struct<type:string,selector:string,value:string>,pre_state:struct<url:string,dom_region_hash:string>,post_state:struct<url:string,dom_region_hash:string,changed:boolean,stable:boolean,navigated:boolean>,errors:struct<console:array<string>,network:array<string>,selector_not_found:boolean,timeout:boolean,action_failed:string>>"
    frame = spark.createDataFrame([(receipt,)], schema)
    assert frame.select(A.canonical_json()).first()[0] == json.dumps(receipt, sort_keys=True, ensure_ascii=False)
    assert frame.select(A.problems()).first()[0] == []


def test_query_terms():
    assert R.query_terms("fixing userProfiles") == ["fixing", "fix", "userProfiles", "userprofile", "user", "Profiles", "profile", "userprofiles", "userprofile"]
    assert R.variants("running") == ["running", "runn", "run"] and R.variants("queries") == ["queries", "query", "querie"]
    assert R.compounds("push", "token") == ["push-token", "push_token", "pushToken", "PushToken"]


def test_routes(spark):
    texts = {"a": "fix it", "b": "run tests please", "c": "hello", "d": "read https://x.org/page", "e": "see https://x.org/a.png", "f": "where is it implemented in the codebase"}
    rows = O.route(spark.createDataFrame(list(texts.items()), "k string, text string"), "k").collect()
    got = {r.k: (r.decision, r.tools) for r in rows}
    assert got == {"a": ("ask", ""), "b": ("call", "checks"), "c": ("skip", ""), "d": ("call", "url"), "e": ("call", "screenshot"), "f": ("call", "retrieval")}


def brute_cycles(edges, longest):
    targets, out = {}, set()
    for a, b in edges:
        targets.setdefault(a, set()).add(b)

    def walk(path):
        for x in targets.get(path[-1], ()):
            if x == path[0]:
                out.add(tuple(path))
            elif x > path[0] and x not in path and len(path) < longest:
                walk([*path, x])

    for node in targets:
        walk([node])
    return sorted(out)


def test_cycles_and_components_of_random_graphs(spark):
    import random

    for seed, nodes, n in ((1, 12, 30), (2, 60, 90), (3, 25, 40)):
        r = random.Random(seed)
        edges = {(r.randrange(nodes), r.randrange(nodes)) for _ in range(n)}
        frame = spark.createDataFrame(sorted(edges), "src int, dst int")
        for longest in (3, 6, None):
            got = sorted(tuple(x[0]) for x in G.cycles(frame, longest).collect())
            assert got == brute_cycles(edges, longest or nodes)
        reach = {a: {a} for a, _ in edges} | {b: {b} for _, b in edges}
        for _ in range(nodes):
            for a, b in edges:
                reach[a] |= reach[b]
        want = {(a, max(x for x in reach[a] if a in reach[x])) for a in reach if any((a, b) in edges and a in reach[b] for b in reach)}
        assert {tuple(x) for x in G.strong_components(frame).collect()} == want
        if seed == 3:  # the way beyond what one task takes
            assert {tuple(x) for x in G.strong_components(frame, most_edges=3).collect()} == want
            assert sorted(tuple(x[0]) for x in G.cycles(frame, 4, most_edges=3).collect()) == brute_cycles(edges, 4)


def test_no_dead_path_is_walked_twice():
    """A ladder of 2^20 dead paths in front of a node without a way back."""
    targets = {0: [1, 2]} | {i: [i + 2 - i % 2 + 1, i + 2 - i % 2 + 2] for i in range(1, 41)} | {0: [1, 2, 100], 100: [0]}
    assert list(G.cycles_from(0, targets, 200)) == [[0, 100]]
