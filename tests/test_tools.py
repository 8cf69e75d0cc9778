"""Golden cases of tool outputs, contracts, traces, pages, paths, regions, modules; long texts; graphs of any cycle."""

import io
import json
import math
import random
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from strataloom.functions import predicates as P
from strataloom.functions import text as T
from strataloom.operators import cases as K
from strataloom.operators import code
from strataloom.operators import compact as C
from strataloom.operators import contracts as N
from strataloom.operators import diagnostics as D
from strataloom.operators import evidence as E
from strataloom.operators import graph as G
from strataloom.operators import modules as M
from strataloom.operators import paths as A
from strataloom.operators import retrieve as R
from strataloom.operators import route as O
from strataloom.operators import safety as S
from strataloom.operators import stats
from strataloom.operators import vision as V
from strataloom.operators import web as W
from strataloom.operators import windows as X
from strataloom.plans import part_queries
from strataloom.session import spread


def value(spark, column, x=None):
    return spark.createDataFrame([(x,)], "x string").select(column).first()[0]


def test_many_error_lines_end_soon(spark):
    """Cost is linear in the lines, and nothing of the text is cut away."""
    text = "\n".join(f"error {i} in src/a{i}.ts:1:2 cannot find name" for i in range(20_000)) + "\nfatal: the very end"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    row = C.log_summary(docs).first()
    assert len(row.errors) == 18 and row.tail.endswith("the very end") and row.raw_tokens == math.ceil(len(text) / 4)
    assert C.line_flags(docs).first().errors == 20_001
    assert C.text_summary(docs).first().raw_tokens == row.raw_tokens
    assert C.compress(docs, ("cannot",)).first().units_total == 20_001
    assert time.time() - began < 60
    assert C.log_summary(docs, most_input=100).first().raw_tokens == 25


def test_plain_words_and_patterns_agree(spark):
    samples = ["Build FAILED", "failing", "fail", "unfailed ok", "TIMED OUT", "nothing", "", "ошибка и РИСК", "It will do not", "follow-up", "-> npm ERR! x", "$ ls", "File \"a\", line 3"]
    frame = spark.createDataFrame([(x,) for x in samples], "x string")
    for pattern in (P.ERROR, P.COMMAND, P.STACK, P.DECISION, P.ACTION, P.RISK, P.QUESTION, P.CRITICAL, P.NOISE):
        slow = F.col("x").rlike("(?iu)" + pattern.replace(r"\b", P.ASCII_EDGE))
        assert frame.filter(P.matches(F.col("x"), pattern) != slow).count() == 0, pattern
    assert P.alternatives("(a b|c|d[|]e|f\\|g|(h|i))")[0] == ["(a b", "c"] or P.alternatives("(a b|c|d+)") == (["a b", "c"], "d+")


def test_unique_ignores_case_and_keeps_order(spark):
    assert value(spark, F.array_join(T.unique_ci(F.split("x", ","), 3), "|"), "b,A,a , B,,c,d") == "b|A|c"


def test_diagnostics_of_odd_outputs(spark):
    runs = spark.createDataFrame([(1, "not json"), (2, "[]"), (3, None), (4, '{"results":{}}')], "k long, output string")
    for tool in ("tsc", "eslint", "semgrep", "gitleaks", "tests"):
        assert D.findings(runs, "k", tool).count() == 0, tool
    assert value(spark, D.status_from_exit(F.lit(0), F.lit(None).cast("int"))) == "passed"
    assert value(spark, D.status_from_exit(F.lit(None).cast("int"), F.lit(0))) == "error"


def test_contract_extractors(spark):
    x = F.col("x")
    assert value(spark, N.env_declarations(x), "#A_1=1\nexport B_2 =x\r\nC_3=\nB_2=2\nlow=1\nX=1") == ["B_2", "C_3"]
    assert value(spark, N.env_uses(x), 'const { AA: a, bb, CC_1 } = process.env\nprocess.env["DD"] + process.env.EE.x') == ["AA", "CC_1", "DD", "EE"]
    files = spark.createDataFrame([("a.ts", "const A = z.object({ a: z.string(), b: z.array(z.object({ c: z.date() })).nullish() })"), ("b.ts", "z.object({"), ("c.ts", None)], "path string, text string")
    got = {(r.schema_name, r.field_name, r.optional, r.type_hint) for r in N.code_schemas(files).collect()}
    assert ("A", "a", False, "string") in got and any(r[1] == "b" for r in got)


@pytest.mark.parametrize("payload,want", [('{"a":1}', []), ('{"a":"x"}', ["$.a: is not integer"]), ("{}", ["$.a: is required"]), ("[", ["$: no JSON"]), ("[1]", ["$: is not object"]), ('{"a":99}', ["$.a: is beyond the maximum"])])
def test_payload_problems(spark, payload, want):
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "maximum": 9}}}
    assert value(spark, N.payload_problems(F.col("x"), schema), payload) == want


def test_trace_of_nested_objects(spark):
    deep = {"log": {"entries": [{"request": {"url": "https://x/y", "method": "POST"}, "response": {"status": 503}, "time": 12.5}, {"error": {"message": "token=abc broke"}, "type": "error"}]}}
    rows = [(1, json.dumps(deep, indent=1)), (2, '{"type":"log","text":"fine"}\nwords that are no json'), (3, ""), (4, None)]
    got = E.trace_evidence(spark.createDataFrame(rows, "k long, raw string"), "k")
    call = got["network"].collect()
    assert [(r.k, r.method, r.status, r.duration_ms) for r in call] == [(1, "POST", 503, 12.5)]
    assert [(r.k, r.error) for r in got["errors"].collect()] == [(1, "token=[redacted] broke")]
    assert [(r.k, r.type) for r in got["console"].filter("k = 2").collect()] == [(2, "log")]


def test_zip_entries(spark):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a/trace.trace", "{}")
        z.writestr("shot.PNG", "x")
    files = spark.createDataFrame([("a.zip", bytearray(held.getvalue())), ("b.zip", bytearray(b"odd")), ("c.zip", None)], "path string, content binary")
    assert sorted((r.entry, r.kind) for r in E.zip_entries(files).collect()) == [("a/trace.trace", "trace"), ("shot.PNG", "screenshot")]


def test_zip_entries_go_on_together(spark):
    """A frame an entry made reading many small archives slower than anything else; and all of one row group lay in one task."""
    import pandas as pd

    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a.trace", "x" * 10)
        z.writestr("b.har", "y")
    frames = list(E._entries(iter([pd.DataFrame({"path": [f"{i}" for i in range(200)], "content": [held.getvalue()] * 200})] * 2)))
    assert len(frames) == 1 and len(frames[0]) == 800
    whole = list(E._entries(iter([pd.DataFrame({"path": ["0"] * 6000, "content": [held.getvalue()] * 6000})])))
    assert sum(map(len, whole)) == 12_000 and max(map(len, whole)) <= E.FRAME_ROWS
    few = spark.range(0, 1000, 1, spark.sparkContext.defaultParallelism)  # as many splits as cores, which may all but one be empty
    assert spread(few).rdd.getNumPartitions() > few.rdd.getNumPartitions()


def test_page_operators(spark):
    x, none = F.col("x"), F.lit(None).cast("string")
    for text, want in {"HTTP 500 from scraper_core": "scraper_core_http_5xx", "request aborted": "local_timeout", "": "none", "x": "unknown", "weak_extraction": "scraper_core_weak_extraction"}.items():
        assert value(spark, W.url_issue(x, none), text) == want
    assert value(spark, W.extract_facts(x), "Price 5\nno\nprice 5\n12 items\nлимит") == ["Price 5", "12 items", "лимит"]


def test_path_policy(spark):
    tree = ["a.ts", "x/node_modules/y/b.ts", "build/c.ts", "d/my_token.txt", "e/.env.local", "gen/f.ts", "z/gen/f.ts", "g.test.ts", "logs/deep/h.log", "src/i.md"]
    frame = spark.createDataFrame([(p,) for p in tree], "path string")
    ok = lambda **k: [r.path for r in frame.filter(A.path_policy(F.col("path"), **k)).orderBy("path").collect()]
    assert ok() == ["a.ts", "g.test.ts", "gen/f.ts", "logs/deep/h.log", "src/i.md", "z/gen/f.ts"]
    assert ok(ignore=("gen/", "# x", "!a.ts", "*.log"), include_tests=False) == ["a.ts", "src/i.md"]
    assert ok(include=("**/*.ts",), exclude=("!z/**",)) == ["a.ts", "g.test.ts", "gen/f.ts"]
    assert A.ignore_globs("./a/b") == ["a/b", "a/b/**"] and A.ignore_globs("x") == ["x", "**/x", "x/**", "**/x/**"] and A.ignore_globs("  ") == []


def test_edit_needs_its_test(spark):
    edits = spark.createDataFrame([("p/src/a.py",), ("p/src/b.py",), ("q/src/c.ts",), ("p/docs/d.md",), ("lib/e.py",)], "path string")
    files = spark.createDataFrame([("p/tests/unit/test_a.py",), ("p/src/a.py",)], "path string")
    got = {r.path: (r.allowed, r.reason) for r in S.edit_checks(edits, files).collect()}
    assert got == {"p/src/a.py": (True, "test found"), "p/src/b.py": (False, "no matching test"), "q/src/c.ts": (True, "no tests folder"), "p/docs/d.md": (True, "no code"), "lib/e.py": (True, "not in src")}


def test_leaks_and_samples(spark):
    raw = json.dumps({"a": [{"notes": 1}, "plain", "my feedback.jsonl"], "query": {"deep": "ok"}})
    got = sorted((r.path, r.reason) for r in S.leak_scan(spark.createDataFrame([(1, raw), (2, None)], "k long, raw string"), "k").collect())
    assert got == [("a.0.notes", "forbidden_key:notes"), ("a.2", "forbidden_value:feedback.jsonl"), ("query", "forbidden_key:query")]
    assert json.loads(value(spark, S.safe_sample(F.col("x")), json.dumps({"keep": list(range(30)), "raw_text": 1, "MyPath": 2}))) == {"keep": list(range(20))}


def test_boxes_merge_until_none_touch(spark):
    rows = [("i", 0, 0, 10, 10, 5), ("i", 25, 0, 30, 10, 5), ("i", 100, 100, 110, 110, 1), ("i", 40, 25, 95, 95, 2), ("j", 0, 0, 1, 1, 1)]
    got = sorted(map(tuple, V.merge_boxes(spark.createDataFrame(rows, "image string, x0 int, y0 int, x1 int, y1 int, pixels int")).collect()))
    assert got == [("i", 0, 0, 110, 110, 13), ("j", 0, 0, 1, 1, 1)]


def test_module_depth_of_scripts(spark):
    body = "\n".join(f"  const v{i} = {i};" for i in range(30))
    text = f"// c\nexport function big(a, b = f(1, 2), c) {{\n{body}\n}}\nexport const two = (x) => x;\nclass Own {{}}"
    row = M.module_depth(spark.createDataFrame([("m.ts", text)], "path string, text string")).first()
    assert (row.public_symbols, row.loc, row.factors) == (2, 30, ["god_function:big:30"])
    assert {(r.function, r.body_lines) for r in M.function_bodies(spark.createDataFrame([("m.ts", text)], "path string, text string")).collect()} == {("big", 30), ("two", 0)}


def test_cycles_of_any_length_and_components(spark):
    ring = [(i, (i + 1) % 9) for i in range(9)]
    edges = spark.createDataFrame([*ring, (3, 3), (20, 0), (8, 30), (40, 41), (41, 40), (40, 0)], "src int, dst int")
    assert sorted(map(tuple, (r[0] for r in G.cycles(edges).collect()))) == [(0, 1, 2, 3, 4, 5, 6, 7, 8), (3,), (40, 41)]
    assert {(r.node, r.component) for r in G.strong_components(edges).collect()} == {(i, 8) for i in range(9)} | {(40, 41), (41, 41)}
    assert G.cycles(spark.createDataFrame([(1, 2)], "src int, dst int")).count() == 0


def test_skyline_is_that_of_all_pairs(spark):
    rng = random.Random(3)
    rows = [(i, float(rng.randint(0, 30)), float(rng.randint(0, 30)), float(rng.randint(0, 30))) for i in range(400)]
    beaten = lambda x: any(all(b >= a for a, b in zip(x[1:], y[1:])) and y[1:] != x[1:] for y in rows)
    got = stats.pareto(spark.createDataFrame(rows, "k int, a double, b double, c double").repartition(5), "k", ["a", "b", "c"])
    assert sorted(r.k for r in got.collect()) == [x[0] for x in rows if not beaten(x)]


def test_bootstrap_covers_like_drawing_with_replacement(spark):
    rng = random.Random(1)
    values = [rng.random() for _ in range(300)]
    row = stats.bootstrap(spark.createDataFrame([("g", i, v) for i, v in enumerate(values)], "g string, c int, v double"), "g", "c", "v").first()
    draws = sorted(sum(rng.choices(values, k=300)) / 300 for _ in range(2000))
    assert abs(row.low - draws[50]) < 0.012 and abs(row.high - draws[1949]) < 0.012 and row.clusters == 300


def test_erf(spark):
    frame = spark.createDataFrame([(x / 7,) for x in range(0, 60)], "x double")
    assert all(abs(r[1] - math.erf(r[0])) < 1e-14 for r in frame.select("x", stats.erf(F.col("x"))).collect())


def test_small_windows(spark):
    rows = spark.createDataFrame([("a", 3, "x"), ("a", 9, ""), ("b", 4, "y"), ("a", 7, "z")], "g string, s int, v string")
    assert {(r.g, r.top, r.gap) for r in X.score_gap(rows, "g", "s", "v").collect()} == {("a", 9, 2), ("b", 4, 4)}
    assert {(r.g, r["first"]) for r in X.first_value(rows.withColumn("o", -F.col("s")), ["g"], "v", "o").collect()} == {("a", "z"), ("b", "y")}
    assert value(spark, F.array_join(X.adjacent_pairs(F.split("x", " ")), ","), "a b c") == "a-b,b-c" and value(spark, F.size(X.adjacent_pairs(F.split("x", " "))), "a") == 0


def test_routes_with_cyrillic_words(spark):
    """Word edges are ASCII: a Cyrillic word between two of them is only met where Latin letters touch it."""
    texts = {"a": "где это сделано", "b": "x" + "где" + "y", "c": "исправь", "d": "сравни https://x.org/a).", "e": "public repo file list and notion mirror"}
    got = {r.k: (r.decision, r.tools) for r in O.route(spark.createDataFrame(list(texts.items()), "k string, text string"), "k").collect()}
    assert got == {"a": ("skip", ""), "b": ("call", "retrieval"), "c": ("ask", ""), "d": ("skip", ""), "e": ("call", "retrieval,docs,cleanup")}


def test_retrieval_extras(spark):
    symbols = spark.createDataFrame([("a", f"getUser{i}", "function", None) for i in range(9)] + [("b", "x", "route", "user id")], "path string, name string, kind string, signature string")
    imports = spark.createDataFrame([("b", "./users")], "path string, target string")
    assert {(r.path, r.score) for r in R.symbol_score(symbols, imports, ["user"]).collect()} == {("a", 60), ("b", 7)}
    assert value(spark, R.domain_expansion(F.array(F.lit("Screenshots")), "test")) == ["prepare_screenshot", "image_urls_for_model", ".test.", ".spec.", "describe(", "it("]


def test_terms_of_a_column_are_those_of_one_query(spark):
    words = ["running", "queries", "Users", "planning", "x1", "classes", "sing", "builder", "ring", "dies"]
    frame = spark.createDataFrame([(w,) for w in words], "x string")
    got = frame.select("x", R.variants_of(F.col("x")).alias("v"), R.query_terms_of(F.col("x")).alias("q")).collect()
    assert all(r.v == R.variants(r.x) and r.q == R.query_terms(r.x) for r in got)
    assert value(spark, R.compounds_of(F.lit("push"), F.lit("Token"))) == R.compounds("push", "Token")


def test_coverage_gates(spark):
    rows = [("a", "production_like", True, None), ("b", "production_like", False, "boom"), ("c", "proof", False, "boom"), ("d", "other", False, "url is not allowed")]
    services = K.coverage(spark.createDataFrame(rows, "service string, traffic string, ok boolean, error string"), (), ("a", "d"))
    assert {r.service: r.status for r in services.collect()} == {"a": "active", "b": "active", "c": "visible_idle", "d": "visible_idle"}
    assert {(r.profile, r.passed) for r in K.coverage_gates(services).collect()} == {("core", True), ("extended", False)}


def test_api_texts_are_read_after_they_are_dealt_out(spark, tmp_path, capsys):
    """A filter on what was read went in front of the dealing: one task read all texts of a small file, and all were read again."""
    spark.createDataFrame([("a", "openapi: '3'\npaths: {/x: {get: {}}}"), ("b", "swagger: 1"), ("c", "x: 1"), ("d", None)], "path string, text string").coalesce(1).write.parquet(str(tmp_path / "f"))
    files = spark.read.parquet(str(tmp_path / "f"))
    rows = N.api_operations(files)
    for df in (rows, N.api_schemas(files)):
        capsys.readouterr()
        df.explain()
        read, _, dealt = capsys.readouterr().out.partition("Exchange RoundRobin")
        assert read.count("ArrowEvalPython") == 1 and dealt and "Python" not in dealt
    assert [(r.path, r.method, r.path_template) for r in rows.collect()] == [("a", "GET", "/x")]


def test_normal_cdf_is_dealt_out(spark, capsys):
    """160 terms a row: a small file is one task's work unless its rows are dealt out."""
    spark.range(50).selectExpr("id as p_partkey", "cast(id as int) as p_size").createOrReplaceTempView("part_sizes")
    t = lambda name: spark.table("part_sizes").coalesce(1)
    rows = part_queries.fn_normal_cdf(t)
    assert {r.p_partkey: r.value for r in rows.collect()}[25] == 5e9
    rows.explain()
    assert "Exchange RoundRobin" in capsys.readouterr().out


def test_traces_are_parsed_once(spark, tmp_path, capsys):
    """Each kind of evidence parsed all texts again, in one task where they are one row group."""
    lines = '{"type":"console","messageType":"error","text":"boom","time":3}\n{"callId":"c","apiName":"a.b","startTime":1,"endTime":2}\n{"url":"u","status":500,"duration_ms":2}'
    traces = spark.createDataFrame([(1, lines), (2, "plain"), (3, None), (4, '[{"url":"v","status":404,"duration_ms":1}]')], "k long, raw string")
    got = E.prepare(traces, "k")
    assert {r.k: tuple(r)[1:5] for r in got.collect()} == {1: (1, 1, 1, "boom"), 2: (0, 0, 0, None), 3: (0, 0, 0, None), 4: (0, 1, 0, "v")}
    for df in (got, *E.trace_evidence(traces, "k").values()):
        df.explain()
    assert "Python" not in capsys.readouterr().out


def test_graph_rounds_stay_off_the_driver(spark, capsys, monkeypatch):
    """Small tables of each round were broadcast, so all of them went through the driver."""
    real = G.saved

    def shown(df):
        df.explain()
        return real(df)

    monkeypatch.setattr(G, "saved", shown)
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5), (5, 6), (6, 4), (3, 4)], "src long, dst long")
    assert sorted(map(tuple, G.strong_components(edges, 2).collect())) == [(1, 3), (2, 3), (3, 3), (4, 6), (5, 6), (6, 6)]
    assert "Broadcast" not in capsys.readouterr().out


def test_complexity_is_counted_after_the_dealing(spark, tmp_path, capsys):
    spark.createDataFrame([("a.ts", "function f() {\n if (a) {}\n}"), ("b.ts", ""), ("c.ts", None)], "path string, text string").coalesce(1).write.parquet(str(tmp_path / "f"))
    rows = code.complexity(spark.read.parquet(str(tmp_path / "f")))
    rows.explain()
    counted, _, dealt = capsys.readouterr().out.partition("Exchange RoundRobin")
    assert "regexp_extract_all" in counted and dealt and "regexp_extract_all" not in dealt
    assert [(r.path, r.lines, r.branches) for r in rows.collect()] == [("a.ts", 3, 1)]
