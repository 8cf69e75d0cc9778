"""Steps that grew too fast on larger tables: what they shuffle, and that their short cuts change no result."""

from pyspark.sql import functions as F

from strataloom.functions import predicates as P
from strataloom.operators import graph as G
from strataloom.operators import graph_index as GI
from strataloom.operators import modules as M
from strataloom.operators import route as O


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tokens_that_are_no_symbols_are_dropped_before_the_join(spark):
    tokens = spark.range(3000).select(F.concat(F.lit("t"), F.col("id") % 1000).alias("token"), F.col("id").alias("path"), F.lit(1).alias("line"))
    symbols = spark.range(5).select(F.concat(F.lit("t"), "id").alias("symbol"), F.col("id").alias("path"), F.lit(1).alias("line"))
    left = G.marked(tokens, symbols.select(F.col("symbol").alias("token")).distinct(), "token")
    assert left.filter(F.col("path") % 1000 < 5).count() == 15 and left.count() < 30
    assert "strategy=broadcast" in plan_of(G.references(tokens, symbols))
    got = sorted(tuple(r) for r in G.references(tokens, symbols).select("token", "path", "rank").collect())
    assert got == [(f"t{i}", i + 1000 * k, k) for i in range(5) for k in (1, 2)]


def test_imports_of_one_place_are_resolved_once(spark):
    imports = spark.createDataFrame([(f"src/{i}.ts", t, 1, "import") for i in range(3) for t in ("./m", "../src/m", "a.b", "./gone")], "path string, target string, line int, kind string")
    files = spark.createDataFrame([("src/m.ts",), ("src/m/index.ts",), ("a/b.py",)], "path string")
    out = GI.resolved(imports, files)
    assert {(r.target, r.resolved_path) for r in out.collect()} == {("./m", "src/m.ts"), ("../src/m", "src/m.ts"), ("a.b", "a/b.py"), ("./gone", None)}
    assert out.count() == 12 and out.columns == ["path", "target", "line", "kind", "resolved_path"]
    assert "Aggregate [local" in plan_of(out)


def test_modules_are_summed_up_without_their_text(spark):
    files = spark.createDataFrame([("m.py", "def run(a, b, c, d, e):\n\tif a:\n\t\treturn b\n# x\nclass C:\n  pass"), ("n.ts", None)], "path string, text string")
    out = M.module_depth(files)
    assert [tuple(r) for r in out.collect()] == [("m.py", 6.5, 15, 2.31, "shallow", 2, 3, ["many_params:run:5", "deep_nesting:4"])]
    assert "collect_list(CASE" not in plan_of(out)  # over all lines


def test_a_first_look_loses_no_text(spark):
    pattern = P.UNIT_SCORES[2][0]
    texts = ["$5", "€x", "12%", "1.5%", "a 2024-01-02 b", "1-2", "3x", "3.5X ", "3xy", "v3x", "plain", "", "9"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    full = F.col("t").rlike("(?iu)" + pattern.replace(r"\b", P.ASCII_EDGE))
    assert P.FIRST_LOOK[pattern] in plan_of(rows.select(P.matches(F.col("t"), pattern)))
    assert [r[0] for r in rows.select(P.matches(F.col("t"), pattern)).collect()] == [r[0] for r in rows.select(full).collect()]


def test_words_that_a_pattern_needs(spark):
    assert P.needed(r"\b(run|check)\s+(tests?|build)\b|\bproof loop\b") == ["run", "check", "proof loop"]
    assert P.needed(r"ab?cd{2}efg|(x|yy)?") == [] and P.needed("abc{0,2}de|x+yz") == ["ab", "yz"]
    patterns = [*O.TASKS.values(), *O.RISKS.values(), r"\berror:\s.+"]
    texts = ["RUN  Tests", "Where is it", "Credential and TOKEN", "public repository file list", "public repo file list", "ERROR: x", "unused dependencies", "ПРОЧИТАЙ\u0130", "PARſE it", "Lıcense", "C:/har", "\u212aey to\u212aen", "fix it", "vulnerabilit"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    same = rows.select(F.array(*(P.matches(t, p) for p in patterns)).alias("a"), F.array(*(P.matches_folded(t, P.folded(t), p) for p in patterns)).alias("b")).collect()
    assert all(r.a == r.b for r in same) and sum(map(sum, (r.a for r in same))) > 10


def test_routes_ask_each_pattern_once(spark):
    out = O.route(spark.createDataFrame([(1, "where is https://a.b/c.png ? error: x"), (2, None), (3, "fix it")], "k int, text string"), "k")
    assert plan_of(out).count(r"(?m)^\s*at\s") == 1
    assert [tuple(r) for r in out.orderBy("k").collect()] == [(1, "screenshot,logs", "call", "", 0.96), (2, "", "skip", "", 0.82), (3, "", "ask", "ambiguous_task", 0.72)]
