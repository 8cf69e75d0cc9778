"""Readers and sinks on files that are written for them, outlines of data files, notes and receipts."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.operators import code as C
from strataloom.operators import knowledge as G
from strataloom.operators import receipts as A
from strataloom.session import scratch
from strataloom.sources import readers as IN
from strataloom.sources import writers as OUT

from .registry import query
from .scalar_queries import scalar
from .tool_queries import line

K = lambda: F.col("p_partkey")
PART = ("part", "p_partkey")


@query("src_jsonl", "SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey % 10 <> 0")
def src_jsonl(t):
    path, spark = scratch(t("part").sparkSession), t("part").sparkSession
    t("part").select(F.when(K() % 10 == 0, "{bad").otherwise(F.to_json(F.struct(K().alias("id"), F.col("p_name").alias("name")))).alias("value")).write.text(path)
    return IN.json_lines(spark, path, "id long, name string")


@query("src_jsonl_fixtures", "SELECT 'd' || doc_id AS id, length(text) AS chars FROM documents")
def src_jsonl_fixtures(t):
    path, spark = scratch(t("documents").sparkSession), t("documents").sparkSession
    t("documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("input")).write.json(path)
    return IN.json_lines(spark, path, "id string, input string").select("id", F.length("input").alias("chars"))


@query("src_json", "SELECT count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS total FROM part")
def src_json(t):
    path, spark = scratch(t("part").sparkSession), t("part").sparkSession
    whole = t("part").agg(F.to_json(F.struct(F.count("*").alias("n"), F.sum("p_partkey").alias("total"))).alias("value"))
    whole.select(F.regexp_replace("value", ",", ",\n")).coalesce(1).write.text(path)
    return IN.json_file(spark, path, "n long, total long")


def tree(t) -> str:
    """A folder with text files of parts below src, docs and node_modules."""
    root = scratch(t("part").sparkSession)
    for name, rest in (("src", 0), ("docs", 1), ("node_modules/x", 2)):
        t("part").filter(K() % 3 == rest).select("p_name").write.text(f"{root}/{name}")
    return root


def per_folder(files):
    lines = F.size(F.split(F.rtrim("text", F.lit("\n")), "\n"))
    return files.groupBy(F.substring_index("path", "/", 1).alias("folder")).agg(F.sum(F.when(F.col("text") != "", lines).otherwise(0)).alias("lines"))


FOLDERS = "SELECT CASE p_partkey % 3 WHEN 0 THEN 'src' ELSE 'docs' END AS folder, count(*) AS lines FROM part WHERE p_partkey % 3 < 2 GROUP BY 1"


@query("src_rg_files", FOLDERS)
@query("src_file_text", FOLDERS)
@query("src_repo_walk", FOLDERS)
def src_repo_walk(t):
    return per_folder(IN.repository(t("part").sparkSession, tree(t), most_bytes=None))


@query("src_docs_walk", f"{FOLDERS} HAVING folder = 'docs'")
@query("src_docs_roots", f"{FOLDERS} HAVING folder = 'docs'")
def src_docs_roots(t):
    return per_folder(IN.under(IN.repository(t("part").sparkSession, tree(t), (".txt",), None), ("docs",)))


@query("src_contract_walk", f"{FOLDERS} HAVING folder = 'src'")
def src_contract_walk(t):
    return per_folder(IN.repository(t("part").sparkSession, tree(t), most_bytes=None).filter(F.col("path").startswith("src/")))


@query("src_gate_walk", "SELECT CASE p_partkey % 4 WHEN 0 THEN 'a.ts' WHEN 1 THEN 'b.bin' WHEN 2 THEN 'dist/c.ts' ELSE 'dist/d.bin' END || p_partkey AS name, CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS rank FROM part")
def src_gate_walk(t):
    name = F.element_at(F.array(*map(F.lit, ("a", "b", "dist/c", "dist/d"))), (K() % 4 + 1).cast("int"))
    end = F.when(K() % 2 == 0, ".ts").otherwise(".bin")
    files = t("part").select(F.concat(name, K().cast("string"), end).alias("path"), F.concat(name, end, K().cast("string")).alias("name"))
    return IN.gate_files(files).select("name", "rank")


@query("sink_jsonl_append", "SELECT service, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM (SELECT event_id, unnest(['a', 'b']) AS service FROM events) GROUP BY 1")
def sink_jsonl_append(t):
    path, spark = scratch(t("events").sparkSession), t("events").sparkSession
    for service in ("a", "b"):
        OUT.append_events(t("events").select("event_id"), path, service, "1")
    return IN.json_lines(spark, path, "event_id long, service string").groupBy("service").agg(F.count("*").alias("n"), F.sum("event_id").alias("total"))


@query("sink_json_artifact", "SELECT count(DISTINCT text) AS artifacts, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT DISTINCT text FROM documents)")
def sink_json_artifact(t):
    path, spark = scratch(t("documents").sparkSession), t("documents").sparkSession
    OUT.write_artifacts(t("documents").select("text"), path, "doc")
    return spark.read.parquet(path).agg(F.count_distinct("artifact").alias("artifacts"), F.sum(F.length("text")).alias("chars"))


@query("sink_ledger_init", "SELECT 'f' || p_partkey AS feature_id, p_partkey % 4 = 0 AS passed FROM part")
def sink_ledger_init(t):
    name = F.concat(F.lit("f"), K().cast("string")).alias("feature_id")
    known = t("part").filter(K() % 4 == 0).select(name, F.lit(True).alias("passed"), F.lit("x").alias("evidence"))
    return OUT.init_ledger(t("part").select(name), known).select("feature_id", "passed")


@query("sink_link_registry", "SELECT DISTINCT p_brand AS test_file, 'src/' || p_size AS impl_glob FROM part")
def sink_link_registry(t):
    links = t("part").select(F.col("p_brand").alias("test_file"), F.concat(F.lit("src/"), F.col("p_size").cast("string")).alias("impl_glob"))
    return OUT.link_registry(links.filter(K() % 2 == 0), links)


MARKDOWN, _ = line("# Top ⟨p_size⟩\ntext\n### Sub ##")
YAML, _ = line("name: ⟨p_name⟩\n  inner: 1\nk.⟨p_size⟩: 2")
JSON, _ = line('{\n  "ab⟨p_size⟩": 1,\n  "x": 2,\n  "cd": {}\n}')
TOML, _ = line("[tool.⟨p_size⟩]\nkey = 1\n# c")


@query("fn_parse_outline", "SELECT ['m.md', 'y.yaml', 'j.json', 't.toml'][p_partkey % 4 + 1] || p_partkey AS path, unnest(CASE p_partkey % 4 WHEN 0 THEN [1, 3] WHEN 1 THEN [1, 3] WHEN 2 THEN [2, 4] ELSE [1, 2] END) AS line, unnest(CASE p_partkey % 4 WHEN 0 THEN ['heading1', 'heading3'] ELSE ['key', 'key'] END) AS kind, unnest(CASE p_partkey % 4 WHEN 0 THEN ['Top ' || p_size, 'Sub'] WHEN 1 THEN ['name', 'k.' || p_size] WHEN 2 THEN ['ab' || p_size, 'cd'] ELSE ['tool.' || p_size, 'key'] END) AS name FROM part")
def fn_parse_outline(t):
    k = K() % 4
    text = F.when(k == 0, MARKDOWN()).when(k == 1, YAML()).when(k == 2, JSON()).otherwise(TOML())
    name = F.element_at(F.array(*map(F.lit, ("m.md", "y.yaml", "j.json", "t.toml"))), (k + 1).cast("int"))
    files = t("part").select(F.concat(K().cast("string"), F.lit("/"), name).alias("path"), text.alias("text"))
    return C.outline(files).select(F.concat(F.substring_index("path", "/", -1), F.substring_index("path", "/", 1)).alias("path"), "line", "kind", "name")


PYTHON, _ = line("from a.b⟨p_size⟩ import c\nimport os.path as p\nclass C⟨p_partkey % 3⟩(D):\n    async def f(self):\n        pass")


@query("fn_parse_python", "SELECT p_partkey || '.py' AS path, unnest([1, 2, 3, 4]) AS line, unnest(['import', 'import', 'class', 'function']) AS kind, unnest(['a.b' || p_size, 'os.path', 'C' || p_partkey % 3, 'f']) AS name FROM part")
def fn_parse_python(t):
    files = t("part").select(F.concat(K().cast("string"), F.lit(".py")).alias("path"), PYTHON().alias("text"))
    return C.imports(files).withColumnRenamed("target", "name").unionByName(C.symbols(files))


scalar("fn_rag_terms", *PART, lambda: F.array_join(G.search_terms(F.when(K() % 2 == 0, "Main Button").otherwise("none"), F.concat(F.lit("The padding is "), F.col("p_brand"))), ","), "CASE WHEN p_partkey % 2 = 0 THEN 'button,click,cta,action,disabled,padding,margin,spacing,layout,css' ELSE 'padding,margin,spacing,layout,css,' || lower(p_brand) END")
NOTE, _ = line("## Title ⟨p_size⟩\ncss rules\n- ⚠️ do not ⟨p_name⟩\nthe layout word\n\n\n\n\nlate word")


@query("fn_rag_gotcha", "SELECT p_partkey AS note, unnest([4, 9]) AS line, unnest(['Title ' || p_size, 'Issue related to \"word\"']) AS title, unnest(['⚠️ do not ' || p_name, chr(10) || chr(10) || chr(10) || 'late word...']) AS description, unnest(['css', 'general']) AS category, unnest(['high', 'medium']) AS severity FROM part")
def fn_rag_gotcha(t):
    notes = t("part").select(K().alias("note"), NOTE().alias("text"))
    return G.gotchas(notes, ["word"], "note").drop("term")


@query("fn_assemble_receipt", "SELECT event_id, event_type <> 'view' AS changed, CAST(10 + length(event_type) AS INT) AS size, FALSE AS navigated, TRUE AS stable FROM events")
def fn_assemble_receipt(t):
    before, after = F.lit("<p>view</p>"), F.concat(F.lit("<p>"), "event_type", F.lit("</p>"))
    action = F.struct(F.lit("click").alias("type"), F.lit("#a").alias("selector"), F.lit(None).cast("string").alias("value"))
    r = t("events").select("event_id", A.assemble(action, F.lit("u"), before, F.lit("u"), after).alias("r"))
    return r.select("event_id", F.col("r.post_state.changed").alias("changed"), (F.col("r.post_state.dom_region_size_bytes") + 3).alias("size"), "r.post_state.navigated", "r.post_state.stable")
