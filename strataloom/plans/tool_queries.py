"""Outputs of tools, contracts, traces, web pages, paths, regions and modules, made from the tables of a folder."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataloom.functions import text as T
from strataloom.operators import cases as C
from strataloom.operators import contracts as N
from strataloom.operators import diagnostics as D
from strataloom.operators import diffs
from strataloom.operators import evidence as E
from strataloom.operators import html_tree as H
from strataloom.operators import modules as M
from strataloom.operators import paths as P
from strataloom.operators import retrieve as R
from strataloom.operators import safety as S
from strataloom.operators import vision as V
from strataloom.operators import web as W
from strataloom.session import spread
from strataloom.sources import readers as IN

from .registry import query
from .scalar_queries import scalar
from .text_queries import trim

K = lambda: F.col("p_partkey")
PART = ("part", "p_partkey")
Q = lambda s: s.replace("'", "''")


def line(template: str) -> tuple[Callable[[], Column], str]:
    """A text from literal parts and ⟨SQL expressions⟩, as a column for Spark (when it runs) and as SQL for DuckDB."""
    pieces = re.split("[⟨⟩]", template)
    quoted = lambda text: "'" + Q(text).replace("\n", "' || chr(10) || '") + "'"
    sql = " || ".join(f"CAST({x} AS VARCHAR)" if i % 2 else quoted(x) for i, x in enumerate(pieces) if x)
    return lambda: F.concat(*(F.expr(x).cast("string") if i % 2 else F.lit(x) for i, x in enumerate(pieces) if x)), sql


def made(t, raw: Column | Callable[[], Column], name: str = "output"):
    return t("part").select(K().alias("run_id"), (raw() if callable(raw) else raw).alias(name))


# --- diagnostics --------------------------------------------------------------------------------

TSC, TSC_SQL = line("building\n/repo/src/a⟨p_partkey⟩.ts(⟨p_size⟩,⟨p_partkey % 90⟩): error TS⟨1000 + p_partkey % 7⟩: Cannot find ⟨p_name⟩\n  lib/b.ts(1,2): warning TS6133: unused\nsrc/c.ts: nothing here")
GROUPS = lambda pattern, n: ", ".join(f"regexp_extract(x, '{Q(pattern)}', {i}) AS g{i}" for i in range(1, n + 1))
LINES_SQL = lambda raw: f"l AS (SELECT p_partkey, {trim('unnest(string_split(raw, chr(10)))')} AS x, generate_subscripts(string_split(raw, chr(10)), 1) AS i FROM (SELECT p_partkey, {raw} AS raw FROM part))"


@query("fn_parse_diag_tsc", f"WITH {LINES_SQL(TSC_SQL)}, g AS (SELECT *, {GROUPS(D.TSC_LINE, 6)} FROM l WHERE regexp_matches(x, '{Q(D.TSC_LINE)}')) SELECT p_partkey AS run_id, row_number() OVER (PARTITION BY p_partkey ORDER BY i)::INT AS place, replace(g1, '/repo/', '') AS file, g2::INT AS line, g3::INT AS \"column\", trim(g6) AS message, g5 AS rule_id, g4 AS severity, 'tsc' AS source FROM g")
def fn_parse_diag_tsc(t):
    return D.findings(made(t, TSC), "run_id", "tsc", root="/repo")


ESLINT, ESLINT_SQL = line("src/⟨p_brand⟩.js:⟨p_size⟩:⟨p_partkey % 9⟩  error  Missing semicolon  semi\n\nsrc/x.js:3:1 warning Unexpected ⟨p_name⟩\n2 problems")


@query("fn_parse_diag_eslint", f"WITH {LINES_SQL(ESLINT_SQL)}, g AS (SELECT *, {GROUPS(D.ESLINT_LINE, 6)} FROM l WHERE regexp_matches(x, '{Q(D.ESLINT_LINE)}')) SELECT p_partkey AS run_id, row_number() OVER (PARTITION BY p_partkey ORDER BY i)::INT AS place, g1 AS file, g2::INT AS line, g3::INT AS \"column\", trim(g5) AS message, nullif(g6, '') AS rule_id, g4 AS severity, 'eslint' AS source FROM g")
def fn_parse_diag_eslint(t):
    return D.findings(made(t, ESLINT), "run_id", "eslint")


ESLINT_JSON, _ = line('[{"filePath":"/repo/s⟨p_partkey⟩.js","messages":[{"line":⟨p_size⟩,"column":2,"message":"m ⟨p_name⟩","ruleId":"semi","severity":2},{"message":"","severity":1}]},{"filePath":"/repo/clean.js","messages":[]}]')


@query("fn_parse_diag_eslint_json", "SELECT p_partkey AS run_id, p::INT AS place, 's' || p_partkey || '.js' AS file, CASE WHEN p = 1 THEN p_size::INT END AS line, CASE WHEN p = 1 THEN 2 END AS \"column\", CASE WHEN p = 1 THEN 'm ' || p_name ELSE 'ESLint finding' END AS message, CASE WHEN p = 1 THEN 'semi' END AS rule_id, CASE WHEN p = 1 THEN 'error' ELSE 'warning' END AS severity, 'eslint' AS source FROM part, range(1, 3) r(p)")
def fn_parse_diag_eslint_json(t):
    return D.findings(made(t, ESLINT_JSON), "run_id", "eslint", root="/repo")


SEMGREP, _ = line('{"results":[{"path":"a/⟨p_partkey⟩.py","start":{"line":⟨p_size⟩,"col":4},"check_id":"r.⟨p_partkey % 5⟩","extra":{"message":"⟨p_name⟩","severity":"ERROR"}},{"path":"b.py"}]}')


@query("fn_parse_diag_semgrep", "SELECT p_partkey AS run_id, p::INT AS place, CASE WHEN p = 1 THEN 'a/' || p_partkey || '.py' ELSE 'b.py' END AS file, CASE WHEN p = 1 THEN p_size::INT END AS line, CASE WHEN p = 1 THEN 4 END AS \"column\", CASE WHEN p = 1 THEN p_name ELSE 'Semgrep finding' END AS message, CASE WHEN p = 1 THEN 'r.' || p_partkey % 5 END AS rule_id, CASE WHEN p = 1 THEN 'error' ELSE 'warning' END AS severity, 'semgrep' AS source FROM part, range(1, 3) r(p)")
def fn_parse_diag_semgrep(t):
    return D.findings(made(t, SEMGREP), "run_id", "semgrep")


GITLEAKS, _ = line('[{"File":"k/⟨p_partkey⟩.env","StartLine":⟨p_size⟩,"Description":"⟨p_name⟩ key","RuleID":"generic"}]')


@query("fn_parse_diag_gitleaks", "SELECT p_partkey AS run_id, 1 AS place, 'k/' || p_partkey || '.env' AS file, p_size::INT AS line, NULL::INT AS \"column\", p_name || ' key' AS message, 'generic' AS rule_id, 'error' AS severity, 'gitleaks' AS source FROM part")
def fn_parse_diag_gitleaks(t):
    return D.findings(made(t, GITLEAKS), "run_id", "gitleaks")


@query(
    "fn_parse_diag_tests",
    f"WITH l AS (SELECT doc_id, {trim('unnest(string_split(text, chr(10)))')} AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM l WHERE regexp_matches(x, '{D.FAILURE_LINE}')) SELECT doc_id, r::INT AS place, CASE WHEN length(x) <= 500 THEN x ELSE substr(x, 1, 476) || chr(10) || '...[truncated]' END AS message, CASE WHEN contains(lower(x), 'warn') THEN 'warning' ELSE 'error' END AS severity FROM r WHERE r <= 30",
)
def fn_parse_diag_tests(t):
    return D.findings(t("documents").select("doc_id", F.col("text").alias("output")), "doc_id", "tests").select("doc_id", "place", "message", "severity")


@query("fn_status_from_exit", "SELECT event_id, CASE WHEN event_id % 11 IN (0, 5) OR event_id % 13 = 0 THEN 'error' WHEN event_id % 11 = 1 AND event_type <> 'error' THEN 'passed' ELSE 'failed' END AS status FROM events")
def fn_status_from_exit(t):
    i = F.col("event_id")
    code = F.when(i % 11 == 0, 127).when(i % 11 == 1, 0).when(i % 11 == 5, F.lit(None)).otherwise(1)
    return t("events").select("event_id", D.status_from_exit(code, (F.col("event_type") == "error").cast("int"), i % 13 == 0).alias("status"))


@query("agg_finding_counts", "SELECT p_brand, 2 * count(*) AS total, count(*) AS errors, count(*) AS warnings, 0::BIGINT AS notices FROM part GROUP BY 1")
def agg_finding_counts(t):
    found = D.findings(made(t, TSC), "run_id", "tsc").join(t("part").select(K().alias("run_id"), "p_brand"), "run_id")
    return D.finding_counts(found, "p_brand")


@query("limit_findings", f"WITH {LINES_SQL(TSC_SQL)}, f AS (SELECT p_partkey AS run_id, regexp_extract(x, '{Q(D.TSC_LINE)}', 5) AS rule_id FROM l WHERE regexp_matches(x, '{Q(D.TSC_LINE)}')), r AS (SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY rule_id, run_id) AS r FROM f) SELECT run_id, rule_id, total, total > 20 AS truncated FROM r WHERE r <= 20")
def limit_findings(t):
    return D.limited(D.findings(made(t, TSC), "run_id", "tsc").select("run_id", "rule_id"), ["rule_id", "run_id"], 20)


OLD, OLD_SQL = line("  expect(a⟨p_partkey⟩).toBe(1)\nrun()\nassert x == ⟨p_size⟩")
NEW, NEW_SQL = line("assert x == ⟨p_size % 3⟩\nit.skip('y')\nexpect(a⟨p_partkey⟩).toBe(1)")
SIDE = lambda raw: f"SELECT DISTINCT p_partkey, {trim('unnest(string_split(raw, chr(10)))')} AS x FROM (SELECT p_partkey, {raw} AS raw FROM part)"


@query("set_removed_lines", f"WITH o AS ({SIDE(OLD_SQL)}), n AS ({SIDE(NEW_SQL)}) SELECT p_partkey AS run_id, 'removed assertion' AS kind, x AS text FROM o WHERE regexp_matches(x, 'expect\\(|assert') AND (p_partkey, x) NOT IN (SELECT * FROM n) UNION ALL SELECT p_partkey, 'new skip', x FROM n WHERE contains(x, '.skip(') AND (p_partkey, x) NOT IN (SELECT * FROM o)")
def set_removed_lines(t):
    side = lambda raw: made(t, raw, "text")
    return D.changed_assertions(side(OLD), side(NEW), "run_id", r"expect\(|assert", r"\.skip\(")


HYPO, _ = line("Falsifying example: test(\n    x=⟨p_size⟩,\n    name='⟨p_brand⟩',\n)\n\nmore = 1")


@query("fn_pbt_parse", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'falsified' WHEN 2 THEN 'passed' ELSE 'error' END AS outcome, CASE WHEN p_partkey % 4 = 1 THEN 'x=' || p_size || ', name=''' || p_brand || '''' END AS shrunk, CASE WHEN p_partkey % 4 = 2 THEN p_size::INT END AS tried FROM part")
def fn_pbt_parse(t):
    k = K() % 4
    err = F.when(k == 0, "ImportError: no").when(k == 1, HYPO()).otherwise("")
    out = F.concat(F.col("p_size").cast("string"), F.lit(" examples passed"))
    got = D.property_outcome(F.when(k == 2, out).otherwise(""), err, F.when(k == 2, 0).otherwise(1))
    return t("part").select(K(), got.alias("r")).select("p_partkey", "r.outcome", "r.shrunk", "r.tried")


@query("fn_pbt_parse_script", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'falsified' ELSE 'passed' END AS outcome, CASE WHEN p_partkey % 3 = 1 THEN '[' || p_size || ']' END AS counterexample, CASE WHEN p_partkey % 3 = 1 THEN p_partkey::INT END AS tried FROM part")
def fn_pbt_parse_script(t):
    k = K() % 3
    found, _ = line("Property failed after ⟨p_partkey⟩ tests\nCounterexample: [⟨p_size⟩]\nShrunk 2 times")
    got = D.property_outcome(F.when(k == 0, "Error: Cannot find module 'fast-check'").when(k == 1, found()).otherwise("ok"), F.lit(""), F.when(k == 2, 0).otherwise(1), "typescript")
    return t("part").select(K(), got.alias("r")).select("p_partkey", "r.outcome", "r.counterexample", "r.tried")


KINDS = ("a positive integer", "list of strings", "an int", "free text", "a map of x", "something", "non-empty  string", "bool flag")
scalar("fn_strategy_map", *PART, lambda: D.strategy(F.element_at(F.array(*map(F.lit, KINDS)), (K() % 8 + 1).cast("int"))), "['st.integers(min_value=1)', 'st.lists(st.text())', 'st.integers()', 'st.text()', 'st.dictionaries(st.text(), st.integers())', 'st.integers()', 'st.text(min_size=1)', 'st.booleans()'][p_partkey % 8 + 1]")

# --- contracts ----------------------------------------------------------------------------------

ENV, ENV_SQL = line("# X_⟨p_size⟩=1\nexport A_⟨p_partkey % 7⟩ = 2\n B⟨p_size⟩=x\nlower=1\nA_⟨p_partkey % 7⟩=3")
scalar("fn_env_decl", *PART, lambda: F.array_join(N.env_declarations(ENV()), ","), f"array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split({ENV_SQL}, chr(10)), lambda x: regexp_extract(regexp_replace(trim(x), '^export\\s+', ''), '^([A-Z][A-Z0-9_]{{1,}})\\s*=', 1)), lambda x: x <> ''))), ',')")
USE, USE_SQL = line("const a = process.env.AB_⟨p_partkey % 5⟩; b = process.env['C_⟨p_size⟩']\nconst { D_⟨p_size % 3⟩: d, low, E_1 } = process.env;")
scalar("fn_env_use", *PART, lambda: F.array_join(N.env_uses(USE()), ","), "array_to_string(list_sort(list_distinct(['AB_' || p_partkey % 5, 'C_' || p_size, 'D_' || p_size % 3, 'E_1'])), ',')")
ZOD, _ = line("import { z } from 'zod'\nexport const S⟨p_partkey⟩ = z.object({\n  id: z.string(),\n  n⟨p_size⟩: z.number().optional(),\n})\nconst r = { body: z.object({ ok: z.boolean() }) }")


@query("fn_zod", "SELECT 'f' || p_partkey AS path, unnest(['const_object', 'const_object', 'embedded_object']) AS schema_kind, unnest(['S' || p_partkey, 'S' || p_partkey, 'body']) AS schema_name, unnest([2, 2, 6]) AS line, unnest(['id', 'n' || p_size, 'ok']) AS field_name, unnest([FALSE, TRUE, FALSE]) AS optional, unnest(['string', 'number', 'boolean']) AS type_hint FROM part")
def fn_zod(t):
    return N.code_schemas(t("part").select(F.concat(F.lit("f"), K().cast("string")).alias("path"), ZOD().alias("text")))


API, _ = line('{"openapi":"3.0","paths":{"/a/⟨p_partkey⟩":{"get":{"operationId":"get⟨p_size⟩","parameters":[{"required":true},{"required":false}],"responses":{"200":{"content":{"application/json":{"schema":{"$ref":"#/components/schemas/R⟨p_size⟩"}}}}}},"summary":"x"},"/b":{"post":{"requestBody":{"content":{"application/json":{"schema":{"$ref":"#/c/Q"}}}}}}},"components":{"schemas":{"R⟨p_size⟩":{"type":"object","required":["b","a"],"properties":{"a":{},"b":{},"c":{}}}}}}')


API_YAML, _ = line("""# the same in YAML
openapi: "3.0"
paths:
  /a/⟨p_partkey⟩:
    summary: x
    get:
      operationId: get⟨p_size⟩
      parameters:
      - required: true
      - {required: false}
      responses:
        200:
          content:
            application/json: &media
              schema:
                $ref: '#/components/schemas/R⟨p_size⟩'
  /b: {post: {requestBody: {content: {application/json: {schema: {$ref: "#/c/Q"}}}}}}
components:
  schemas:
    R⟨p_size⟩:
      type: object
      required:
        - b
        - a
      properties: {a: {}, b: {}, c: {}}
""")
either = lambda: F.when(K() % 2 == 0, API()).otherwise(API_YAML())


@query("fn_openapi", "SELECT p_partkey AS run_id, unnest(['GET', 'POST']) AS method, unnest(['/a/' || p_partkey, '/b']) AS path_template, unnest(['get' || p_size, NULL]) AS operation_id, unnest([1, 0]) AS required_params, unnest([NULL, 'Q']) AS request_schema, unnest(['R' || p_size, NULL]) AS response_schema FROM part")
def fn_openapi(t):
    return N.api_operations(made(t, either, "text"), "run_id")


@query("fn_openapi_schemas", "SELECT p_partkey AS run_id, 'R' || p_size AS schema_name, 'object' AS type, 3 AS properties, 'a,b' AS required FROM part")
def fn_openapi_schemas(t):
    return N.api_schemas(made(t, either, "text"), "run_id").withColumn("required", F.array_join("required", ","))


scalar("fn_schema_ref", *PART, lambda: N.schema_ref(F.concat(F.lit("#/components/schemas/S"), K().cast("string"))), "regexp_extract('#/components/schemas/S' || p_partkey, '[^/]*$')")
STRUCTURED, STRUCTURED_SQL = line('{"n":⟨p_size⟩}')
scalar("src_structured", *PART, lambda: F.try_variant_get(N.structured(F.when(K() % 3 == 0, "n: 1").otherwise(STRUCTURED()), F.when(K() % 2 == 0, "a.JSON").otherwise("a.yaml")), "$.n", "int"), "CASE WHEN p_partkey % 3 <> 0 THEN p_size::INT WHEN p_partkey % 2 = 1 THEN 1 END")
SCHEMA = {"type": "object", "required": ["id", "tags"], "properties": {"id": {"type": "integer", "minimum": 3}, "kind": {"enum": ["a", "b"]}, "tags": {"type": "array", "items": {"type": "string"}}}}
PAYLOAD, _ = line('{"id":⟨p_size⟩,"kind":"⟨p_partkey % 2⟩","tags":["x",⟨p_partkey⟩]}')
scalar("fn_validate_payload", *PART, lambda: F.array_join(N.payload_problems(F.when(K() % 5 == 0, "{}").when(K() % 7 == 0, "{").otherwise(PAYLOAD()), SCHEMA), "; "), "CASE WHEN p_partkey % 5 = 0 THEN '$.id: is required; $.tags: is required' WHEN p_partkey % 7 = 0 THEN '$: no JSON' ELSE array_to_string(list_filter([CASE WHEN p_size < 3 THEN '$.id: is beyond the minimum' END, '$.kind: is none of the allowed values', '$.tags[]: is not string'], lambda x: x IS NOT NULL), '; ') END")
scalar("fn_license_norm", *PART, lambda: C.license_of(F.when(K() % 4 == 0, '" MIT "').when(K() % 4 == 1, F.concat(F.lit('["A'), F.col("p_size").cast("string"), F.lit('"," ",3,"B"]'))).when(K() % 4 == 2, '{"type":"ISC"}')), "CASE p_partkey % 4 WHEN 0 THEN 'MIT' WHEN 1 THEN 'A' || p_size || ' OR B' WHEN 2 THEN 'ISC' END")

# --- traces -------------------------------------------------------------------------------------

TRACE, _ = line('{"type":"console","messageType":"error","text":"boom ⟨p_size⟩","time":⟨p_partkey + 1⟩}\nplain words\n{"type":"before","callId":"c⟨p_partkey⟩","class":"Page","method":"click","startTime":5,"params":{"selector":"#b⟨p_size⟩"}}\n{"type":"resource-snapshot","snapshot":{"_monotonicTime":7,"time":20,"request":{"url":"https://x.org/⟨p_size⟩","method":"GET"},"response":{"status":⟨400 + p_partkey % 2 * 100⟩}}}')
trace = lambda t: E.trace_evidence(made(t, TRACE, "raw"), "run_id")


@query("src_har_trace", "SELECT p_partkey AS run_id, unnest(['console', 'network', 'action']) AS kind, unnest(['error: boom ' || p_size, 'GET https://x.org/' || p_size || ' ' || (400 + p_partkey % 2 * 100), 'Page.click #b' || p_size]) AS what, unnest([p_partkey + 1.0::DOUBLE, 7.0, 5.0]) AS at_ms FROM part")
def src_har_trace(t):
    e = trace(t)
    console = e["console"].select("run_id", F.lit("console").alias("kind"), F.concat_ws(": ", "type", "text").alias("what"), "at_ms")
    network = e["network"].select("run_id", F.lit("network").alias("kind"), F.concat_ws(" ", "method", "url", F.col("status").cast("string")).alias("what"), "at_ms")
    actions = e["actions"].select("run_id", F.lit("action").alias("kind"), F.concat_ws(" ", "api_name", "selector").alias("what"), F.col("start_ms").alias("at_ms"))
    return console.unionByName(network).unionByName(actions)


LOOSE, _ = line('{"a":⟨p_size⟩}\n\nnot json ⟨p_partkey⟩\n[1]')


@query("src_json_or_lines", "SELECT p_partkey AS run_id, unnest(range(0, 3))::INT AS place, unnest(['{\"a\":' || p_size || '}', '{\"text\":\"not json ' || p_partkey || '\"}', '[1]']) AS item FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, unnest(range(0, 2))::INT, unnest(['1', '{\"b\":2}']) FROM part WHERE p_partkey % 3 = 0")
def src_json_or_lines(t):
    raw = F.when(K() % 3 == 0, '[1,{"b":2}]').otherwise(LOOSE())
    return made(t, raw, "raw").select("run_id", F.posexplode(E.json_or_lines(F.col("raw"))).alias("place", "v")).select("run_id", "place", F.to_json("v").alias("item"))


@query("src_zip", "SELECT p_partkey || '.zip' AS path, unnest(['trace.trace', 'x/trace.network']) AS entry, unnest([length(p_name), 1]) AS size, unnest([p_name, 'n']) AS text, unnest(['trace', 'network']) AS kind FROM part WHERE p_partkey % 4 <> 0")
def src_zip(t):
    def _zipped(frames):
        """Archives for the zip query, made in the tasks."""
        import io
        import zipfile

        for frame in frames:
            out = []
            for key, text in zip(frame["p_partkey"], frame["text"]):
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w") as z:
                    z.writestr("trace.trace", text)
                    z.writestr("x/trace.network", "n")
                out.append(held.getvalue() if key % 4 else b"no archive")
            frame["path"], frame["content"] = frame["p_partkey"].astype(str) + ".zip", out
            yield frame[["path", "content"]]

    files = spread(t("part").select("p_partkey", F.col("p_name").alias("text"))).mapInPandas(_zipped, "path string, content binary")
    return E.zip_entries(files)


# --- web pages ----------------------------------------------------------------------------------

ISSUES = ("http 403", "scraper-core http 502", "timed out", "API key is not configured", "captcha", "", "odd", "scraper_core_empty_markdown", "http 404 scraper_core")
scalar("fn_url_issue", *PART, lambda: W.url_issue(F.element_at(F.array(*map(F.lit, ISSUES)), (K() % 9 + 1).cast("int")), F.lit(None).cast("string")), "['local_http_403', 'scraper_core_http_5xx', 'local_timeout', 'scraper_core_key_missing', 'local_js_or_challenge', 'none', 'unknown', 'scraper_core_empty', 'scraper_core_http_4xx'][p_partkey % 9 + 1]")
FACTS = f"SELECT doc_id, x, min(i) AS i FROM (SELECT doc_id, {trim('unnest(string_split(text, chr(10)))')} AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE x <> '' AND regexp_matches(x, '(?i){W.FACT[5:]}') GROUP BY doc_id, x"


@query("fn_extract_facts", f"WITH f AS ({FACTS}), u AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(x) ORDER BY i) AS o FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM u WHERE o = 1) SELECT d.doc_id, coalesce(string_agg(x, '␟' ORDER BY i), '') AS facts FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id AND r <= 18 GROUP BY d.doc_id")
def fn_extract_facts(t):
    return t("documents").select("doc_id", F.array_join(W.extract_facts(F.col("text")), "␟").alias("facts"))


scalar("pred_js_shell", "pages", "page_id", lambda: W.is_script_shell(F.col("html"), F.substring("html", 1, F.col("page_id").cast("int") % 1200)), f"length(substr(html, 1, page_id % 1200)) < 800 AND regexp_matches(substr(html, 1, 50000), '{W.SHELL}')")
scalar("fn_url_uncertainty", *PART, lambda: W.url_uncertainty(F.when(K() % 3 == 0, F.array(F.lit("weak_extraction"))), K() % 3 == 1), "CAST(CASE p_partkey % 3 WHEN 0 THEN 0.05 WHEN 1 THEN 0.025 ELSE 0.02 END AS DOUBLE)")
@query("prep_url")
def prep_url(t):
    out = W.prepared_pages(t("pages"))
    links = F.transform("links", lambda x: F.concat(x["text"], F.lit("␟"), x["url"]))
    return out.withColumns({"links": links}).withColumns({c: F.array_join(c, "␞") for c in ("headings", "links", "facts", "warnings")})


@query("fn_html_main")
def fn_html_main(t):
    return H.main_parts(H.elements(t("pages"))).select(F.col("key").alias("page_id"), "title", "text")


# --- paths --------------------------------------------------------------------------------------

TREE = ("src/a.ts", "node_modules/x/a.js", "lib/dist/b.js", "b/.env.local", "my-secrets.txt", "docs/readme.md", "gen/x/y.ts", "a/tests/t.py", "tmp/z.log")
tree = lambda: F.element_at(F.array(*map(F.lit, TREE)), (K() % 9 + 1).cast("int"))
scalar("glob_policy", *PART, lambda: P.path_policy(tree(), exclude=("**/*.log",), ignore=("# c", "gen/", "!keep"), include_tests=False), "p_partkey % 9 IN (0, 5)")
REFS = ("url", "example.org/x", "./example.org", "a/[b]", "docs/a.md", "...", " - ")
scalar("pred_placeholder_link", *PART, lambda: P.is_placeholder_link(F.element_at(F.array(*map(F.lit, REFS)), (K() % 7 + 1).cast("int"))), "p_partkey % 7 NOT IN (2, 4)")
LOCAL = ("a/b.ts", "/etc/x", "https://x/y", "@s/p", "~/x", "a/*.ts", "a b/c", "./x", "plain")
scalar("pred_local_path_ref", *PART, lambda: P.is_local_path(F.element_at(F.array(*map(F.lit, LOCAL)), (K() % 9 + 1).cast("int"))), "p_partkey % 9 IN (0, 7)")
REFERRING, _ = line("see `src/a⟨p_size⟩.ts:3` and\n(docs/b.md) or services/c⟨p_size⟩.py\n`src/a⟨p_size⟩.ts:3` x/y.md")


@query("fn_path_like_refs", "SELECT p_partkey AS run_id, unnest(['src/a' || p_size || '.ts:3', 'services/c' || p_size || '.py']) AS ref, unnest([1, 2]) AS line FROM part")
def fn_path_like_refs(t):
    return P.path_references(made(t, REFERRING, "text"), "run_id")


REGISTRY, _ = line("| `a/⟨p_size⟩.md` | x |\nb.mdx and c.md")


@query("src_registry", "SELECT p_partkey AS run_id, unnest(CASE WHEN p_partkey % 2 = 0 THEN ['j' || p_size || '.md', 'k.md'] ELSE ['a/' || p_size || '.md', 'b.mdx', 'c.md'] END) AS path FROM part")
def src_registry(t):
    listed, _ = line('{"docs":["j⟨p_size⟩.md",{"source_path":"k.md"},{"x":1}]}')
    return P.registry_paths(made(t, F.when(K() % 2 == 0, listed()).otherwise(REGISTRY()), "raw"), "run_id")


@query("join_test_counterpart", "SELECT 'd' || p_partkey % 9 || '/M' || p_partkey || '.ts' AS path, unnest(['d' || p_partkey % 9 || '/m' || p_partkey || '.test.ts', 'd' || p_partkey % 9 || '/__tests__/m' || p_partkey || '.ts']) AS test FROM part WHERE p_partkey % 3 = 0")
def join_test_counterpart(t):
    name = lambda s: line(s)[0]().alias("path")
    p = t("part")
    tests = p.filter(K() % 3 == 0)
    files = p.select(name("d⟨p_partkey % 9⟩/M⟨p_partkey⟩.ts")).union(tests.select(name("d⟨p_partkey % 9⟩/m⟨p_partkey⟩.test.ts"))).union(tests.select(name("d⟨p_partkey % 9⟩/__tests__/m⟨p_partkey⟩.ts")))
    return P.test_counterparts(files)


scalar("fn_infer_globs", *PART, lambda: F.array_join(P.inferred_globs(F.array(line("d⟨p_size⟩/a/b.ts")[0](), F.lit("top.md"), line("d⟨p_size⟩/c.ts")[0](), line("e⟨p_partkey % 4⟩/x")[0]())), ","), "'d' || p_size || '/**,top.md,e' || p_partkey % 4 || '/**'")


@query("agg_top_extensions", "WITH f AS (SELECT CASE WHEN p_partkey % 12 = 0 THEN '[none]' ELSE '.x' || p_partkey % 12 END AS extension FROM part) SELECT extension, count(*) AS files FROM f GROUP BY 1 ORDER BY files DESC, extension LIMIT 8")
def agg_top_extensions(t):
    return P.top_extensions(t("part").select(F.when(K() % 12 == 0, "a/none").otherwise(line("a/b.X⟨p_partkey % 12⟩")[0]()).alias("path")))


# --- safety -------------------------------------------------------------------------------------

EXPORT, _ = line('{"ok":[{"query":"q⟨p_size⟩"},"see /Users/x"],"n":{"deep":"requests.jsonl ⟨p_size⟩"}}')


@query("agg_leak_scan", "SELECT p_partkey AS run_id, unnest(['ok.0.query', 'ok.1', 'n.deep']) AS path, unnest(['forbidden_key:query', 'forbidden_value:/Users/', 'forbidden_value:requests.jsonl']) AS reason FROM part")
def agg_leak_scan(t):
    return S.leak_scan(made(t, EXPORT, "raw"), "run_id")


SAMPLE, SAMPLE_SQL = line('{"n":⟨p_size⟩,"query":"x","a":{"file_path":"p","ok":[1,{"body":2,"k":⟨p_partkey⟩}],"long_text":"t"}}')
scalar("proj_cols_safe", *PART, lambda: S.safe_sample(SAMPLE()), "'{\"n\":' || p_size || ',\"a\":{\"ok\":[1,{\"k\":' || p_partkey || '}]}}'")
REFUSALS = ("host is not allowed", "boom", "SSRF guard", "invalid url", "timeout")
scalar("pred_caller_rejection", *PART, lambda: S.is_caller_rejection(F.element_at(F.array(*map(F.lit, REFUSALS)), (K() % 5 + 1).cast("int"))), "p_partkey % 5 IN (0, 2, 3)")


@query("pred_edit_allowed", "SELECT CASE p_partkey % 4 WHEN 0 THEN 'p' || p_partkey || '/src/m.py' WHEN 1 THEN 'p' || p_partkey || '/src/m.py' WHEN 2 THEN 'p' || p_partkey || '/src/a.md' ELSE 'q' || p_partkey || '/src/m.ts' END AS path, CASE p_partkey % 4 WHEN 0 THEN 'test found' WHEN 1 THEN 'no matching test' WHEN 2 THEN 'no code' ELSE 'no tests folder' END AS reason, p_partkey % 4 <> 1 AS allowed FROM part")
def pred_edit_allowed(t):
    k = K() % 4
    edits = t("part").select(F.when(k < 2, line("p⟨p_partkey⟩/src/m.py")[0]()).when(k == 2, line("p⟨p_partkey⟩/src/a.md")[0]()).otherwise(line("q⟨p_partkey⟩/src/m.ts")[0]()).alias("path"))
    files = t("part").filter(k < 2).select(F.when(k == 0, line("p⟨p_partkey⟩/tests/test_m.py")[0]()).otherwise(line("p⟨p_partkey⟩/tests/test_n.py")[0]()).alias("path"))
    return S.edit_checks(edits, files)


# --- regions ------------------------------------------------------------------------------------

BOX = {"w": "p_size * 6", "h": "p_size * 2 + p_partkey % 40", "red": "p_partkey % 30 / 100.0", "cover": "p_size / 2000.0"}
at = lambda k: F.expr(BOX[k]).cast("double")
B = "(SELECT p_partkey, (p_size * 6)::DOUBLE AS w, (p_size * 2 + p_partkey % 40)::DOUBLE AS h, (p_partkey % 30 / 100.0)::DOUBLE AS red, (p_size / 2000.0)::DOUBLE AS cover, p_partkey % 260 AS strength FROM part)"
TYPE = "CASE WHEN w >= 140 AND h >= 36 AND red >= 0.12 THEN 'comment_box' WHEN red <= 0.08 AND w * h >= 20000 THEN 'outline' WHEN greatest(w, h) <= 60 AND w / greatest(1, h) BETWEEN 0.65 AND 1.6 AND red >= 0.12 THEN 'marker_dot' WHEN w / greatest(1, h) >= 4 AND h <= 32 THEN 'underline' WHEN w / greatest(1, h) >= 1.8 AND greatest(w, h) <= 140 AND red <= 0.22 THEN 'arrow' ELSE 'unknown' END"
scalar("fn_region_type", *PART, lambda: V.region_type(at("w"), at("h"), at("red"))[0], TYPE, B)
one = lambda x: f"least(1.0, greatest(0.0, {x}))"
scalar("fn_region_priority", *PART, lambda: V.region_priority(V.region_type(at("w"), at("h"), at("red"))[0], at("w"), at("h"), at("cover"), at("red"), F.lit(0.5)), f"floor((CASE {TYPE} WHEN 'comment_box' THEN 0.95::DOUBLE WHEN 'outline' THEN 0.82 WHEN 'arrow' THEN 0.78 WHEN 'underline' THEN 0.72 WHEN 'marker_dot' THEN 0.66 ELSE 0.56 END * 0.45::DOUBLE + {one('sqrt(greatest(1, w * h) / 60000)')} * 0.2::DOUBLE + {one('cover * 28')} * 0.2::DOUBLE + {one('red * 3.5::DOUBLE')} * 0.05::DOUBLE + 0.5::DOUBLE * 0.1::DOUBLE) * 1000.0 + 0.5) / 1000.0", B)
scalar("fn_diff_impact", *PART, lambda: V.diff_impact(at("w"), at("h"), at("cover"), at("red") * 3, K() % 260), "CASE WHEN strength >= 180 AND red * 3 >= 0.55 THEN 'color_change' WHEN h <= 80 AND w / greatest(1, h) >= 2.8 THEN 'text_change' WHEN cover >= 0.015 OR w * h >= 120000 THEN 'layout_shift' WHEN strength >= 130 THEN 'asset_change' ELSE 'unknown' END", B)
scalar("raster_edge_filters", *PART, lambda: V.edge_artifact(K() % 900, K() % 700, K() % 60, F.col("p_size"), F.lit(960), F.lit(720)), "CASE WHEN (p_partkey % 60) * p_size <= 3200 AND greatest(p_partkey % 60, p_size) <= 88 THEN CASE WHEN p_partkey % 700 + p_size >= 624 THEN 'dock' WHEN p_partkey % 700 <= 72 AND (p_partkey % 900 <= 52 OR p_partkey % 900 + p_partkey % 60 >= 908) THEN 'chrome' WHEN p_partkey % 900 + p_partkey % 60 >= 932 AND p_size >= 48 AND p_partkey % 60 <= 18 AND p_partkey % 700 > 72 THEN 'scrollbar' END END")
scalar("fn_ocr_hint_ok", *PART, lambda: V.ocr_hint_ok(F.substring("p_name", 1, F.col("p_size") % 5), F.col("p_size") / 50), "length(substr(p_name, 1, p_size % 5)) >= 3 AND p_size / 50 >= 0.45")
scalar("fn_task_intent", *PART, lambda: F.concat_ws(",", *(V.profile_of(F.element_at(F.array(*map(F.lit, ("copy_review ", "bug_report", "none"))), (K() % 3 + 1).cast("int")), V.TASK_INTENTS)[f"v{i}"].cast("string") for i in range(3))), "['anthropic_full,3,4', 'anthropic_fast,2,3', 'anthropic_fast,2,3'][p_partkey % 3 + 1]")
scalar("fn_diff_profile", *PART, lambda: F.array_join(V.profile_of(F.element_at(F.array(*map(F.lit, ("mobile_diff", "x"))), (K() % 2 + 1).cast("int")), V.DIFF_PROFILES)["v0"], ","), "['top_browser_chrome,bottom_dock', ''][p_partkey % 2 + 1]")


@query("fn_expand_presets", "SELECT p_partkey AS image, 'left_sidebar' AS preset, 0 AS x0, 0 AS y0, round((0.0::DOUBLE + 0.2::DOUBLE) * p_size * 10)::INT AS x1, p_size::INT AS y1 FROM part UNION ALL SELECT p_partkey, 'right_sidebar', round(0.8::DOUBLE * p_size * 10)::INT, 0, round((0.8::DOUBLE + 0.2::DOUBLE) * p_size * 10)::INT, p_size::INT FROM part WHERE p_partkey % 2 = 0")
def fn_expand_presets(t):
    names = F.when(K() % 2 == 0, F.array(F.lit("left_sidebar"), F.lit(" right_sidebar"), F.lit("left_sidebar"))).otherwise(F.array(F.lit("left_sidebar"), F.lit("none")))
    return V.expand_presets(t("part").select(K().alias("image"), (F.col("p_size") * 10).alias("width"), F.col("p_size").alias("height"), names.alias("presets")))


@query("raster_red_mask", "WITH p AS (SELECT p_partkey, p_partkey * 7 % 256 AS r, p_partkey * 13 % 256 AS g, p_partkey * 29 % 200 AS b FROM part) SELECT p_partkey AS x, r AS y FROM p WHERE r >= 150 AND r > g + 45 AND r > b + 45 AND r > g * 1.2 AND r > b * 1.2")
def raster_red_mask(t):
    k = K()
    pixels = t("part").select(F.lit(1).alias("image"), k.alias("x"), (k * 7 % 256).alias("y"), (k * 7 % 256).alias("r"), (k * 13 % 256).alias("g"), (k * 29 % 200).alias("b"))
    return V.red_mask(pixels).select("x", "y")


@query("raster_merge_boxes")  # united boxes reach further than their parts: no SQL, a golden case in the tests
def raster_merge_boxes(t):
    k = K()
    x, y = (k * 37 % 2000).cast("long"), (k * 53 % 1500).cast("long")
    boxes = t("part").select((F.floor(k / 40)).alias("image"), x.alias("x0"), y.alias("y0"), (x + F.col("p_size")).alias("x1"), (y + F.col("p_size")).alias("y1"), F.col("p_size").alias("pixels"))
    return V.merge_boxes(boxes)


@query("agg_artifact_profiles", "WITH r AS (SELECT p_brand AS image, p_size AS tokens, p_size % 3 = 0 AS d, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS a, row_number() OVER (PARTITION BY p_brand, p_size % 3 = 0 ORDER BY p_retailprice DESC, p_partkey) AS o, max((p_size % 3 = 0)::INT) OVER (PARTITION BY p_brand) AS s FROM part), k AS (SELECT *, CASE WHEN s = 1 THEN CASE WHEN d THEN o END ELSE a END AS k FROM r) SELECT image, 'fast' AS profile, count(*) FILTER (k <= 2) AS regions, CAST(coalesce(sum(tokens) FILTER (k <= 2), 0) AS BIGINT) AS tokens FROM k GROUP BY 1 UNION ALL SELECT image, 'full', count(*), CAST(sum(tokens) AS BIGINT) FROM k GROUP BY 1")
def agg_artifact_profiles(t):
    regions = t("part").select(F.col("p_brand").alias("image"), K().alias("region_id"), F.col("p_retailprice").alias("priority"), F.lit(0).alias("review_order"), (F.col("p_size") % 3 == 0).alias("by_default"), F.col("p_size").alias("tokens"))
    return V.artifact_profiles(regions, {"fast": 2, "full": None})


# --- modules ------------------------------------------------------------------------------------

MODULE, _ = line("import os\n# note\ndef run⟨p_partkey⟩(a, b, c, d, e⟨p_size⟩):\n    if a and b:\n        return c\n    return d\n\ndef _own(self):\n    for x in self:\n        pass\n")
module = lambda t: made(t, MODULE, "text").withColumn("path", F.concat(F.lit("m"), F.col("run_id").cast("string"), F.lit(".py")))


@query("agg_module_depth", "SELECT 'm' || p_partkey || '.py' AS path, 4.5::DOUBLE AS interface, 15::BIGINT AS complexity, round(15 / 4.5, 2)::DOUBLE AS ratio, 'balanced' AS band, 1::BIGINT AS public_symbols, 5::BIGINT AS loc, 'many_params:run' || p_partkey || ':5' AS factors FROM part")
def agg_module_depth(t):
    return M.module_depth(module(t)).withColumn("factors", F.array_join("factors", ","))


@query("win_function_body", "SELECT 'm' || p_partkey || '.py' AS path, unnest(['run' || p_partkey, '_own']) AS function, unnest([3, 8]) AS line, unnest([3, 2]) AS body_lines FROM part")
def win_function_body(t):
    return M.function_bodies(module(t))


@query("agg_depth_compare", "WITH s AS (SELECT p_brand AS path, avg(p_size) FILTER (p_partkey % 2 = 0) AS b, avg(p_size) FILTER (p_partkey % 2 = 1) AS a FROM part GROUP BY 1), d AS (SELECT *, round(a - b, 2) AS delta FROM s) SELECT path, delta, CASE WHEN delta > 0.5 THEN 'deeper' WHEN delta < -0.5 THEN 'shallower' ELSE 'flat' END AS direction, 'x' AS band_before, 'x' AS band_after FROM d WHERE delta IS NOT NULL")
def agg_depth_compare(t):
    half = lambda r: t("part").filter(K() % 2 == r).groupBy(F.col("p_brand").alias("path")).agg(F.avg("p_size").alias("ratio")).withColumn("band", F.lit("x"))
    return M.depth_compare(half(0), half(1))


# --- retrieval, feedback, dependencies ----------------------------------------------------------


@query("fn_symbol_score", "SELECT 'f' || p_partkey AS path, CAST(CASE WHEN contains(lower(p_name), 'a') THEN CASE WHEN p_size % 2 = 0 THEN 18 ELSE 14 END WHEN contains(lower(p_brand), 'a') THEN 4 ELSE 0 END + CASE WHEN contains(lower(p_name), 'e') THEN CASE WHEN p_size % 2 = 0 THEN 18 ELSE 14 END WHEN contains(lower(p_brand), 'e') THEN 4 ELSE 0 END + 3 AS BIGINT) AS score FROM part")
def fn_symbol_score(t):
    path = F.concat(F.lit("f"), K().cast("string")).alias("path")
    symbols = t("part").select(path, F.col("p_name").alias("name"), F.when(F.col("p_size") % 2 == 0, "route").otherwise("function").alias("kind"), F.col("p_brand").alias("signature"))
    return R.symbol_score(symbols, t("part").select(path, F.lit("./Eel").alias("target")).filter("true"), ["a", "E"])


scalar("fn_domain_expansion", *PART, lambda: F.array_join(R.domain_expansion(F.array(F.when(K() % 3 == 0, "MCP").when(K() % 3 == 1, "route").otherwise("x"), F.lit("context"), F.lit("prep"))), ","), "CASE p_partkey % 3 WHEN 0 THEN 'tools/list,CallToolRequestSchema,' WHEN 1 THEN '/api/,route,endpoint,' ELSE '' END || 'prep_logs,prep_url,prep_text'")


@query("sort_stable_tier", "SELECT p_partkey, row_number() OVER (ORDER BY p_size % 4, p_retailprice DESC, p_partkey) AS place FROM part")
def sort_stable_tier(t):
    from pyspark.sql import Window

    before = t("part").select("p_partkey", (F.col("p_size") % 4).alias("tier"), F.row_number().over(Window.orderBy(F.desc("p_retailprice"), "p_partkey")).alias("rank"))
    return R.by_tier(before, "tier", "rank").select("p_partkey", "place")


def feedback(t):
    i = F.col("event_id")
    none = F.array().cast("array<string>")
    return t("events").select(
        i.alias("feedback_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.when(F.col("event_type") == "view", "helpful").when(F.col("event_type") == "error", "wrong_context").when(F.col("event_type") == "click", "partial").otherwise("odd").alias("outcome"),
        F.when(i % 3 == 0, F.array(F.lit("a"))).otherwise(none).alias("expected_paths"), none.alias("missing_paths"), F.when(i % 4 == 0, "better").otherwise(" ").alias("corrected_query"), (i % 5 == 0).alias("frontier_had_to_search"),
    )


OUTCOME = "CASE event_type WHEN 'view' THEN 'helpful' WHEN 'error' THEN 'wrong_context' WHEN 'click' THEN 'partial' ELSE 'odd' END"


@query("record_feedback", f"WITH f AS (SELECT event_id, {OUTCOME} AS o FROM events) SELECT event_id AS feedback_id, o <> 'helpful' OR event_id % 5 = 0 AS benchmark_candidate, greatest(1, (o <> 'helpful')::INT + (event_id % 3 = 0)::INT + (event_id % 4 = 0)::INT + (event_id % 5 = 0)::INT + (o = 'wrong_context')::INT) AS steps FROM f WHERE o <> 'odd'")
def record_feedback(t):
    return C.record_feedback(feedback(t)).select("feedback_id", "benchmark_candidate", F.size("upgrade_plan").alias("steps"))


@query("import_feedback", f"WITH f AS (SELECT event_id, ts, {OUTCOME} AS o FROM events) SELECT event_id AS feedback_id, 'retrieval-feedback,' || o AS tags FROM f WHERE o IN ('wrong_context', 'partial') AND CAST(ts AS DATE) = DATE '2024-01-03'")
def import_feedback(t):
    return C.import_feedback(C.record_feedback(feedback(t)), "2024-01-03").select("feedback_id", F.array_join("tags", ",").alias("tags"))


@query("join_feedback_traffic", "WITH c AS (SELECT user_id, max_by(event_type, (ts, event_id)) AS traffic FROM events GROUP BY 1) SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN 'own' END, traffic) AS traffic FROM events JOIN c USING (user_id)")
def join_feedback_traffic(t):
    e = t("events")
    own = e.select("event_id", F.col("user_id").alias("call_id"), F.when(F.col("event_id") % 2 == 0, "own").otherwise("unknown").alias("own"))
    calls = e.select(F.col("user_id").alias("call_id"), F.struct("ts", "event_id").alias("at"), F.col("event_type").alias("traffic"))
    return C.inherit_traffic(own, calls).select("event_id", "traffic")


@query("join_helpful_semi", "SELECT event_id, event_id IN (SELECT event_id FROM events WHERE event_type = 'purchase') AS helpful FROM events WHERE value > 50")
def join_helpful_semi(t):
    said = t("events").select("event_id", F.when(F.col("event_type") == "purchase", "helpful").otherwise("miss").alias("outcome"))
    return C.helpful_split(t("events").filter("value > 50").select("event_id"), said, "event_id")


@query("join_query_override", "SELECT doc_id, coalesce(CASE WHEN quality = 0 THEN 'low' END, source, '') AS query FROM documents LEFT JOIN labels USING (doc_id)")
def join_query_override(t):
    return C.query_of(t("documents").select("doc_id", "source"), t("labels").filter("quality = 0").select("doc_id", F.lit("low").alias("query")), "doc_id", "source")


@query("join_cross_pairwise", "WITH g AS (SELECT event_type AS g, avg(value) AS m FROM events GROUP BY 1) SELECT a.g AS a, b.g AS b, a.m - b.m AS gap FROM g a JOIN g b ON a.g < b.g")
def join_cross_pairwise(t):
    return C.pairwise_gaps(t("events").groupBy("event_type").agg(F.avg("value").alias("m")), "event_type", "m")


scalar("fn_command_policy", *PART, lambda: C.command_source(F.when(K() % 4 == 0, "x").otherwise(" "), F.when(K() % 4 < 2, "y"), F.when(K() % 4 < 3, "z")), "['explicit', 'file', 'builtin', 'unavailable'][p_partkey % 4 + 1]")


@query("join_peer_evidence", "SELECT 'd' || p_partkey AS name FROM part WHERE p_partkey % 6 = 0")
def join_peer_evidence(t):
    name = lambda s: F.concat(F.lit(s), K().cast("string"))
    p = t("part")
    return C.peer_evidence(p.select(name("d").alias("name")), p.filter(K() % 2 == 0).select(name("v").alias("package"), name("d").alias("name")), p.filter(K() % 3 == 0).select(name("v").alias("package")))


@query("agg_coverage", "WITH e AS (SELECT 's' || user_id % 7 AS service, CASE WHEN event_type = 'view' AND user_id % 7 < 4 THEN 'production_like' WHEN event_type = 'click' THEN 'proof' ELSE 'other' END AS traffic, event_type = 'error' AND user_id % 7 IN (1, 5) AS bad FROM events), s AS (SELECT service, count(*) AS requests, count(*) FILTER (traffic = 'production_like') AS production_like, count(*) FILTER (bad) AS errors FROM e GROUP BY 1) SELECT *, CASE WHEN service IN ('s0', 's1') THEN 'core' ELSE 'extended' END AS profile, CASE WHEN errors > 0 AND (service = 's2' OR production_like = 0) THEN 'force_kept_recent_error' WHEN service = 's2' THEN 'traffic_class_excluded' WHEN production_like > 0 THEN 'active' ELSE 'visible_idle' END AS status, (errors > 0 AND (service = 's2' OR production_like = 0)) OR (service <> 's2' AND production_like > 0) AS in_denominator FROM s")
def agg_coverage(t):
    n, kind = F.col("user_id") % 7, F.col("event_type")
    traffic = F.when((kind == "view") & (n < 4), "production_like").when(kind == "click", "proof").otherwise("other")
    rows = t("events").select(F.concat(F.lit("s"), n.cast("string")).alias("service"), traffic.alias("traffic"), (kind != "error").alias("ok"), F.when(n.isin(1, 5), "boom").otherwise("host is not allowed").alias("error"))
    return C.coverage(rows, ("s2",), ("s0", "s1"))


FIX, _ = line('{"added":3,"removed":1,"audit":{"vulnerabilities":{"p⟨p_size⟩":{"severity":"high","isDirect":true,"via":[1,2],"effects":[],"range":"<⟨p_size⟩","fixAvailable":{"name":"q","version":"2.0.⟨p_size⟩","isSemVerMajor":true}},"z":{"fixAvailable":false}}}}')


@query("src_npm_fix_plan", "SELECT p_partkey AS run_id, unnest(['p' || p_size, 'z']) AS package, unnest(['high', 'unknown']) AS severity, unnest([TRUE, FALSE]) AS direct, unnest([2, 0]) AS via, unnest([TRUE, FALSE]) AS fix_available, unnest(['2.0.' || p_size, NULL]) AS fix_version, unnest([TRUE, FALSE]) AS fix_major, 2 AS net FROM part")
def src_npm_fix_plan(t):
    return IN.npm_fix_plan(made(t, FIX, "raw"), "run_id").select("run_id", "package", "severity", "direct", "via", "fix_available", "fix_version", "fix_major", "net")


MIRROR, _ = line('{"pages":[{"source_path":"d/⟨p_partkey⟩.md","title":"⟨p_name⟩","notion_page_id":"i⟨p_size⟩"},{"x":1}]}')


@query("src_mirror_manifest", "SELECT 'd/' || p_partkey || '.md' AS source_path, substr(p_name, 1, 120) AS title, substr(sha256('i' || p_size), 1, 16) AS page_id_hash, NULL::VARCHAR AS source_hash FROM part")
def src_mirror_manifest(t):
    return IN.mirror_manifest(made(t, MIRROR, "raw"), "raw").select("source_path", "title", "page_id_hash", "source_hash")


BENCH, _ = line('{"compressor":"c","per_sample":[{"sample_id":"f⟨p_size⟩#r⟨p_partkey % 2⟩","ratio":0.⟨p_partkey % 10⟩},{"sample_id":"odd","ratio":1}]}')


@query("src_c2_json", "SELECT p_partkey AS run_id, 'f' || p_size AS fixture, p_partkey % 2 AS run, 1 - (p_partkey % 10) / 10.0::DOUBLE AS b FROM part")
def src_c2_json(t):
    return IN.benchmark_runs(made(t, BENCH, "raw"), "run_id").select("run_id", "fixture", F.col("run").cast("long").alias("run"), "b")


scalar("fn_trace_source", *PART, lambda: C.trace_source(F.when(K() % 4 == 0, " cli "), F.when(K() % 4 == 1, "a Smoke test"), F.lit(None).cast("string")), "['cli', 'proof_loop', 'unknown', 'unknown'][p_partkey % 4 + 1]")
