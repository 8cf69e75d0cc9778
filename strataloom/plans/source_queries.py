"""Readers and small scalar operators on lines made from the tables of a folder."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataloom.functions import predicates as P
from strataloom.functions import text as T
from strataloom.operators import logs as L
from strataloom.operators import route as O
from strataloom.sources import readers as IN
from strataloom.sources import writers as OUT

from .registry import query

S = lambda c: F.col(c).cast("string")


@query("src_git_log", "SELECT CAST(o_orderkey AS VARCHAR) AS hash, substr(CAST(o_orderkey AS VARCHAR), 1, 3) AS short_hash, epoch(o_orderdate)::BIGINT AS at_s, o_orderpriority || chr(9) || o_orderstatus AS subject FROM orders")
def src_git_log(t):
    at = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    lines = t("orders").select(F.concat_ws("\t", S("o_orderkey"), F.substring(S("o_orderkey"), 1, 3), at, "o_orderpriority", "o_orderstatus").alias("line"))
    return IN.git_log(lines).select("hash", "short_hash", F.unix_timestamp("at").alias("at_s"), "subject")


@query("src_git_namestatus", "SELECT l_orderkey AS hash, CASE l_linenumber % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'M' ELSE 'A' END AS status, 'f' || CASE WHEN l_linenumber % 3 = 0 THEN l_suppkey ELSE l_partkey END AS path, CASE WHEN l_linenumber % 3 = 0 THEN 'f' || l_partkey END AS old_path FROM lineitem")
def src_git_namestatus(t):
    n = F.col("l_linenumber") % 3
    line = F.when(n == 0, F.concat(F.lit("R90\tf"), S("l_partkey"), F.lit("\tf"), S("l_suppkey"))).when(n == 1, F.concat(F.lit("M\tf"), S("l_partkey"))).otherwise(F.concat(F.lit("A\tf"), S("l_partkey")))
    return IN.git_name_status(t("lineitem").select(F.col("l_orderkey").alias("hash"), line.alias("line")))


@query("src_git_blame", "WITH b AS (SELECT l_partkey AS file, l_orderkey AS k, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS line FROM lineitem) SELECT file, CAST(line AS INT) AS line, lpad(CAST(k AS VARCHAR), 40, '0') AS hash, 'author ' || k % 9 AS author FROM b")
def src_git_blame(t):
    w = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey")
    rows = t("lineitem").select(F.col("l_partkey").alias("file"), F.col("l_orderkey").alias("k"), F.row_number().over(w).alias("r"))
    head = F.concat_ws(" ", F.lpad(S("k"), 40, "0"), S("r"), S("r"), F.lit("1"))
    lines = rows.select("file", "r", F.posexplode(F.array(head, F.concat(F.lit("author author "), (F.col("k") % 9).cast("string")), F.lit("\tcode"))).alias("i", "line"))
    return IN.git_blame(lines.select("file", (F.col("r") * 3 + F.col("i")).alias("n"), "line"))


K = lambda: F.col("p_partkey")


def report(t, raw):
    return t("part").select(K().alias("report_id"), raw.alias("raw"))


@query("src_sarif", "SELECT p_partkey AS report_id, 'scan' AS source, 'f' || p_partkey || '.ts' AS file, CAST(p_partkey % 90 AS INT) AS line, NULL::INT AS \"column\", p_name AS message, 'r' || p_partkey % 4 AS rule_id, CASE WHEN p_partkey % 2 = 0 THEN 'error' ELSE 'warning' END AS severity FROM part")
def src_sarif(t):
    raw = F.concat(F.lit('{"runs":[{"tool":{"driver":{"name":"scan"}},"results":[{"ruleId":"r'), (K() % 4).cast("string"), F.lit('",'), F.when(K() % 2 == 0, '"level":"error",').otherwise(""), F.lit('"message":{"text":"'), F.col("p_name"), F.lit('"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"f'), S("p_partkey"), F.lit('.ts"},"region":{"startLine":'), (K() % 90).cast("string"), F.lit("}}}]}]}]}"))
    return IN.sarif(report(t, raw))



@query("src_npm_audit", "SELECT p_partkey AS report_id, 'pkg' || p_partkey % 30 AS package, ['low', 'high', 'critical'][p_partkey % 3 + 1] AS severity, p_partkey % 2 = 0 AS is_direct, '<' || p_size AS range FROM part")
def src_npm_audit(t):
    raw = F.concat(F.lit('{"vulnerabilities":{"pkg'), (K() % 30).cast("string"), F.lit('":{"severity":"'), F.element_at(F.array(*map(F.lit, ("low", "high", "critical"))), (K() % 3 + 1).cast("int")), F.lit('","isDirect":'), (K() % 2 == 0).cast("string"), F.lit(',"range":"<'), S("p_size"), F.lit('"}}}'))
    return IN.npm_audit(report(t, raw))


@query("src_osv", "SELECT p_partkey AS report_id, 'p' || p_partkey % 9 AS name, '1.' || p_size AS version, unnest(['A-' || p_partkey, 'B-' || p_partkey]) AS vuln_id FROM part")
def src_osv(t):
    raw = F.concat(F.lit('{"results":[{"packages":[{"package":{"name":"p'), (K() % 9).cast("string"), F.lit('","version":"1.'), S("p_size"), F.lit('"},"vulnerabilities":[{"id":"A-'), S("p_partkey"), F.lit('"},{"id":"B-'), S("p_partkey"), F.lit('"}]}]}]}'))
    return IN.osv(report(t, raw)).drop("aliases")


@query("src_json_prelude", "SELECT p_partkey AS report_id, CASE WHEN p_partkey % 5 <> 0 THEN '[' || p_partkey || ']' END AS body FROM part")
def src_json_prelude(t):
    raw = F.concat(F.lit("npm warn old\n"), F.when(K() % 5 == 0, "").otherwise(F.concat(F.lit("["), S("p_partkey"), F.lit("]"))))
    return report(t, raw).select("report_id", IN.json_prelude(F.col("raw")).alias("body"))


@query("src_console_text", "SELECT event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'warning' ELSE 'info' END AS type FROM events WHERE event_type <> 'click'")
def src_console_text(t):
    word = F.when(F.col("event_type") == "error", "[ERROR] boom").when(F.col("event_type") == "view", "warn: slow").when(F.col("event_type") == "click", "quiet").otherwise("Info ok")
    return IN.console_lines(t("events").select("event_id", word.alias("line"))).select("event_id", "type")


@query("src_network_text", "SELECT event_id, ['GET', 'POST'][event_id % 2 + 1] AS method, '/u/' || user_id AS url, CAST(200 + event_id % 4 * 100 AS INT) AS status FROM events WHERE event_id % 10 <> 0")
def src_network_text(t):
    i = F.col("event_id")
    line = F.when(i % 10 == 0, "no call").otherwise(F.concat(F.when(i % 2 == 0, "GET").otherwise("POST"), F.lit(" /u/"), S("user_id"), F.lit(" "), (200 + i % 4 * 100).cast("string"), F.lit(" ok")))
    return IN.network_lines(t("events").select("event_id", line.alias("line"))).select("event_id", "method", "url", "status")


@query("src_ocr_tsv", "SELECT p_brand AS image, count(*) AS words, avg(p_size) / 100 AS confidence FROM part GROUP BY 1")
def src_ocr_tsv(t):
    line = F.concat_ws("\t", *(F.lit("0") for _ in range(10)), F.col("p_size").cast("double").cast("string"), F.lit("word"))
    lines = t("part").select(F.col("p_brand").alias("image"), K().alias("n"), line.alias("line"))
    return IN.ocr_table(lines).select("image", F.size(F.split("text", " ")).cast("long").alias("words"), "confidence")






@query("fn_red_class", "SELECT event_id, CASE event_type WHEN 'error' THEN 'import' WHEN 'view' THEN 'syntax' WHEN 'click' THEN 'assertion' ELSE 'other' END AS kind FROM events")
def fn_red_class(t):
    e = F.col("event_type")
    text = F.when(e == "error", "ModuleNotFoundError: No module named 'x'").when(e == "view", "SyntaxError: expected").when(e == "click", "AssertionError: expected 1").otherwise("exit 3")
    return t("events").select("event_id", O.first_rule(text, O.RED, "other").alias("kind"))


@query("fn_days_ago", "SELECT o_orderkey, greatest(0, CAST(floor((epoch(TIMESTAMP '1998-01-01') - epoch(o_orderdate)) / 86400) AS BIGINT)) AS days FROM orders")
def fn_days_ago(t):
    return t("orders").select("o_orderkey", T.days_ago(F.col("o_orderdate").cast("timestamp"), F.lit("1998-01-01").cast("timestamp")).alias("days"))


@query("fn_date_range", "SELECT n_nationkey, CAST(g.d AS DATE) AS day FROM nation, generate_series(DATE '2024-01-05' - CAST(n_nationkey % 4 AS INT), DATE '2024-01-05', INTERVAL 1 DAY) g(d)")
def fn_date_range(t):
    last = F.lit("2024-01-05").cast("date")
    return t("nation").select("n_nationkey", F.explode(F.sequence(F.date_sub(last, (F.col("n_nationkey") % 4).cast("int")), last)).alias("day"))


@query("fn_estimate_image_tokens", "SELECT p_partkey, CAST(ceil(p_size * 40 * p_size * 30 / 750.0) AS BIGINT) AS by_area, CAST(85 + 170 * ceil(p_size * 40 / 512.0) * ceil(p_size * 30 / 512.0) AS BIGINT) AS by_tiles FROM part")
def fn_estimate_image_tokens(t):
    area, tiles = T.estimate_image_tokens(F.col("p_size") * 40, F.col("p_size") * 30)
    return t("part").select("p_partkey", area.alias("by_area"), tiles.alias("by_tiles"))


@query("pred_network_failure", "SELECT event_id, event_id % 3 = 0 OR (event_id % 3 = 1 AND event_type = 'error') AS failed FROM events")
def pred_network_failure(t):
    i = F.col("event_id")
    code = F.when(i % 3 == 0, 404).when(i % 3 == 2, 200).otherwise(0)
    return t("events").select("event_id", P.is_network_failure(code, F.when(F.col("event_type") == "error", "net::ERR_FAILED").otherwise("OK")).alias("failed"))


@query("agg_token_event", "SELECT event_id % 4 AS g, CAST(sum(CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id END) AS DOUBLE) AS total FROM events GROUP BY 1")
def agg_token_event(t):
    i = F.col("event_id")
    x = F.when(i % 6 == 0, F.lit(float("nan"))).when(i % 3 == 0, F.lit(None).cast("double")).otherwise(i.cast("double"))
    return t("events").groupBy((i % 4).alias("g")).agg(F.sum(L.finite(x)).alias("total"))


@query("sink_artifact", "SELECT 'doc-' || substr(sha256(text), 1, 20) AS artifact, count(*) AS documents FROM documents GROUP BY 1")
def sink_artifact(t):
    return t("documents").groupBy(T.artifact_key("doc", F.col("text")).alias("artifact")).agg(F.count("*").alias("documents"))


@query("sink_mark_pass", "SELECT 'f' || p_partkey AS feature_id, p_partkey % 5 = 0 OR p_partkey % 3 = 0 AS passed, CASE WHEN p_partkey % 5 = 0 THEN 'old' WHEN p_partkey % 3 = 0 THEN 'proof' END AS evidence FROM part")
def sink_mark_pass(t):
    name = F.concat(F.lit("f"), S("p_partkey")).alias("feature_id")
    old = t("part").filter("p_partkey % 5 = 0").select(name, F.lit(True).alias("passed"), F.lit("old").alias("evidence"))
    ledger = OUT.init_ledger(t("part").select(name), old)
    marks = t("part").select(name, F.when(K() % 3 == 0, "proof").otherwise("").alias("evidence"))
    return OUT.mark_passed(ledger, marks)


@query("sink_markdown", "WITH r AS (SELECT l_returnflag AS g, l_shipmode_x AS x, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey) AS r FROM (SELECT *, 'part ' || l_partkey AS l_shipmode_x FROM lineitem)) SELECT g, string_agg('- ' || x, chr(10) ORDER BY r) AS markdown FROM r WHERE r <= 20 GROUP BY g")
def sink_markdown(t):
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey")
    rows = t("lineitem").select(F.col("l_returnflag").alias("g"), key.alias("o"), F.concat(F.lit("part "), S("l_partkey")).alias("text"))
    return OUT.markdown_list(rows, "g", "o", "text")
