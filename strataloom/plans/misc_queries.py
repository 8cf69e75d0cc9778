"""Retrieval, routing, paths, addresses and reports on the tables of a folder."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataloom.functions import predicates as P
from strataloom.functions import text as T
from strataloom.operators import retrieve as R
from strataloom.operators import route as O
from strataloom.operators import text_index as X
from strataloom.session import scratch
from strataloom.sources import readers as IN

from .registry import query
from .text_queries import has

QUERY = "tion thereError the-handler"
TERMS = R.query_terms(QUERY)
PLANS = R.plans(TERMS)


def files(t):
    """documents as files: a path from the source, with tests, docs and a secret one among them."""
    i = F.col("doc_id")
    name = F.when(i % 97 == 0, "secret.md").when(i % 7 == 0, "handler.test.ts").when(i % 5 == 0, "the.py").otherwise("note.md")
    return t("documents").select(F.concat("source", F.lit("/"), i.cast("string"), F.lit("-"), name).alias("path"), "text", "doc_id")


FILES = "f AS (SELECT source || '/' || doc_id || '-' || CASE WHEN doc_id % 97 = 0 THEN 'secret.md' WHEN doc_id % 7 = 0 THEN 'handler.test.ts' WHEN doc_id % 5 = 0 THEN 'the.py' ELSE 'note.md' END AS path, text, doc_id FROM documents)"
BASE = "regexp_extract(lower(path), '([^/]*)$', 1)"
PATH = " + ".join([*(f"CASE WHEN contains({BASE}, '{x.lower()}') THEN 12 WHEN contains(lower(path), '{x.lower()}') THEN 6 ELSE 0 END" for x in TERMS), "CASE WHEN regexp_matches(path, '\\.(ts|py)$') THEN 2 ELSE 0 END", "CASE WHEN contains(path, '.test.ts') THEN -1 ELSE 0 END"])


def any_sql(own: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(x), '{o.lower()}')" for o in own) + ")" if own else "FALSE"


CONTENT = f"""l AS (SELECT path, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM f),
h AS ({" UNION ALL ".join(f"SELECT path, '{n}' AS plan, {b} AS boost, i, row_number() OVER (PARTITION BY path ORDER BY i) AS r FROM l WHERE {any_sql(own)}" for n, b, own in PLANS)}),
c AS (SELECT path, least(80, 10 * count(DISTINCT i)) AS lines_score, list_sort(list(DISTINCT i)) AS lines FROM h WHERE r <= 12 GROUP BY path), b AS (SELECT path, least(24, sum(boost)) AS boost FROM (SELECT DISTINCT path, plan, boost FROM h) GROUP BY path),
hint AS (SELECT path, least(120, 90 + CASE WHEN doc_id % 40 = 3 THEN 60 ELSE 0 END) AS hint FROM f WHERE doc_id % 20 = 3), ch AS (SELECT path FROM f WHERE doc_id % 9 = 1),
s AS (SELECT f.path, {PATH.replace('path', 'f.path').replace('contains(f.path', 'contains(f.path')} AS path_score, coalesce(lines_score + boost, 0)::BIGINT AS content_score, coalesce(hint, 0)::BIGINT AS hint_score, CASE WHEN ch.path IS NULL THEN 0 ELSE 8 END AS changed_score, coalesce(lines, []) AS lines, length(text) AS chars
 FROM f LEFT JOIN c USING (path) LEFT JOIN b USING (path) LEFT JOIN hint USING (path) LEFT JOIN ch ON ch.path = f.path WHERE NOT contains(f.path, 'secret')),
k AS (SELECT * EXCLUDE (chars), path_score + content_score + hint_score + changed_score - CASE WHEN chars > 120000 THEN 20 WHEN chars > 40000 THEN 6 ELSE 0 END AS score FROM s ORDER BY score DESC, path LIMIT 12)"""


def hinted(f):
    """(hints, changed files)."""
    i = F.col("doc_id")
    hints = f.filter(i % 20 == 3).select("path", F.lit("explicit").alias("kind")).unionByName(f.filter(i % 40 == 3).select("path", F.lit("symbol").alias("kind")))
    return hints, f.filter(i % 9 == 1)


def ranked(t):
    f = files(t)
    return R.rank_files(f, QUERY, *hinted(f))


def searched(t, top: int):
    """The ranks by a written index, which is made here of the whole table."""
    f = files(t)
    folder = scratch(f.sparkSession)
    X.write_index(f, folder)
    out = X.search(f.sparkSession, folder, QUERY, *hinted(f), top=top)
    return out.withColumn("lines", F.array_join(F.transform("lines", lambda x: x.cast("string")), ","))


RANKED_SQL = f"WITH {FILES}, {CONTENT} SELECT path, path_score, content_score, hint_score, changed_score, array_to_string(lines, ',') AS lines, score FROM k"
query("retrieve_indexed", RANKED_SQL)(lambda t: searched(t, 12))
query("find_files", RANKED_SQL.replace("LIMIT 12", "LIMIT 30"))(lambda t: searched(t, 30))


@query("retrieve_context", RANKED_SQL)
def retrieve_context(t):
    """By a scan of the texts: for one query it costs less than making an index."""
    return ranked(t).withColumn("lines", F.array_join(F.transform("lines", lambda x: x.cast("string")), ","))


@query("sink_index", f"WITH {FILES}, l AS (SELECT path, unnest(string_split_regex(lower(text), '\r?\n')) AS x, generate_subscripts(string_split_regex(lower(text), '\r?\n'), 1) AS line FROM f), w AS (SELECT path, line, unnest(regexp_extract_all(x, '[^ \t\n\x0b\f\r]+')) AS token FROM l), p AS (SELECT token, path, count(*) AS n, count(DISTINCT line) AS lines FROM w GROUP BY 1, 2) SELECT token, count(*) AS files, max(lines)::INT AS most_lines, sum(n)::BIGINT AS occurrences FROM p GROUP BY 1")
def sink_index(t):
    f = files(t)
    folder = scratch(f.sparkSession)
    X.write_index(f, folder)
    return f.sparkSession.read.parquet(f"{folder}/blocks").groupBy("token").agg(F.sum("files").alias("files"), F.max("most_lines").alias("most_lines"), F.sum("occurrences").alias("occurrences"))


@query("fn_confidence", f"""WITH {FILES}, {CONTENT}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, path) AS r, lead(score, 1, 0) OVER (ORDER BY score DESC, path) AS second FROM k),
a AS (SELECT count(*) AS files, max(score) FILTER (r = 1) AS top, max(score - second) FILTER (r = 1) AS gap, count(*) FILTER (len(lines) > 0) AS snippets FROM r)
SELECT *, CASE WHEN snippets = 0 THEN 0.42 ELSE greatest(0.01, least(0.5, floor((0.05 + CASE WHEN top >= 60 THEN -0.04 WHEN top < 25 THEN 0.13 ELSE 0.0 END + CASE WHEN gap < 8 AND files > 3 THEN 0.06 ELSE 0.0 END + CASE WHEN snippets < 3 THEN 0.06 ELSE 0.0 END)::DOUBLE * 100.0 + 0.5) / 100.0)) END AS uncertainty FROM a""")
def fn_confidence(t):
    return R.confidence(ranked(t))


@query("fn_path_score", f"WITH {FILES} SELECT path, {PATH} AS score FROM f")
def fn_path_score(t):
    return files(t).select("path", R.path_score(F.col("path"), TERMS).alias("score"))


@query("filter_reason", f"WITH {FILES} SELECT path, CASE WHEN contains(path, 'secret') THEN 'sensitive-path' END AS reason, CASE WHEN regexp_matches(path, '\\.md$') THEN 'docs' ELSE 'code' END AS category, length(regexp_extract(path, '(\\.[^./]*)$', 1)) AS ext_chars FROM f")
def filter_reason(t):
    p = F.col("path")
    return files(t).select("path", P.filter_reason(p).alias("reason"), P.category(p).alias("category"), F.length(T.extension(p)).alias("ext_chars"))



@query("topk_per_group", f"WITH {FILES}, r AS (SELECT path, split_part(path, '/', 1) AS \"group\", row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY path) AS rank FROM f) SELECT * FROM r WHERE rank <= 18")
def topk_per_group(t):
    return R.top_per_group(files(t).select("path"), F.substring_index("path", "/", 1), ["path"])


@query("url_guard", "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'private' WHEN page_id % 7 = 0 THEN 'protocol' WHEN NOT ends_with(regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1), '.example.net') THEN 'not allowed' END AS issue, regexp_replace(url, '[?#].*$', '') AS safe FROM pages")
def url_guard(t):
    i = F.col("page_id")
    url = F.when(i % 5 == 0, F.lit("http://192.168.0.7/x")).when(i % 7 == 0, F.lit("ftp://a.example.net/")).otherwise(F.col("url"))
    return t("pages").select("page_id", P.url_guard(url, ("example.net",)).alias("issue"), T.safe_url(F.col("url")).alias("safe"))


RISK = ", ".join(f"CASE WHEN {has('text', p.replace('сделай|исправь|почини', 'сделай|исправь|почини'))} THEN '{k}' END" for k, p in O.RISKS.items())
IS = {k: has("text", p) for k, p in O.TASKS.items()}
LOG = "(regexp_matches(text, '(?m)^\\s*at\\s+.+\\(.+:\\d+:\\d+\\)') OR regexp_matches(text, '(?i)traceback \\(most recent call last\\)') OR regexp_matches(text, '(?i)\\berror:\\s.+') OR length(text) >= 8000 OR len(string_split(text, chr(10))) >= 150)"
ROUTE = f"""WITH r AS (SELECT conv_id, turn, text, list_transform(regexp_extract_all(text, 'https?://[^\\s<>)"'']+'), lambda u: rtrim(u, '),.;')) AS urls FROM conversations),
f AS (SELECT *, list_filter([CASE WHEN len(list_filter(urls, lambda u: {has('u', O.IMAGE)})) > 0 THEN 'screenshot' END, CASE WHEN {IS['trace']} THEN 'trace' END, CASE WHEN {LOG} THEN 'logs' END, CASE WHEN NOT {LOG} AND length(text) >= 5000 THEN 'text' END, CASE WHEN {IS['deep_web']} THEN 'scraper' END,
 CASE WHEN NOT {IS['deep_web']} AND len(list_filter(urls, lambda u: NOT {has('u', O.IMAGE)})) > 0 AND {IS['read']} THEN 'url' END, CASE WHEN {IS['repo']} AND NOT {has('text', O.FILE_PATH)} AND NOT {LOG} THEN 'retrieval' END, CASE WHEN {IS['checks']} THEN 'checks' END, CASE WHEN {IS['dependency']} AND NOT {IS['release']} THEN 'dependency' END,
 CASE WHEN {IS['docs']} THEN 'docs' END, CASE WHEN {IS['release']} OR {IS['cleanup']} THEN 'cleanup' END, CASE WHEN {IS['gate']} THEN 'gate' END], lambda x: x IS NOT NULL) AS tools, list_filter([{RISK}], lambda x: x IS NOT NULL) AS risks FROM r),
d AS (SELECT *, CASE WHEN list_contains(risks, 'ambiguous_task') AND len(tools) = 0 THEN 'ask' WHEN len(tools) > 0 THEN 'call' ELSE 'skip' END AS decision FROM f)
SELECT conv_id, turn, array_to_string(tools, ',') AS tools, decision, array_to_string(risks, ',') AS risk_flags, CAST(CASE WHEN decision = 'skip' THEN CASE WHEN length(text) < 1200 AND len(urls) = 0 THEN 0.82 ELSE 0.68 END
 ELSE greatest(0.72, coalesce(list_max(list_transform(tools, lambda x: CASE x WHEN 'screenshot' THEN 0.96 WHEN 'trace' THEN 0.94 WHEN 'logs' THEN 0.93 WHEN 'text' THEN 0.9 WHEN 'scraper' THEN 0.9 WHEN 'checks' THEN 0.86 WHEN 'docs' THEN 0.84 WHEN 'cleanup' THEN 0.84 WHEN 'gate' THEN 0.84 ELSE 0.88 END)), 0)) END AS DOUBLE) AS score FROM d"""


@query("fn_route", ROUTE)
def fn_route(t):
    rows = t("conversations").select(F.struct("conv_id", "turn").alias("k"), "text")
    return O.route(rows, "k").select("k.conv_id", "k.turn", "tools", "decision", "risk_flags", "score")


@query("fn_redact", "SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(text, '(?i)(authorization:\\s*bearer\\s+)\\S+', '\\1[redacted]', 'g'), '(?i)((?:api[_-]?key|token|secret|password|passwd)\\s*[:=]\\s*)\\S+', '\\1[redacted]', 'g'), '\\b(?:sk|pk|ghp|gho|xox[abp])[-_][A-Za-z0-9_-]{12,}', '[redacted]', 'g') AS clean FROM conversations")
def fn_redact(t):
    return t("conversations").select("conv_id", "turn", T.redact(F.col("text")).alias("clean"))



@query("agg_context_pressure", f"WITH {FILES}, l AS (SELECT path, len(string_split(text, chr(10))) AS n, doc_id FROM f) SELECT split_part(path, '/', 1) AS \"group\", CAST(sum(CASE WHEN regexp_matches(path, '\\.md$') THEN n ELSE 2 * n END) AS BIGINT) AS pressure, CAST(sum(CASE WHEN regexp_matches(path, '\\.md$') THEN n ELSE 0 END) AS BIGINT) AS doc_lines FROM l GROUP BY 1")
def agg_context_pressure(t):
    n, p = F.size(F.split("text", "\n")), F.col("path")
    kind = P.category(p)
    weight = F.when(P.is_generated(p), 10).when(kind == "docs", n).when(kind == "code", 2 * n).otherwise(0)
    return files(t).groupBy(F.substring_index("path", "/", 1).alias("group")).agg(F.sum(weight).alias("pressure"), F.sum(F.when(kind == "docs", n).otherwise(0)).alias("doc_lines"))


def numstat(t):
    k = F.col("p_partkey")
    return t("part").select(F.concat(F.when(k % 10 == 0, "-").otherwise((k % 50).cast("string")), F.lit("\t"), (k % 7).cast("string"), F.lit("\tsrc/"), k.cast("string"), F.lit(".ts")).alias("line"))


@query("src_git_numstat", "SELECT 'src/' || p_partkey || '.ts' AS path, CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE p_partkey % 50 END AS added, p_partkey % 7 AS deleted FROM part")
def src_git_numstat(t):
    return IN.git_numstat(numstat(t))


SLUGS = "WITH h AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents), s AS (SELECT doc_id, line, regexp_replace(regexp_replace(lower(trim(x)), '[^\\p{L}\\p{N}\\s_-]', '', 'g'), '\\s', '-', 'g') AS slug FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, slug ORDER BY line) - 1 AS n FROM s) SELECT doc_id, line, CASE WHEN n = 0 THEN slug ELSE slug || '-' || n END AS slug FROM r"


@query("win_slug_dedup", SLUGS)
def win_slug_dedup(t):
    h = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "x")).select("doc_id", (F.col("pos") + 1).alias("line"), T.github_slug(F.trim("x")).alias("slug"))
    n = F.row_number().over(Window.partitionBy("doc_id", "slug").orderBy("line")) - 1
    return h.select("doc_id", "line", F.when(n == 0, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), n.cast("string"))).alias("slug"))


LOCKS = "SELECT p_partkey AS report, 'a' AS name, '1.' || (p_partkey % 3) AS version, p_partkey % 2 = 0 AS dev FROM part UNION ALL SELECT p_partkey, 'b', '2.0', FALSE FROM part"


@query("src_lockfile", LOCKS)
def src_lockfile(t):
    k = F.col("p_partkey")
    raw = F.concat(F.lit('{"packages": {"": {}, "node_modules/b": {"version": "2.0"}, "node_modules/a": {"version": "1.'), (k % 3).cast("string"), F.lit('", "dev": '), (k % 2 == 0).cast("string"), F.lit("}}}"))
    return t("part").select(k.alias("report"), F.explode(IN.lockfile(raw)).alias("p")).select("report", "p.name", "p.version", "p.dev")
