"""Code and Markdown queries: part rows as source files, documents as Markdown."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.operators import code as C
from strataloom.operators import dependencies as DEP
from strataloom.operators import graph as G
from strataloom.operators import graph_index as GI
from strataloom.session import scratch

from .registry import query
from .text_queries import has

Q = lambda s: s.replace("'", "''")


def source(t):
    """A small module for each part: an import, a require, an exported function that calls another, a constant."""
    k = F.col("p_partkey")
    s = lambda x: x.cast("string")
    text = F.concat(
        F.lit('import { a } from "./m'), s(k % 50), F.lit('";\nimport x from "@scope/pkg'), s(k % 7), F.lit('/sub";\nconst r = require("lib'), s(k % 5), F.lit('");\nexport async function run'), s(k), F.lit("(a) {\n  if (a && r) { return run"), s((k * 7) % 2500 + 1),
        F.lit("(a) ? 1 : 2; }\n}\nexport class Box"), s(k % 3), F.lit(" {}\nconst f = (y) => y;\n// TODO: "), F.col("p_name"),
    )
    return t("part").select(F.concat(F.lit("src/m"), s(k), F.lit(".ts")).alias("path"), text.alias("text"))


SOURCE = """s AS (SELECT 'src/m' || p_partkey || '.ts' AS path, 'import { a } from "./m' || p_partkey % 50 || '";' || chr(10) || 'import x from "@scope/pkg' || p_partkey % 7 || '/sub";' || chr(10) || 'const r = require("lib' || p_partkey % 5 || '");' || chr(10) || 'export async function run' || p_partkey || '(a) {' || chr(10) || '  if (a && r) { return run' || ((p_partkey * 7) % 2500 + 1) || '(a) ? 1 : 2; }' || chr(10) || '}' || chr(10) || 'export class Box' || p_partkey % 3 || ' {}' || chr(10) || 'const f = (y) => y;' || chr(10) || '// TODO: ' || p_name AS text FROM part),
l AS (SELECT path, regexp_replace(unnest(string_split(text, chr(10))), '^\\s+|\\s+$', '', 'g') AS x, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM s)"""


def found(patterns, name: str) -> str:
    return " UNION ALL ".join(f"SELECT path, line, '{kind}' AS kind, regexp_extract(x, '{Q(p)}', 1) AS {name} FROM l WHERE regexp_extract(x, '{Q(p)}', 1) <> ''" for kind, p in patterns)


@query("fn_parse_symbols", f"WITH {SOURCE} {found(C.SYMBOLS, 'name')}")
def fn_parse_symbols(t):
    return C.symbols(source(t))


@query("fn_parse_imports", f"WITH {SOURCE} {found(C.IMPORTS, 'target')}")
def fn_parse_imports(t):
    return C.imports(source(t))


TOKENS = "[A-Za-z_$][A-Za-z0-9_$-]{2,79}"


@query("graph_build", f"""WITH {SOURCE}, y AS ({found(C.SYMBOLS, 'name')}), i AS ({found(C.IMPORTS, 'target')}), k AS (SELECT DISTINCT path, line, unnest(regexp_extract_all(x, '{TOKENS}')) AS token FROM l),
u AS (SELECT k.* FROM k WHERE token IN (SELECT name FROM y) AND NOT EXISTS (SELECT 1 FROM y WHERE y.name = k.token AND y.path = k.path AND y.line = k.line)), r AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY path, line) AS rank FROM u)
SELECT 'symbol' AS kind, path, line::INT AS line, name, NULL AS resolved FROM y UNION ALL SELECT 'import', path, line, target, CASE WHEN starts_with(target, './') AND 'src/' || substr(target, 3) || '.ts' IN (SELECT path FROM s) THEN 'src/' || substr(target, 3) || '.ts' END FROM i UNION ALL SELECT 'reference', path, line, token, NULL FROM r WHERE rank <= 80""")
def graph_build(t):
    """An index of an older state of the tree, brought up to date: some files were shorter, some lacked, some are gone."""
    k, now = F.regexp_extract("path", "([0-9]+)", 1).cast("int"), source(t)
    now = now.withColumns({"size_bytes": F.octet_length("text"), "mtime_ms": F.when(k % 5 == 0, 2).otherwise(1)})
    was = now.filter(k % 11 != 0).withColumn("text", F.when(k % 5 == 0, F.substring_index("text", "\n", 3)).otherwise(F.col("text"))).withColumns({"size_bytes": F.octet_length("text"), "mtime_ms": F.lit(1)})
    was = was.unionByName(was.filter(k % 7 == 0).withColumn("path", F.concat(F.lit("old/"), "path")))
    spark = now.sparkSession
    folder = scratch(spark)
    GI.build(was, folder)
    GI.update(now, folder)
    none = F.lit(None).cast("string")
    rows = lambda name, kind, item, resolved: GI.read(spark, folder, name).select(F.lit(kind).alias("kind"), "path", "line", F.col(item).alias("name"), resolved.alias("resolved"))
    return rows("symbols", "symbol", "name", none).unionByName(rows("resolved", "import", "target", F.col("resolved_path"))).unionByName(rows("references", "reference", "symbol", none))


@query("graph_index_summary", f"WITH {SOURCE}, y AS ({found(C.SYMBOLS, 'name')}) SELECT kind, count(*) AS symbols, count(DISTINCT path) AS files FROM y GROUP BY kind")
def graph_index_summary(t):
    return C.symbols(source(t)).groupBy("kind").agg(F.count("*").alias("symbols"), F.count_distinct("path").alias("files"))


@query("graph_find_symbol", f"WITH {SOURCE}, y AS ({found(C.SYMBOLS, 'name')}), r AS (SELECT *, CASE WHEN name = 'Box1' THEN 100 WHEN lower(name) = 'box1' THEN 70 WHEN starts_with(lower(name), 'box1') THEN 20 WHEN contains(lower(name), 'box1') THEN 15 END + CASE WHEN kind = 'function' THEN 5 ELSE 0 END AS score FROM y) SELECT path, line, kind, name AS symbol, score FROM r WHERE score IS NOT NULL ORDER BY score DESC, path, line LIMIT 20")
def graph_find_symbol(t):
    return G.find_symbol(C.symbols(source(t)).withColumnRenamed("name", "symbol"), "Box1").limit(20)


def packages(t):
    """A package a brand: its sizes are the declared packages, its parts the code, and scripts, lock and settings beside."""
    brand, size, k = F.regexp_replace("p_brand", "#", ""), F.col("p_size").cast("string"), F.col("p_partkey")
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    quoted = lambda prefix, where: F.array_join(F.array_sort(F.collect_set(F.when(where, text('"', prefix, size, '": "1"')))), ", ")
    s = F.col("p_size")
    own = t("part").withColumn("brand", brand).groupBy("brand").agg(
        text('{"scripts": {"a": "tool7 --x; bin3"}, "dependencies": {', quoted("lib", s > 0), '}, "devDependencies": {', quoted("@types/lib", s % 3 == 0), "}}").alias("package.json"),
        text('{"packages": {', F.array_join(F.array_sort(F.collect_set(F.when(s % 5 == 3, text('"node_modules/lib', size, '": {"bin": {"bin', size, '": "x"}, "peerDependencies": {"lib', (s + 1).cast("string"), '": "1"}}')))), ", "), "}}").alias("package-lock.json"),
        text("// uses @types/lib6@2 and lib", F.min("p_size").cast("string"), ".").alias("vite.config.ts"),
    )
    files = own.select(F.explode(F.array(*(F.struct(text("pkg/", F.col("brand"), "/", n).alias("path"), F.col(f"`{n}`").alias("text")) for n in ("package.json", "package-lock.json", "vite.config.ts")))).alias("f")).select("f.*")
    code = text("import {\n  a,\n  b\n} from 'lib", (k % 30).cast("string"), "/sub';\n@import url('lib", (k % 7 + 30).cast("string"), ".css');\nconst x = require(\n 'lib", (k % 3 + 40).cast("string"), "');")
    return files.unionByName(t("part").select(text("pkg/", brand, "/src/m", k.cast("string"), ".ts").alias("path"), code.alias("text")))


# lib<n> is imported, asked for by the package whose program bin3 a script calls, or has its types' runtime declared; a full stop behind a name makes it another one
@query("join_dep_imports", """WITH p AS (SELECT replace(p_brand, '#', '') AS brand, p_size AS n, p_partkey AS k FROM part), d AS (SELECT DISTINCT brand, n, 'lib' || n AS name, 'dependencies' AS type FROM p UNION SELECT DISTINCT brand, n, '@types/lib' || n, 'devDependencies' FROM p WHERE n % 3 = 0),
u AS (SELECT brand, 'lib' || k % 30 AS name FROM p UNION SELECT brand, 'lib' || (k % 3 + 40) FROM p UNION SELECT brand, 'lib' || (k % 7 + 30) || '.css' FROM p), used AS (SELECT * FROM u UNION SELECT brand, 'lib3' FROM p WHERE n = 3 UNION SELECT brand, '@types/lib6' FROM p),
prov AS (SELECT brand, name FROM used), peers AS (SELECT DISTINCT p.brand, 'lib' || (n + 1) AS name FROM p JOIN prov ON prov.brand = p.brand AND prov.name = 'lib' || n WHERE n % 5 = 3), known AS (SELECT brand, name FROM u UNION SELECT brand, name FROM d)
SELECT 'pkg/' || brand || '/package.json' AS package_file, name AS dependency_name, type AS dependency_type, CASE WHEN type = 'dependencies' THEN 0.65 ELSE 0.5 END::DOUBLE AS confidence FROM d
WHERE NOT EXISTS (SELECT 1 FROM used x WHERE x.brand = d.brand AND x.name = d.name) AND NOT EXISTS (SELECT 1 FROM peers x WHERE x.brand = d.brand AND x.name = d.name) AND NOT (type = 'devDependencies' AND EXISTS (SELECT 1 FROM known x WHERE x.brand = d.brand AND x.name = replace(d.name, '@types/', '')))""")
def join_dep_imports(t):
    return DEP.unused_dependencies(packages(t))


@query("agg_unused_exports", f"WITH {SOURCE}, e AS (SELECT DISTINCT path, unnest(regexp_extract_all(text, '{Q(C.EXPORTED)}', 1)) AS name FROM s), w AS (SELECT name, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[^A-Za-z0-9_$]+')) AS name FROM s) GROUP BY name) SELECT path, name FROM e WHERE length(name) >= 3 AND name NOT IN (SELECT name FROM w WHERE n > 1)")
def agg_unused_exports(t):
    return C.unused_exports(source(t))


COUNT = lambda p: f"len(regexp_extract_all(text, '{Q(p)}'))"


@query("agg_complexity", f"WITH {SOURCE}, n AS (SELECT path, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS lines, {COUNT(C.FUNCTIONS)} AS functions, {COUNT(C.BRANCHES)} AS branches, {' + '.join(COUNT(p) for _, p in C.IMPORTS)} AS imports FROM s) SELECT *, CAST(2 * branches + 3 * functions + imports + ceil(lines / 40.0) AS BIGINT) AS score FROM n ORDER BY score DESC, lines DESC, path LIMIT 50")
def agg_complexity(t):
    return C.complexity(source(t))


RULES = (("todo", "TODO"), ("any", r": any\b"), ("require", r"\brequire\("), ("console", r"console[.]"))


@query("agg_antipattern", f"WITH {SOURCE}, r AS (SELECT * FROM (VALUES {', '.join(f'''('{a}', '{Q(b)}')''' for a, b in RULES)}) v(rule, pattern)) SELECT rule, count(path) AS hits, count(DISTINCT path) AS files FROM r LEFT JOIN l ON regexp_matches(x, pattern) GROUP BY rule")
def agg_antipattern(t):
    return C.rule_hits(source(t), RULES)


# --- Markdown ---------------------------------------------------------------------------------


def markdown(t):
    """documents with a heading on every third line, links, and open points."""
    i = F.col("doc_id")
    prefix = lambda n: F.when(n % 3 == 0, F.concat(F.repeat(F.lit("#"), 1 + (n / 3).cast("int") % 3), F.lit(" "))).when(n % 7 == 1, "- [ ] ").when(n % 7 == 2, "see [x](./d").otherwise("")
    suffix = lambda n: F.when((n % 3 != 0) & (n % 7 == 2), F.concat(F.lit(".md#"), n.cast("string"), F.lit(")"))).otherwise("")
    body = F.array_join(F.transform(F.split("text", "\n"), lambda x, n: F.when(n % 3 == 0, F.concat(prefix(n), F.substring(x, 1, 12))).when(n % 7 == 2, F.concat(prefix(n), F.length(x).cast("string"), suffix(n))).otherwise(F.concat(prefix(n), x))), "\n")
    return t("documents").select(F.concat(F.lit("d"), i.cast("string"), F.lit(".md")).alias("path"), body.alias("text"))


MARKDOWN = """m AS (SELECT 'd' || doc_id || '.md' AS path, unnest(string_split(text, chr(10))) AS x0, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
l0 AS (SELECT path, line, CASE WHEN (line - 1) % 3 = 0 THEN repeat('#', CAST(1 + ((line - 1) // 3) % 3 AS INT)) || ' ' || substr(x0, 1, 12) WHEN (line - 1) % 7 = 2 THEN 'see [x](./d' || length(x0) || '.md#' || (line - 1) || ')' WHEN (line - 1) % 7 = 1 THEN '- [ ] ' || x0 ELSE x0 END AS x1 FROM m), l AS (SELECT path, line, x1, regexp_replace(x1, '^\\s+|\\s+$', '', 'g') AS x FROM l0)"""
HEADED = f"h AS (SELECT path, line, length(regexp_extract(x, '{C.HEADING}', 1)) AS level, substr(regexp_replace(regexp_extract(x, '{C.HEADING}', 2), '^\\s+|\\s+$', '', 'g'), 1, 160) AS title FROM l WHERE regexp_extract(x, '{C.HEADING}', 1) <> '')"
SLUG = "regexp_replace(regexp_replace(lower(title), '[^\\p{L}\\p{N}\\s_-]', '', 'g'), '\\s', '-', 'g')"


@query("fn_headings", f"WITH {MARKDOWN}, {HEADED}, n AS (SELECT *, {SLUG} AS slug, row_number() OVER (PARTITION BY path, {SLUG} ORDER BY line) - 1 AS n FROM h) SELECT path, line, level, title, CASE WHEN n = 0 THEN slug ELSE slug || '-' || n END AS anchor FROM n")
def fn_headings(t):
    return C.headings(markdown(t))


LINKS = "k AS (SELECT path AS src, line, regexp_extract(x, '\\(\\./([^#)]+)', 1) AS target, regexp_extract(x, '#([^)]+)', 1) AS anchor FROM l WHERE starts_with(x, 'see [x]('))"


@query("fn_md_link_refs", f"WITH {MARKDOWN}, {LINKS} SELECT * FROM k")
def fn_md_link_refs(t):
    return C.links(markdown(t))


@query("join_stale_refs", f"WITH {MARKDOWN}, {LINKS} SELECT * FROM k WHERE target NOT IN (SELECT path FROM l)")
def join_stale_refs(t):
    files = markdown(t)
    return G.broken_links(C.links(files), files)


@query("join_doc_anchors", f"WITH {MARKDOWN}, {HEADED}, {LINKS}, n AS (SELECT path, {SLUG} || CASE WHEN row_number() OVER (PARTITION BY path, {SLUG} ORDER BY line) > 1 THEN '-' || (row_number() OVER (PARTITION BY path, {SLUG} ORDER BY line) - 1) ELSE '' END AS anchor FROM h) SELECT * FROM k WHERE target IN (SELECT path FROM h) AND NOT EXISTS (SELECT 1 FROM n WHERE n.path = k.target AND n.anchor = k.anchor)")
def join_doc_anchors(t):
    files = markdown(t)
    return G.broken_anchors(C.links(files), C.headings(files).select(F.col("path").alias("target"), "anchor"))


@query("agg_doc_inventory", f"WITH {MARKDOWN} SELECT path, count(*) AS lines, count(*) FILTER (regexp_matches(x1, '{C.HEADING}')) AS headings, FALSE AS frontmatter, count(*) >= 800 AS large FROM l GROUP BY path")
def agg_doc_inventory(t):
    return C.inventory(markdown(t))


@query("pred_action_marker", f"WITH {MARKDOWN} SELECT path, line, CASE WHEN regexp_matches(x, '-\\s+\\[\\s\\]') THEN 'checkbox' WHEN {has('x', chr(92) + 'bFIXME' + chr(92) + 'b')} THEN 'fixme' WHEN {has('x', chr(92) + 'bTODO' + chr(92) + 'b')} THEN 'todo' ELSE 'action' END AS kind FROM l WHERE {has('x', C.MARKER)}")
def pred_action_marker(t):
    return C.markers(markdown(t))


NORMAL = "body"
for _p in (r"(?s)```.*?```", "`[^`]+`", r"\[[^\]]+\]\([^)]+\)", r"https?://\S+", r"[^\p{L}\p{N}\s]", r"\s+"):
    NORMAL = f"regexp_replace({NORMAL}, '{_p}', ' ', 'g')"


@query("agg_duplicate_sections", f"""WITH {MARKDOWN}, s AS (SELECT *, regexp_extract(x, '{C.HEADING}', 1) <> '' AS hd, sum(CASE WHEN regexp_extract(x, '{C.HEADING}', 1) <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line) AS section FROM l),
b AS (SELECT path, section, min(line) AS start, coalesce(string_agg(x, chr(10) ORDER BY line) FILTER (NOT hd), '') AS body, count(*) FILTER (NOT hd AND x <> '') AS lines FROM s WHERE section > 0 GROUP BY ALL),
n AS (SELECT path, start, lower(trim({NORMAL})) AS normal FROM b WHERE lines >= 1), p AS (SELECT substr(sha256(normal), 1, 16) AS hash, path, count(*) AS n, min(start) AS start FROM n WHERE length(normal) >= 60 GROUP BY ALL)
SELECT hash, count(*) AS files, CAST(sum(n) AS BIGINT) AS occurrences, min(path) AS first_path, min_by(start, path) AS first_line FROM p GROUP BY hash HAVING count(*) > 1""")
def agg_duplicate_sections(t):
    return C.duplicate_sections(markdown(t), 1, 60)


@query("pred_ssot_conflict", f"WITH l AS (SELECT 'c' || conv_id || '-' || turn AS path, CASE WHEN turn % 2 = 0 THEN 'Notion is the canonical place' WHEN turn % 3 = 0 THEN 'confluence mirror, repo is ssot' ELSE text END AS x FROM conversations) SELECT path, 1 AS line, substr(sha256(x), 1, 16) AS hash FROM l WHERE {has('x', C.CONFLICT)} AND NOT {has('x', C.MIRROR)} AND NOT contains(x, chr(10))")
def pred_ssot_conflict(t):
    n = F.col("turn")
    x = F.when(n % 2 == 0, "Notion is the canonical place").when(n % 3 == 0, "confluence mirror, repo is ssot").otherwise(F.col("text"))
    return C.truth_conflicts(t("conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), n.cast("string")).alias("path"), x.alias("text")).filter(~F.contains("text", F.lit("\n"))))
