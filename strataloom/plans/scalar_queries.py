"""One query for each scalar operator, window and small set operation: keys and values, against SQL."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from strataloom.functions import predicates as P
from strataloom.functions import text as T
from strataloom.operators import code as C
from strataloom.operators import compact as K
from strataloom.operators import diffs as D
from strataloom.operators import logs as L
from strataloom.operators import retrieve as R
from strataloom.operators import windows as V

from .registry import query
from .text_queries import NORMAL, SCORE, clamp, has, pct, tokens, trim

TRIMMED = trim


def scalar(name: str, table: str, key: str, value, sql: str, source: str | None = None):
    """value() is a Column over the table; sql the same expression."""
    query(name, f"SELECT {key}, {sql} AS value FROM {source or table}")(lambda t: t(table).select(*(k.strip() for k in key.split(",")), value().alias("value")))


def joined(c: Column) -> Column:
    return F.array_join(c, "␟")


X, N = (lambda: F.col("text")), (lambda: F.col("p_partkey"))
DOC = ("documents", "doc_id")
PART = ("part", "p_partkey")
LINE = "split_part(text, chr(10), 1)"
SQL_SPACE = r"[\t\n\f\r ]"  # what \s is in SQL's patterns: Java's has the vertical tab too
LINES_OF = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)"


def by_line(name: str, value, sql: str):
    """value(text) of every line of every document."""
    query(name, f"SELECT doc_id, line, {sql} AS value FROM {LINES_OF}")(lambda t: K.lines(t("documents")).select("doc_id", "line", value(F.col("text")).alias("value")))


for name, pattern in {"pred_error_line": P.ERROR, "pred_command_line": P.COMMAND, "pred_stack_line": P.STACK, "pred_decision": P.DECISION, "pred_action": P.ACTION, "pred_risk": P.RISK, "pred_question": P.QUESTION, "pred_critical_unit": P.CRITICAL, "pred_noise_unit": P.NOISE}.items():
    by_line(name, lambda x, pattern=pattern: P.matches(x, pattern), has("x", pattern))

PATHS = ("a/.env", "docs/Secret.md", "x.PNG", "src/a.ts", "dist/a.js", "b/yarn.lock", "readme.md", "k.pem", "lib/noext")
path = lambda: F.element_at(F.array(*map(F.lit, PATHS)), (N() % len(PATHS) + 1).cast("int"))
PATH = "[" + ", ".join(f"'{p}'" for p in PATHS) + f"][p_partkey % {len(PATHS)} + 1]"
EXT = f"lower(regexp_extract({PATH}, '[^/](\\.[^./]*)$', 1))"
SENSITIVE = f"(contains(lower({PATH}), '/.env') OR contains(lower({PATH}), 'secret') OR contains(lower({PATH}), 'token') OR ends_with(lower({PATH}), '.pem') OR ends_with(lower({PATH}), '.key'))"
scalar("pred_sensitive_path", *PART, lambda: P.is_sensitive_path(path()), SENSITIVE)
scalar("pred_binary_ext", *PART, lambda: P.is_binary_path(path()), f"{EXT} IN ('.png')")
scalar("pred_generated_like", *PART, lambda: P.is_generated(path()), f"(starts_with({PATH}, 'dist/') OR ends_with({PATH}, '.lock'))")
scalar("proj_category", *PART, lambda: P.category(path()), f"CASE WHEN {EXT} = '.md' THEN 'docs' WHEN {EXT} IN ('.ts', '.js') THEN 'code' ELSE 'other' END")
scalar("fn_path_priority", *PART, lambda: R.path_priority(path()), f"CASE WHEN {PATH} = 'readme.md' THEN 80 ELSE 0 END + CASE WHEN starts_with({PATH}, 'src/') THEN 24 ELSE 0 END + CASE WHEN starts_with({PATH}, 'docs/') THEN 8 ELSE 0 END - 2 * (len(string_split({PATH}, '/')) - 1)")
scalar("pred_frontmatter", *DOC, lambda: P.has_frontmatter(F.concat(F.when(F.col("doc_id") % 3 == 0, "---\nt: 1\n---\n").otherwise(""), X())), "doc_id % 3 = 0")
LINKS = ("https://x.org", "mailto:a@b", "./a.md", "//cdn/x", "a/b.md#c", "#top")
scalar("pred_external_link", *PART, lambda: P.is_external_link(F.element_at(F.array(*map(F.lit, LINKS)), (N() % 6 + 1).cast("int"))), "p_partkey % 6 IN (0, 1, 3)")
IPS = ("10.1.2.3", "172.16.0.1", "172.32.0.1", "192.168.1.1", "8.8.8.8", "169.254.0.9", "::1", "fd00::1", "2001:db8::1")
scalar("pred_private_ip", *PART, lambda: P.is_private_ip(F.element_at(F.array(*map(F.lit, IPS)), (N() % 9 + 1).cast("int"))), "p_partkey % 9 IN (0, 1, 3, 5, 6, 7)")
scalar("pred_time_window", "events", "event_id", lambda: P.in_window(F.col("ts"), "2024-01-03", "2024-01-04"), "ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-04'")
scalar("pred_disallowed_license", *PART, lambda: D.license_disallowed(F.element_at(F.array(F.lit("MIT"), F.lit("AGPL-3.0"), F.lit(None), F.lit("gpl-3.0-only")), (N() % 4 + 1).cast("int"))), "p_partkey % 4 IN (1, 3)")
scalar("fn_resolved_kind", *PART, lambda: D.resolved_kind(F.element_at(F.array(*map(F.lit, ("", "git://x", "file:x", "link:x", "http://x", "https://registry.npmjs.org/x", "https://y", "z"))), (N() % 8 + 1).cast("int"))), "['missing', 'git', 'file', 'link', 'http', 'npm', 'https', 'other'][p_partkey % 8 + 1]")

scalar("fn_estimate_tokens", *DOC, lambda: T.estimate_tokens("text"), tokens("text"))
scalar("fn_estimate_tokens_flat", *DOC, lambda: T.estimate_tokens_flat("text"), "CAST(ceil(length(text) / 4.0) AS BIGINT)")
scalar("fn_estimate_tokens_mixed", *DOC, lambda: T.estimate_tokens_mixed("text"), "greatest(1, CAST(ceil(length(text) / 4.0) AS BIGINT))")
scalar("fn_token_stats", *DOC, lambda: T.savings(T.estimate_tokens("text"), T.estimate_tokens(F.substring("text", 1, 100)))[1], pct(f"({tokens('text')})", f"({tokens('substr(text, 1, 100)')})"))
scalar("fn_savings_pct", *PART, lambda: T.savings_pct(F.col("p_retailprice"), F.col("p_size").cast("double")), "greatest(0.0, floor((1.0 - p_size / p_retailprice) * 100.0 * 10.0 + 0.5) / 10.0)")
scalar("fn_round", *PART, lambda: T.round_to(F.col("p_retailprice") / 7, 2), "floor(p_retailprice / 7 * 100.0 + 0.5) / 100.0")
scalar("fn_clamp_headtail", *DOC, lambda: T.clamp_head_tail(X(), 300), clamp("text", 300))
scalar("fn_clamp_trunc", *DOC, lambda: T.clamp_cut(X(), 200, 80, " [cut]"), "CASE WHEN length(text) <= 200 THEN text ELSE substr(text, 1, 120) || ' [cut]' END")
scalar("fn_normalize_ws", *DOC, lambda: T.normalise_space(F.concat(F.lit("  \t"), F.replace(X(), F.lit(" "), F.lit("  ")), F.lit("\n\n\n\n\nend "))), f"{TRIMMED('''regexp_replace(replace(chr(32) || chr(32) || chr(9) || replace(text, ' ', '  ') || repeat(chr(10), 5) || 'end ', chr(9), ' '), '[ ]{2,}', ' ', 'g')''').replace('regexp_replace(regexp_replace(', 'regexp_replace(regexp_replace(regexp_replace(', 1).replace(''', ' ', 'g'), '^''', ''', ' ', 'g'), '\\n{4,}', chr(10) || chr(10) || chr(10), 'g'), '^''', 1)}")
scalar("fn_strip_ansi", *DOC, lambda: T.strip_ansi(F.concat(F.lit("\x1b[31m"), X(), F.lit("\x1b[0m"))), "text")
scalar("fn_first_lines", *DOC, lambda: joined(T.first_lines(X(), 3)), f"array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {trim('x')}), lambda x: x <> '')[1:3], '␟')")
scalar("fn_split_units", *DOC, lambda: F.size(K.units_of(X())), f"len(list_filter(string_split(text, chr(10)), lambda x: {trim('x')} <> ''))")
scalar("fn_stable_hash", *DOC, lambda: T.stable_hash(X()), "substr(sha256(text), 1, 16)")
scalar("fn_normalize_section", *DOC, lambda: C.normal_section(X()), "lower(trim(regexp_replace(regexp_replace(text, '[^\\p{L}\\p{N}\\s]', ' ', 'g'), '\\s+', ' ', 'g')))", "(SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)```.*?```', ' ', 'g'), '`[^`]+`', ' ', 'g'), '\\[[^\\]]+\\]\\([^)]+\\)', ' ', 'g'), 'https?://\\S+', ' ', 'g') AS text FROM documents)")
scalar("fn_safe_url", "pages", "page_id", lambda: T.safe_url(F.col("url")), "regexp_replace(url, '[?#].*$', '')")
scalar("fn_safe_id", *PART, lambda: T.safe_id(F.concat(F.lit(" --A/"), F.col("p_name"), F.lit("! ")), 20), "substr(regexp_replace(regexp_replace(lower('--A/' || p_name || '!'), '[^a-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 20)")
scalar("fn_clean_label", *PART, lambda: L.label(F.concat(F.lit("  "), F.col("p_name")), 5), "substr(trim(p_name), 1, 5)")
scalar("fn_package_name", *PART, lambda: C.package_name(F.element_at(F.array(*map(F.lit, ("@a/b/c", "lib/x", "./y", "node:fs", "z"))), (N() % 5 + 1).cast("int"))), "['@a/b', 'lib', '', '', 'z'][p_partkey % 5 + 1]")
scalar("fn_major", *PART, lambda: T.major(F.concat(F.lit("^"), N().cast("string"), F.lit(".2.3"))), "CAST(p_partkey AS INT)")
scalar("fn_compressors", *DOC, lambda: joined(F.array(*(F.md5(f(X())) for f in K.COMPRESSORS.values()))), "md5(substr(text, 1, 200)) || '␟' || md5(substr(text, 1, 1000)) || '␟' || md5(text) || '␟' || md5(regexp_replace(text, '\\s+', ' ', 'g'))")
scalar("fn_clamp01", *PART, lambda: T.clamp01(F.col("p_size") / 30 - 0.5), "least(1.0, greatest(0.0, p_size / 30 - 0.5))")
scalar("fn_safe_preview", *DOC, lambda: T.safe_preview(F.regexp_replace("text", r"[:=]", " "), 50), f"CASE WHEN length({trim('''regexp_replace(regexp_replace(text, '[:=]', ' ', 'g'), '\\s+', ' ', 'g')''')}) <= 50 THEN {trim('''regexp_replace(regexp_replace(text, '[:=]', ' ', 'g'), '\\s+', ' ', 'g')''')} ELSE substr({trim('''regexp_replace(regexp_replace(text, '[:=]', ' ', 'g'), '\\s+', ' ', 'g')''')}, 1, 49) || '…' END")
scalar("set_unique_ci", *DOC, lambda: F.size(T.unique_ci(F.split("text", " "), 10_000)), f"len(list_distinct(list_filter(list_transform(string_split(text, ' '), lambda x: lower({trim('x')})), lambda x: x <> '')))")
W_LIST = "(SELECT doc_id, string_split(text, ' ') AS w FROM documents)"
split = lambda: F.split("text", " ")
scalar("set_unique", *DOC, lambda: F.size(V.unique(split())), f"len(list_distinct(list_filter(list_transform(w, lambda x: {trim('x')}), lambda x: x <> '')))", W_LIST)
scalar("set_diff", *DOC, lambda: F.size(V.difference(split(), F.split(F.substring_index("text", "\n", 1), " "))), f"len(list_distinct(list_filter(string_split(text, ' '), lambda x: NOT list_contains(string_split({LINE}, ' '), x))))")
scalar("win_adjacent_pairs", *DOC, lambda: F.md5(joined(V.adjacent_pairs(split()))), "md5(array_to_string(list_transform(list_zip(w[1:len(w) - 1], w[2:]), lambda p: p[1] || '-' || p[2]), '␟'))", W_LIST)
scalar("win_tail", *DOC, lambda: V.tail(X(), 3, 400), clamp("v", 400), f"(SELECT doc_id, {trim('array_to_string(w[greatest(1, len(w) - 2):], chr(10))')} AS v FROM (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents))")
scalar("fn_ratio", *DOC, lambda: V.ratio(F.length(F.regexp_replace("text", r"\s+", "")), F.length("text")), "CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '\\s+', '', 'g')) / length(text) ELSE 0.0 END")
scalar("fn_byte_saving", *DOC, lambda: V.byte_saving(F.octet_length(F.regexp_replace("text", f"{SQL_SPACE}+", " ")), F.octet_length("text")), "1 - strlen(regexp_replace(text, '\\s+', ' ', 'g')) / strlen(text)")
scalar("fn_terms", *DOC, lambda: F.size(T.terms(X())), "len(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_а-яё-]+'), lambda x: length(x) >= 3 AND x NOT IN ('the', 'and', 'for', 'with', 'that', 'this', 'from', 'you', 'your', 'are'))))")
by_line("fn_score_unit", lambda x: K.score_unit(x, F.col("line") - 1, ()), SCORE.replace("8 * h + CASE WHEN h >= 2 THEN 8 ELSE 0 END + ", "").replace("(i - 1)", "(line - 1)"))
by_line("fn_normalize_dup_line", K.normal_line, NORMAL("x"))
by_line("fn_github_slug", T.github_slug, "regexp_replace(regexp_replace(lower(regexp_replace(x, '^\\s+|\\s+$', '', 'g')), '[^\\p{L}\\p{N}\\s_-]', '', 'g'), '\\s', '-', 'g')")


@query("agg_first_value", "SELECT user_id, min_by(event_type, event_id) FILTER (event_type <> 'view') AS first FROM events GROUP BY 1")
def agg_first_value(t):
    rows = t("events").select("user_id", "event_id", F.when(F.col("event_type") != "view", F.col("event_type")).otherwise("").alias("event_type"))
    return V.first_value(rows, ["user_id"], "event_type", "event_id")


@query("set_dedupe_by", "SELECT user_id, event_type, min(event_id) AS event_id, min_by(value, event_id) AS value FROM events GROUP BY ALL")
def set_dedupe_by(t):
    return V.dedupe_by(t("events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], ["event_id"])


@query("win_per_key_cap", "WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank FROM events) SELECT user_id, event_id, rank FROM r WHERE rank <= 80")
def win_per_key_cap(t):
    return V.cap_per_key(t("events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], 80).select("user_id", "event_id", "rank")


@query("win_score_gap", "WITH r AS (SELECT source, length(text) AS score, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS r, lead(length(text), 1, 0) OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS second FROM documents) SELECT source, score AS top, score - second AS gap FROM r WHERE r = 1")
def win_score_gap(t):
    return V.score_gap(t("documents").select("source", "doc_id", F.length("text").alias("score")), "source", "score", "doc_id")


@query("agg_compression_summary", "WITH r AS (SELECT p_size / 50.0 AS ratio, p_size AS units, p_partkey % 7 = 0 AS fallback FROM part) SELECT count(*) AS requests, count(*) FILTER (ratio <= 0.2) AS aggressive, count(*) FILTER (fallback) AS fallbacks, floor(avg(units) * 100.0 + 0.5) / 100.0 AS avg_units FROM r")
def agg_compression_summary(t):
    return V.compression_summary(t("part").select((F.col("p_size") / 50).alias("ratio"), F.col("p_size").alias("units_kept"), (N() % 7 == 0).alias("fallback")))


@query("agg_sum_finite", "SELECT event_type, sum(CASE WHEN event_id % 3 = 0 THEN 0 ELSE value END) AS total FROM events GROUP BY 1")
def agg_sum_finite(t):
    x = F.when(F.col("event_id") % 3 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    return t("events").groupBy("event_type").agg(F.sum(L.finite(x)).alias("total"))



@query("win_next_line", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents) SELECT doc_id, line, lead(length(x)) OVER (PARTITION BY doc_id ORDER BY line) AS next_chars FROM l")
def win_next_line(t):
    return K.lines(t("documents")).select("doc_id", "line", F.lead(F.length("text")).over(Window.partitionBy("doc_id").orderBy("line")).alias("next_chars"))


@query("src_text_lines", "SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line, md5(unnest(string_split(text, chr(10)))) AS digest FROM documents")
def src_text_lines(t):
    return K.lines(t("documents")).select("doc_id", "line", F.md5("text").alias("digest"))






