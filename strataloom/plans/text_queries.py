"""Compaction queries on documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.functions import predicates as P
from strataloom.functions import text as T
from strataloom.operators import compact as C

from .registry import joined_list, query

Q = lambda s: s.replace("'", "''")


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '(?i){Q(pattern)}')"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def tokens(x: str) -> str:
    cyr = f"(length({x}) - length(regexp_replace({x}, '[А-Яа-яЁё]', '', 'g')))"
    return f"CASE WHEN length({x}) = 0 THEN 0 ELSE greatest(1, CAST(ceil(length({x}) / CASE WHEN {cyr} > length({x}) * 0.25 THEN 3.2 ELSE 4.0 END) AS BIGINT)) END"


def pct(raw: str, small: str) -> str:
    return f"CASE WHEN {raw} > 0 THEN floor(greatest(0, {raw} - {small}) / {raw}::DOUBLE * 100.0 * 10.0 + 0.5) / 10.0 ELSE 0.0 END"


def clamp(x: str, most: int) -> str:
    head, tail = f"regexp_replace(substr({x}, 1, {int(most * 0.72 + 1e-9)}), '\\s+$', '')", f"regexp_replace(right({x}, {int(most * 0.18 + 1e-9)}), '^\\s+', '')"
    return f"CASE WHEN length({x}) <= {most} THEN {x} ELSE {head} || chr(10) || chr(10) || '[... omitted ' || CAST(length({x}) - length({head}) - length({tail}) AS VARCHAR) || ' chars ...]' || chr(10) || chr(10) || {tail} END"


LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)"


def unique(name: str, source: str, most: int) -> str:
    """CTE `name`: the distinct non-empty x of source (doc_id, x, i), in order, joined."""
    return f"""{name} AS (SELECT doc_id, string_agg(x, '␟' ORDER BY i) AS v, string_agg('- ' || x, chr(10) ORDER BY i) AS b, count(*) AS n, list(x ORDER BY i) AS a FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM
 (SELECT doc_id, x, i, row_number() OVER (PARTITION BY doc_id, lower(x) ORDER BY i) AS r FROM (SELECT doc_id, {trim('x')} AS x, i FROM ({source})) WHERE x <> '') WHERE r = 1) WHERE k <= {most} GROUP BY doc_id)"""


FLAGS = {"errors": P.ERROR, "commands": P.COMMAND, "stack_frames": P.STACK, "decisions": P.DECISION, "actions": P.ACTION, "risks": P.RISK, "questions": P.QUESTION}


@query("line_flags", f"WITH {LINES} SELECT doc_id, count(*) AS n_lines, {', '.join(f'count(*) FILTER ({has("x", p)}) AS {k}' for k, p in FLAGS.items())} FROM l GROUP BY doc_id")
def line_flags(t):
    return C.line_flags(t("documents"))


ROOT = "No clear error line detected. Use raw_log_url if the failure is hidden in omitted output."
HIT = lambda pattern: f"len(list_filter(coalesce(er.a, []), lambda x: {has('x', pattern)})) > 0"
PREP_LOGS = f"""WITH {LINES}, z AS (SELECT doc_id, {trim('x')} AS x, {trim("lead(x, 1, '') OVER (PARTITION BY doc_id ORDER BY i)")} AS nx, i FROM l),
{unique('er', f"SELECT doc_id, CASE WHEN nx <> '' AND length(nx) < 240 THEN x || chr(10) || nx ELSE x END AS x, i FROM z WHERE x <> '' AND {has('x', P.ERROR)}", 18)},
{unique('co', f"SELECT doc_id, x, i FROM z WHERE {has('x', P.COMMAND)}", 12)}, {unique('st', f"SELECT doc_id, x, i FROM l WHERE {has('x', P.STACK)}", 18)},
f0 AS (SELECT doc_id, regexp_extract_all(text, '{Q(P.FILE)}', 1) AS f FROM documents), {unique('fi', 'SELECT doc_id, unnest(f) AS x, generate_subscripts(f, 1) AS i FROM f0', 24)},
ta AS (SELECT doc_id, {trim("string_agg(x, chr(10) ORDER BY i)")} AS t FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) AS r FROM l) WHERE r <= 80 GROUP BY doc_id),
j AS (SELECT d.doc_id, d.text, coalesce(co.v, '') AS commands, coalesce(er.v, '') AS errors, coalesce(st.v, '') AS stack_frames, coalesce(fi.v, '') AS files, coalesce(er.n, 0) AS n_errors,
 coalesce(list_filter(er.a, lambda x: NOT {has('x', '(warning|deprecated|notice)')})[1], er.a[1], '{ROOT}') AS root_cause, {clamp('ta.t', 2500)} AS tail, co.b AS cb, er.b AS eb, st.b AS sb, fi.b AS fb,
 list_filter(['Re-run the smallest failing command, not the whole pipeline.', 'Inspect the first real error before later cascading failures.', CASE WHEN fi.n > 0 THEN 'Open impacted files first: ' || array_to_string(fi.a[1:5], ', ') END,
 CASE WHEN {HIT('timeout|timed out')} THEN 'Check whether this is a real failure or an infra/network timeout.' END, CASE WHEN {HIT('permission|denied|eacces')} THEN 'Check file permissions, env vars, and service user before changing app code.' END,
 CASE WHEN {HIT('not found|cannot find')} THEN 'Check missing dependency/path/import before editing business logic.' END], lambda x: x IS NOT NULL) AS ch
 FROM documents d LEFT JOIN er USING (doc_id) LEFT JOIN co USING (doc_id) LEFT JOIN st USING (doc_id) LEFT JOIN fi USING (doc_id) LEFT JOIN ta USING (doc_id)),
k AS (SELECT *, concat_ws(chr(10) || chr(10), 'Context: build/test/runtime logs', 'Failing / relevant commands:' || chr(10) || cb, 'Likely root cause:' || chr(10) || root_cause, 'Top errors:' || chr(10) || eb, 'Stack frames:' || chr(10) || sb,
 'Impacted files:' || chr(10) || fb, 'Suggested next checks:' || chr(10) || array_to_string(list_transform(ch, lambda x: '- ' || x), chr(10)), 'Log tail:' || chr(10) || tail) AS full_text FROM j), m AS (SELECT *, {clamp('full_text', 8000)} AS compact FROM k),
n AS (SELECT *, {tokens('text')} AS raw_tokens, {tokens('compact')} AS compact_tokens FROM m)
SELECT doc_id, commands, errors, stack_frames, files, root_cause, array_to_string(ch, '␟') AS checks, tail, compact, raw_tokens, compact_tokens, greatest(0, raw_tokens - compact_tokens) AS saved_tokens, {pct('raw_tokens', 'compact_tokens')} AS savings_pct,
 CAST(CASE WHEN n_errors = 0 THEN 0.08 WHEN n_errors > 14 THEN 0.05 ELSE 0.02 END AS DOUBLE) AS uncertainty FROM n"""


@query("prep_logs", PREP_LOGS)
def prep_logs(t):
    out = C.log_summary(t("documents"))
    return out.select(*(joined_list(c) if kind.startswith("array") else c for c, kind in out.dtypes))


NORM = "regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(9), ' '), '[ \\x{00a0}]{2,}', ' ', 'g'), '\\n{4,}', chr(10) || chr(10) || chr(10), 'g')"
ANY = " OR ".join(has("x", p) for p in (P.DECISION, P.ACTION, P.RISK, P.QUESTION))
PART = lambda title, c: f"'{title}:' || chr(10) || {c}.b"
PREP_TEXT = f"""WITH d AS (SELECT doc_id, {trim(NORM)} AS norm FROM documents),
l0 AS (SELECT doc_id, unnest(string_split(norm, chr(10))) AS x, generate_subscripts(string_split(norm, chr(10)), 1) AS i FROM d),
l AS (SELECT * FROM (SELECT doc_id, {trim('x')} AS x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM l0 WHERE {trim('x')} <> '') WHERE i <= 400),
{unique('su', f"SELECT doc_id, x, i FROM l WHERE i <= 4 UNION ALL SELECT doc_id, x, i + 1000 FROM l WHERE length(x) >= 12 AND ({ANY})", 8)},
{unique('de', f"SELECT doc_id, x, i FROM l WHERE {has('x', P.DECISION)}", 10)}, {unique('ac', f"SELECT doc_id, x, i FROM l WHERE {has('x', P.ACTION)}", 16)},
{unique('qu', f"SELECT doc_id, x, i FROM l WHERE {has('x', P.QUESTION)}", 10)}, {unique('ri', f"SELECT doc_id, x, i FROM l WHERE {has('x', P.RISK)}", 10)},
j AS (SELECT d.*, {clamp('norm', 3150)} AS carry FROM d),
k AS (SELECT doc_id, norm, carry, coalesce(su.v, '') AS summary, coalesce(de.v, '') AS decisions, coalesce(ac.v, '') AS actions, coalesce(qu.v, '') AS questions, coalesce(ri.v, '') AS risks,
 concat_ws(chr(10) || chr(10), 'Purpose: compact long text for frontier model context', 'Summary:' || chr(10) || coalesce(su.b, '- No strong summary lines detected.'), {PART('Decisions', 'de')}, {PART('Action items', 'ac')}, {PART('Open questions', 'qu')}, {PART('Risks / blockers', 'ri')}, 'Carry-forward context:' || chr(10) || carry) AS full_text
 FROM j LEFT JOIN su USING (doc_id) LEFT JOIN de USING (doc_id) LEFT JOIN ac USING (doc_id) LEFT JOIN qu USING (doc_id) LEFT JOIN ri USING (doc_id)),
m AS (SELECT *, {clamp('full_text', 7000)} AS compact FROM k), n AS (SELECT *, {tokens('norm')} AS raw_tokens, {tokens('compact')} AS compact_tokens FROM m)
SELECT doc_id, summary, decisions, actions, questions, risks, carry, compact, raw_tokens, compact_tokens, greatest(0, raw_tokens - compact_tokens) AS saved_tokens, {pct('raw_tokens', 'compact_tokens')} AS savings_pct FROM n"""


@query("prep_text", PREP_TEXT)
def prep_text(t):
    out = C.text_summary(t("documents"))
    return out.select(*(joined_list(c) if kind.startswith("array") else c for c, kind in out.dtypes))


TERMS = ("root", "cause", "the")
SCORE = " + ".join([f"8 * h + CASE WHEN h >= 2 THEN 8 ELSE 0 END", *(f"CASE WHEN {has('x', p) if not p.startswith('(?m)') else f'''regexp_matches(x, '(?im){Q(p[4:])}')'''} THEN {w} ELSE 0 END" for p, w in P.UNIT_SCORES), "greatest(0.0, 2 - (i - 1) * 0.05::DOUBLE)"])
COMPRESS = f"""WITH RECURSIVE d AS (SELECT doc_id, text AS norm, {tokens('text')} AS raw_tokens, greatest(32, CAST(floor({tokens('text')} * 0.35::DOUBLE) AS BIGINT)) AS target FROM documents),
p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(norm, '\\n{{2,}}'), lambda x: {trim('x')}), lambda x: x <> '') AS ps, list_filter(list_transform(string_split(norm, chr(10)), lambda x: {trim('x')}), lambda x: x <> '') AS ls FROM d),
u AS (SELECT doc_id, unnest(CASE WHEN len(ps) >= 4 THEN ps ELSE ls END) AS x, generate_subscripts(CASE WHEN len(ps) >= 4 THEN ps ELSE ls END, 1) AS i FROM p),
h AS (SELECT *, {' + '.join(f"CAST(contains(lower(x), '{t}') AS INT)" for t in TERMS)} AS h, {tokens('x')} AS tok, {has('x', P.CRITICAL)} AS critical, {has('x', P.NOISE)} AS noise FROM u),
s AS (SELECT *, {SCORE} AS score FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS k FROM s),
f AS (SELECT doc_id, target, 0::BIGINT AS k, 0::BIGINT AS total, FALSE AS done, 0 AS n, FALSE AS took FROM d UNION ALL
 SELECT f.doc_id, f.target, r.k, CASE WHEN t THEN total + tok ELSE total END, done OR (t AND total + tok >= target), CASE WHEN t THEN n + 1 ELSE n END, t FROM f JOIN
 (SELECT *, 1 AS one FROM r) r ON r.doc_id = f.doc_id AND r.k = f.k + 1, LATERAL (SELECT NOT (done OR noise OR score <= 0 OR (n > 0 AND total + tok > target AND NOT (critical AND total < ceil(target * 1.25)))) AS t)),
w AS (SELECT r.* FROM f JOIN r USING (doc_id, k) WHERE took UNION ALL SELECT r.* FROM r WHERE k = 1 AND doc_id NOT IN (SELECT doc_id FROM f WHERE took)),
c AS (SELECT doc_id, count(*) AS units_kept, count(*) FILTER (critical) AS critical_kept, string_agg(x, chr(10) || chr(10) ORDER BY i) AS compact FROM w GROUP BY doc_id),
o AS (SELECT d.doc_id, raw_tokens, (SELECT count(*) FROM u WHERE u.doc_id = d.doc_id) AS units_total, coalesce(units_kept, 0) AS units_kept, coalesce(critical_kept, 0) AS critical_kept, coalesce(compact, '') AS compact FROM d LEFT JOIN c USING (doc_id)),
q AS (SELECT *, {tokens('compact')} AS compact_tokens FROM o)
SELECT doc_id, units_total, units_kept, critical_kept, raw_tokens, compact_tokens, greatest(0, raw_tokens - compact_tokens) AS saved_tokens, {pct('raw_tokens', 'compact_tokens')} AS savings_pct, compact FROM q"""


@query("compress_context", COMPRESS)
def compress_context(t):
    return C.compress(t("documents"), TERMS)


NORMAL = lambda x: f"CASE WHEN regexp_matches(regexp_replace({trim(x)}, '\\s+', ' ', 'g'), '^(?:[{{}}()\\[\\];,]+|//.*|/\\*.*|\\*.*|#.*)$') THEN '' ELSE regexp_replace({trim(x)}, '\\s+', ' ', 'g') END"


@query(
    "agg_duplicate_blocks",
    f"""WITH {LINES}, c AS (SELECT doc_id, i, {NORMAL('x')} AS x FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM c WHERE x <> ''),
b AS (SELECT doc_id, i, list(x) OVER w AS b FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
h AS (SELECT doc_id, i, substr(sha256(array_to_string(b, chr(10))), 1, 16) AS hash FROM b WHERE len(b) = 3 AND len(list_distinct(b)) >= 3 AND length(array_to_string(b, chr(10))) >= 80),
p AS (SELECT hash, doc_id, count(*) AS n, min(i) AS line FROM h GROUP BY ALL)
SELECT hash, count(*) AS documents, CAST(sum(n) AS BIGINT) AS occurrences, min(doc_id) AS first_doc, min_by(line, doc_id) AS first_line FROM p GROUP BY hash HAVING count(*) > 1""",
)
def agg_duplicate_blocks(t):
    return C.duplicate_blocks(t("documents"), 3)


OUTPUTS = {"first200": "substr(text, 1, 200)", "first1k": "substr(text, 1, 1000)", "passthrough": "text", "ws_collapse": "regexp_replace(text, '\\s+', ' ', 'g')"}
RUNS = "r0 AS (" + " UNION ALL ".join(f"SELECT '{n}' AS compressor, doc_id, length(text) AS input_size, {x} AS out, run FROM documents, range(1, 3) g(run)" for n, x in OUTPUTS.items()) + "), r AS (SELECT *, CASE WHEN input_size > 0 THEN length(out) / input_size::DOUBLE ELSE 0.0 END AS ratio, md5(out) AS md5 FROM r0)"
GROUPED = "SELECT {k}, count(*) AS n, avg(ratio) AS mean, coalesce(CASE WHEN count(*) > 1 THEN stddev_samp(ratio) END, 0.0) AS stdev, min(ratio) AS least, max(ratio) AS most FROM r GROUP BY {k}"
VERDICT = "SELECT *, CASE WHEN mean > 0 THEN stdev / mean ELSE 0.0 END AS cv, CASE WHEN CASE WHEN mean > 0 THEN stdev / mean ELSE 0.0 END > 0.05 THEN 'FAIL_STOCHASTIC' WHEN mean > 0.70 THEN 'FAIL_NO_SAVING' ELSE 'PASS' END AS verdict FROM ({g})"


@query("agg_compression", f"WITH {RUNS} {VERDICT.format(g=GROUPED.format(k='compressor, doc_id'))}")
def agg_compression(t):
    return C.aggregate_compression(C.compressor_runs(t("documents")), ["compressor", "doc_id"])


@query("agg_corpus", f"WITH {RUNS}, v AS ({VERDICT.format(g=GROUPED.format(k='compressor, doc_id'))}) SELECT compressor, count(*) AS fixtures, avg(mean) AS mean_of_means, median(mean) AS median_of_means, avg(CASE WHEN verdict = 'PASS' THEN 1.0 ELSE 0.0 END) AS pass_rate FROM v GROUP BY compressor")
def agg_corpus(t):
    return C.corpus_report(C.aggregate_compression(C.compressor_runs(t("documents")), ["compressor", "doc_id"]))


@query("agg_partition_samples", f"WITH {RUNS} SELECT coalesce(split_part(doc_id || '#r' || run, '#', 1), 'unknown') AS sample_group, count(*) AS runs, avg(ratio) AS mean FROM r GROUP BY 1")
def agg_partition_samples(t):
    runs = C.compressor_runs(t("documents"))
    return runs.groupBy(C.sample_group(F.col("sample_id")).alias("sample_group")).agg(F.count("*").alias("runs"), F.avg("ratio").alias("mean"))


STABLE = f"WITH {RUNS}, s AS (SELECT compressor, doc_id, count(*) AS n, count(DISTINCT md5) AS unique_md5, min_by(md5, run) AS first_md5 FROM r GROUP BY ALL HAVING count(*) >= 2)"


@query("agg_stability", f"{STABLE} SELECT *, unique_md5 = 1 AS stable FROM s")
def agg_stability(t):
    return C.stability(C.compressor_runs(t("documents")), ["compressor", "doc_id"])


@query("agg_cache_score", f"{STABLE} SELECT compressor, avg(CASE WHEN unique_md5 = 1 THEN 1.0 ELSE 0.0 END) AS cache_score FROM s GROUP BY compressor")
def agg_cache_score(t):
    return C.stability(C.compressor_runs(t("documents")), ["compressor", "doc_id"]).groupBy("compressor").agg(F.avg(F.col("stable").cast("double")).alias("cache_score"))


@query(
    "win_context",
    f"WITH {LINES}, h AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rank FROM l WHERE contains(lower(x), 'with')) SELECT h.doc_id, h.rank, h.i AS line, string_agg(l.x, chr(10) ORDER BY l.i) AS context FROM h JOIN l ON l.doc_id = h.doc_id AND l.i BETWEEN h.i - 3 AND h.i + 3 WHERE rank <= 3 GROUP BY ALL",
)
def win_context(t):
    return C.windowed_context(t("documents"), "with")


@query(
    "win_gaps_islands",
    f"""WITH {LINES}, n AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id), s AS (SELECT l.doc_id, i, greatest(1, i - 3) AS s, least(n, i + 3) AS e FROM l JOIN n USING (doc_id) WHERE {has('x', 'tion that')}),
g AS (SELECT *, coalesce(s > max(e) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, TRUE) AS new FROM s), r AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS range FROM g)
SELECT doc_id, CAST(range AS BIGINT) AS range, min(s) AS start_line, max(e) AS end_line, count(*) AS matches FROM r GROUP BY doc_id, range""",
)
def win_gaps_islands(t):
    return C.merged_ranges(t("documents"), "tion that")


@query(
    "fn_token_estimates",
    f"""SELECT doc_id, {tokens('text')} AS plain, greatest(1, CAST(ceil((length(text) - length(regexp_replace(text, '[А-Яа-яЁё]', '', 'g'))) / 2.5 + length(regexp_replace(text, '[А-Яа-яЁё]', '', 'g')) / 4.0) AS BIGINT)) AS mixed, CAST(ceil(length(text) / 4.0) AS BIGINT) AS flat,
 substr(sha256(text), 1, 16) AS hash, 'text-' || substr(sha256(text), 1, 20) AS artifact, {clamp('text', 600)} AS clamped, CASE WHEN length(text) <= 300 THEN text ELSE substr(text, 1, 276) || '…' END AS cut FROM documents""",
)
def fn_token_estimates(t):
    x = F.col("text")
    return t("documents").select("doc_id", T.estimate_tokens(x).alias("plain"), T.estimate_tokens_mixed(x).alias("mixed"), T.estimate_tokens_flat(x).alias("flat"), T.stable_hash(x).alias("hash"), T.artifact_key("text", x).alias("artifact"), T.clamp_head_tail(x, 600).alias("clamped"), T.clamp_cut(x, 300, 24, "…").alias("cut"))
