"""Queries for what larger operators are made of, and for the tools that put several of them together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from strataloom.operators import evidence as E
from strataloom.operators import raster as X
from strataloom.operators import retrieve as R
from strataloom.operators import review_plans as L
from strataloom.operators import stats as S
from strataloom.operators import vision as V
from strataloom.session import spread

from . import code_queries, diff_queries, log_queries, misc_queries, scalar_queries, screen_queries, stats_queries, text_queries, tool_queries  # noqa: F401
from .registry import QUERIES, SQL, query
from .stats_queries import ERF

K = lambda: F.col("p_partkey")


def part_of_ranks(name: str, *columns: str):
    """Some columns of the ranked files, by a scan of the texts."""
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) if c == "lines" else F.col(c)
    query(name, f"SELECT {', '.join(columns)} FROM ({SQL['retrieve_context']})")(lambda t: misc_queries.ranked(t).select(*map(listed, columns)))


part_of_ranks("fn_content_score", "path", "content_score", "lines")
part_of_ranks("fn_hint_boost", "path", "hint_score", "changed_score")
part_of_ranks("set_union_hints", "path", "hint_score")
part_of_ranks("topk_files", "path", "score")


def view(name: str, of: str, *columns: str):
    """Some columns of another query; what they do not need is pruned from its plan."""
    build = QUERIES[of]
    QUERIES[name] = lambda spark, sf_dir: build(spark, sf_dir).select(*columns)
    SQL[name] = f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({SQL[of]})"


view("fn_extract_files", "prep_logs", "doc_id", "files")
view("fn_root_cause", "prep_logs", "doc_id", "root_cause")
view("fn_next_checks", "prep_logs", "doc_id", "checks")
view("fn_prep_uncertainty", "prep_logs", "doc_id", "uncertainty")
view("fn_attach_stats", "prep_text", "doc_id", "raw_tokens", "compact_tokens", "saved_tokens", "savings_pct")
view("topk_units_budget", "compress_context", "doc_id", "units_total", "units_kept", "critical_kept")
view("fn_graph_symbol_score", "graph_find_symbol", "symbol", "kind", "path", "line", "score")
view("topk_symbols", "graph_find_symbol", "symbol", "path", "line", "score")
view("fn_group_name", "topk_per_group", "path", "group")
view("agg_percentile_nearest", "agg_percentiles", "service", "nearest_p50", "nearest_p95")
view("agg_percentile_floor", "agg_percentiles", "service", "floor_p50", "floor_p95")
view("agg_constant_hash", "agg_selector_miss", "user_id", "hashes", "constant_hash")
view("win_rank_first_match", "agg_recall_at_k", "case_id", "first_rank", "reciprocal")
view("join_golden_results", "agg_recall_at_k", "case_id", "expected", "recall5", "recall10")
view("join_symbols_files", "graph_index_summary", "kind", "symbols", "files")
view("win_sliding_block", "agg_duplicate_blocks", "hash", "documents", "occurrences", "first_doc", "first_line")
view("win_section", "agg_duplicate_sections", "hash", "files", "first_path", "first_line")
view("fn_exported_names", "agg_unused_exports", "path", "name")
view("fn_md_headings", "fn_headings", "path", "line", "level", "title")
view("fn_md_links", "fn_md_link_refs", "src", "line", "target", "anchor")
view("graph_find_refs", "join_refs_tokens", "token", "path", "line", "rank")
view("graph_outline", "graph_import_graph", "src", "targets")


def planned(name: str, steps: dict[str, L.Step], **kinds: tuple[str, str, str]):
    """A review plan over the findings of other queries: for each step the query, its target and its order, as SQL that both sides read."""
    builds = {kind: (QUERIES[of], target, order) for kind, (of, target, order) in kinds.items()}

    def build(spark, sf_dir):
        ordered = lambda order: [F.desc(x.split()[0]) if x.endswith(" DESC") else F.asc(x) for x in order.split(", ")]
        found = {kind: (f(spark, sf_dir), F.expr(target), ordered(order)) for kind, (f, target, order) in builds.items()}
        return L.plan(steps, found).select("place", "action", "target", F.array_join("proof", "; ").alias("proof"))

    QUERIES[name] = build
    parts = []
    for at, (kind, step) in enumerate((k, v) for k, v in steps.items() if k in kinds):
        of, target, order = kinds[kind]
        proof = "; ".join(step.proof)
        parts.append(f"SELECT {at} AS step, row_number() OVER (ORDER BY {order}) AS nth, '{step.action}' AS action, CAST({target} AS VARCHAR) AS target, '{proof}' AS proof FROM ({SQL[of]}) QUALIFY nth <= {step.most}")
    SQL[name] = f"SELECT row_number() OVER (ORDER BY step, nth) AS place, action, target, proof FROM ({' UNION ALL '.join(parts)})"


planned(
    "cleanup_plan", L.CLEANUP, dependencies=("join_dep_imports", "dependency_name", "package_file, dependency_type, dependency_name"), exports=("agg_unused_exports", "path || ':' || name", "path, name"),
    duplicates=("agg_duplicate_blocks", "hash", "occurrences DESC, hash"), cycles=("graph_cycles", "cycle", "cycle"), hotspots=("agg_complexity", "path", "score DESC, lines DESC, path"),
)
planned(
    "doc_plan", L.DOCUMENTS, links=("join_doc_links", "page_id || ' ' || target", "page_id, target"), anchors=("join_doc_anchors", "src || ':' || line || '#' || anchor", "src, line, anchor"), orphans=("join_orphans", "path", "path"),
    sections=("agg_duplicate_sections", "hash", "files DESC, hash"), references=("join_stale_refs", "src || ':' || line || ' ' || target", "src, line, target"),
)


def merged(name: str, **parts: tuple[str, str]):
    """One table (kind, item) of the findings of several queries; of each the SQL expression that names an item."""
    builds = {kind: (QUERIES[of], item) for kind, (of, item) in parts.items()}
    one = lambda spark, sf_dir, kind: builds[kind][0](spark, sf_dir).select(F.lit(kind).alias("kind"), F.expr(builds[kind][1]).cast("string").alias("item"))
    QUERIES[name] = lambda spark, sf_dir: reduce(lambda a, b: a.unionByName(b), (one(spark, sf_dir, kind) for kind in builds))
    SQL[name] = " UNION ALL ".join(f"SELECT '{kind}' AS kind, CAST({item} AS VARCHAR) AS item FROM ({SQL[of]})" for kind, (of, item) in parts.items())


merged("quality_gate_plan", over_budget=("agg_budget", "metric"), pressure=("agg_context_pressure", "pressure"), grown=("agg_snapshot_delta", "metric"))
merged("repo_map", file=("topk_per_group", "path"), symbol=("graph_find_symbol", "path || ':' || symbol"))
merged("agg_daily_weekly", day=("agg_daily", "calls"), week=("agg_weekly", "calls"))
merged("agg_doc_fact", heading=("fn_headings", "path || ':' || title"), marker=("pred_action_marker", "path || ':' || line"))


@query("agg_report", f"SELECT c.compressor, c.fixtures, 1 - c.mean_of_means AS b, s.cache_score AS k, c.pass_rate FROM ({SQL['agg_corpus']}) c JOIN ({SQL['agg_cache_score']}) s USING (compressor)")
def agg_report(t):
    """Byte saving and stability of each compressor."""
    c, s = text_queries.agg_corpus(t), text_queries.agg_cache_score(t)
    return c.join(s, "compressor").select("compressor", "fixtures", (1 - F.col("mean_of_means")).alias("b"), F.col("cache_score").alias("k"), "pass_rate")


@query("fn_normal_cdf", f"SELECT p_partkey, floor(CASE WHEN x >= 0 THEN 0.5 + {ERF} / 2 ELSE 0.5 - {ERF} / 2 END * 1e10 + 0.5) AS value FROM (SELECT p_partkey, (p_size - 25) / 8.0::DOUBLE AS x, abs((p_size - 25) / 8.0::DOUBLE) / sqrt(2.0) AS z FROM part)")
def fn_normal_cdf(t):
    return spread(t("part").select("p_partkey", "p_size")).select("p_partkey", F.floor(S.normal_cdf((F.col("p_size") - 25) / 8.0) * 1e10 + 0.5).cast("double").alias("value"))


@query("fn_add_days", "SELECT o_orderkey, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 - 20 AS INT) AS day FROM orders")
def fn_add_days(t):
    return t("orders").select("o_orderkey", F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 40 - 20).cast("int")).alias("day"))


@query("raster_mask_presets", "SELECT p_partkey AS x, p_size AS y FROM part WHERE NOT (p_partkey >= 0 AND p_partkey < 400 AND p_size >= 0 AND p_size < 50) AND NOT (p_partkey < 2000 AND p_size < 9)")
def raster_mask_presets(t):
    """Pixels outside the bands of two presets on an image of 2000 by 50."""
    image = t("part").sparkSession.createDataFrame([("i", 2000, 50, ["left_sidebar", "top_browser_chrome"])], "image string, width int, height int, presets array<string>")
    pixels = t("part").select(K().alias("x"), F.col("p_size").alias("y"))
    return X.outside(pixels, V.expand_presets(image).select("x0", "y0", "x1", "y1"))


TRACE, _ = tool_queries.line('{"type":"console","messageType":"error","text":"boom ⟨p_size⟩","time":⟨p_partkey + 9⟩}\n{"callId":"c","apiName":"page.click","startTime":5,"endTime":8}\n{"snapshot":{"_monotonicTime":7,"time":20,"request":{"url":"u⟨p_size⟩"},"response":{"status":⟨400 + p_partkey % 3 * 100⟩}}}')


@query("prepare_trace", "SELECT p_partkey AS run_id, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS console_errors, 1 AS failed_calls, 1 AS actions, CASE WHEN p_partkey % 2 = 0 THEN 'boom ' || p_size ELSE 'u' || p_size END AS first_failure, CASE WHEN p_partkey % 2 = 0 THEN p_partkey + 9 ELSE 27 END::DOUBLE AS at_ms FROM part")
def prepare_trace(t):
    raw = F.when(K() % 2 == 0, TRACE()).otherwise(F.substring_index(TRACE(), "\n", -2))
    return E.prepare(tool_queries.made(t, raw, "raw"), "run_id")


WORDS = ("running", "Queries", "users", "builder", "x1s", "sing", "classes", "planning")
STEMS = """CASE WHEN NOT regexp_matches(lower(w), '^[a-z]+$') THEN [w] ELSE list_filter([w, CASE WHEN ends_with(lower(w), 'ing') AND length(w) > 5 THEN lower(w)[:-4] END, CASE WHEN ends_with(lower(w), 'ing') AND length(w) > 5 AND lower(w)[-4] = lower(w)[-5] THEN lower(w)[:-5] END,
 CASE WHEN ends_with(lower(w), 'er') AND length(w) > 5 THEN lower(w)[:-3] END, CASE WHEN ends_with(lower(w), 'ies') AND length(w) > 5 THEN lower(w)[:-4] || 'y' END, CASE WHEN ends_with(lower(w), 's') AND length(w) > 4 THEN lower(w)[:-2] END], lambda x: x IS NOT NULL) END"""


@query("fn_variants", f"SELECT p_partkey, array_to_string({STEMS}, ',') AS value FROM (SELECT p_partkey, {list(WORDS)}[p_partkey % {len(WORDS)} + 1] AS w FROM part)")
def fn_variants(t):
    word = F.element_at(F.array(*map(F.lit, WORDS)), (K() % len(WORDS) + 1).cast("int"))
    return t("part").select("p_partkey", F.array_join(R.variants_of(word), ",").alias("value"))


@query("fn_compound_variants", "SELECT p_partkey, a || '-' || b || ',' || a || '_' || b || ',' || a || upper(b[1]) || b[2:] || ',' || upper(a[1]) || a[2:] || upper(b[1]) || b[2:] AS value FROM (SELECT p_partkey, lower(split_part(p_name, ' ', 1)) AS a, lower(p_brand) AS b FROM part)")
def fn_compound_variants(t):
    return t("part").select("p_partkey", F.array_join(R.compounds_of(F.substring_index("p_name", " ", 1), F.col("p_brand")), ",").alias("value"))


@query("fn_query_terms")  # stems, parts and order are beyond SQL: against the rules in Python in the tests
def fn_query_terms(t):
    return t("conversations").select("conv_id", "turn", R.query_terms_of(F.col("text")).alias("terms"))


@query("fn_query_plans")  # as fn_query_terms
def fn_query_plans(t):
    plan = F.pandas_udf(lambda s: s.map(lambda x: [f"{n}:{b}:{'|'.join(own)}" for n, b, own in R.plans(R.query_terms(x or ""))]), "array<string>")
    return t("part").select("p_partkey", plan(F.col("p_name")).alias("plans"))
