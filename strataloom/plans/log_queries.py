"""Log analytics on events (requests) and conversations (sessions)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.functions import text as T
from strataloom.operators import logs as L

from .registry import query
from .text_queries import tokens


def calls(t) -> DataFrame:
    """events as a request log: tokens from props, service from the user, sources in turn."""
    k = F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(0.0))
    e = t("events")
    i = F.col("event_id")
    source = F.element_at(F.array(*map(F.lit, ("codex-cli", "golden-run", "smoke-loop", "cursor", "other"))), (i % 5 + 1).cast("int"))
    return e.select(
        i.alias("call_id"), "ts", F.concat(F.lit("service-"), (F.col("user_id") % 20).cast("string")).alias("service"), F.col("event_type").alias("tool"), source.alias("source"), L.infer_surface(source).alias("surface"),
        F.when(i % 11 != 0, F.col("event_type") != "error").alias("ok"), F.col("value").alias("duration_ms"), k.alias("raw_tokens"), F.floor(k / 3).cast("double").alias("compact_tokens"), F.when(i % 2 == 0, k - F.floor(k / 3)).otherwise(0.0).cast("double").alias("saved_tokens"),
        F.when(i % 13 == 0, 0.05).otherwise(0.01).alias("uncertainty"), (F.col("user_id") % 50).alias("session_id"),
    )


CALLS = """c0 AS (SELECT *, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) AS k, ['codex-cli', 'golden-run', 'smoke-loop', 'cursor', 'other'][event_id % 5 + 1] AS source FROM events),
c AS (SELECT event_id AS call_id, ts, 'service-' || (user_id % 20) AS service, event_type AS tool, source, CASE WHEN contains(source, 'codex') THEN 'codex' WHEN contains(source, 'cursor') THEN 'cursor' END AS surface,
 CASE WHEN event_id % 11 <> 0 THEN event_type <> 'error' END AS ok, value AS duration_ms, k AS raw_tokens, floor(k / 3) AS compact_tokens, CASE WHEN event_id % 2 = 0 THEN k - floor(k / 3) ELSE 0.0 END AS saved_tokens,
 CASE WHEN event_id % 13 = 0 THEN 0.05 ELSE 0.01 END AS uncertainty, user_id % 50 AS session_id, coalesce(CASE WHEN event_id % 11 <> 0 THEN event_type <> 'error' END, TRUE) AS good FROM c0)"""
R = lambda x, d: f"floor({x} * {10.0**d} + 0.5) / {10.0**d}"
RAW, SMALL, SAVED = (f"sum(CASE WHEN good THEN {x} ELSE 0.0 END)" for x in ("raw_tokens", "compact_tokens", "saved_tokens"))
METRICS = f"""count(*) AS calls, count(*) FILTER (good) AS ok_calls, count(*) FILTER (NOT good) AS failed_calls, {RAW} AS raw_tokens, {SMALL} AS compact_tokens, {SAVED} AS saved_tokens,
 CASE WHEN {RAW} > 0 THEN {R(f'({RAW} - {SMALL}) / {RAW} * 100.0', 1)} ELSE 0.0 END AS savings_pct, CASE WHEN {RAW} > 0 THEN {R(f'{SAVED} / {RAW} * 100.0', 1)} ELSE 0.0 END AS saved_pct, {R(f'{SAVED} / 1e6 * 3.0', 4)} AS saved_usd,
 coalesce(quantile_disc(duration_ms, 0.5), 0) AS p50_ms, coalesce(quantile_disc(duration_ms, 0.95), 0) AS p95_ms, coalesce(max(duration_ms), 0) AS max_ms"""


@query("agg_measurement", f"WITH {CALLS} SELECT {METRICS} FROM c")
def agg_measurement(t):
    return L.measure(calls(t))


@query("agg_measurement_by_tool", f"WITH {CALLS} SELECT tool, {METRICS} FROM c GROUP BY tool")
def agg_measurement_by_tool(t):
    return L.measure(calls(t), ["tool"])


@query("agg_count_by", "SELECT coalesce(event_type, 'unknown') AS event_type, count(*) AS n FROM events GROUP BY 1")
def agg_count_by(t):
    return L.count_by(t("events"), "event_type")


@query("agg_percentiles", f"""WITH {CALLS}, r AS (SELECT service, duration_ms, row_number() OVER (PARTITION BY service ORDER BY duration_ms) - 1 AS r, count(*) OVER (PARTITION BY service) AS n FROM c)
SELECT service, max(CASE WHEN r = least(n - 1, floor(n * 0.5)) THEN duration_ms END) AS floor_p50, max(CASE WHEN r = least(n - 1, floor(n * 0.95)) THEN duration_ms END) AS floor_p95, quantile_disc(duration_ms, 0.5) AS nearest_p50, quantile_disc(duration_ms, 0.95) AS nearest_p95 FROM r GROUP BY service""")
def agg_percentiles(t):
    c = calls(t)
    near = c.groupBy("service").agg(L.nearest_rank("duration_ms", 0.5).alias("nearest_p50"), L.nearest_rank("duration_ms", 0.95).alias("nearest_p95"))
    return L.floor_rank(c, ["service"], "duration_ms", {"floor_p50": 0.5, "floor_p95": 0.95}).join(near, "service")


TRAFFIC = "CASE WHEN contains(lower(coalesce(source, '') || ' ' || coalesce(surface, '')), 'golden') THEN 'benchmark' WHEN contains(lower(coalesce(source, '')), 'smoke') THEN 'proof' WHEN source IN ('codex-cli', 'cursor') THEN 'production_like' ELSE 'unknown' END"


def feedback(t) -> DataFrame:
    """Every 17th call's feedback; the even ones name no source."""
    c = calls(t).filter(F.col("call_id") % 17 == 0)
    i = F.col("call_id")
    return c.select("call_id", F.when(i % 2 == 1, F.col("source")).alias("source"), F.when(i % 2 == 1, F.col("surface")).alias("surface"), F.when(i % 3 == 0, "partial").otherwise("helpful").alias("outcome"), (i % 4 == 0).alias("had_to_search"))


@query("agg_retrieval_measurement", f"""WITH {CALLS}, d AS (SELECT *, {TRAFFIC} AS traffic FROM c), m AS (SELECT traffic, {METRICS} FROM d GROUP BY traffic),
f AS (SELECT traffic, count(*) AS feedback_count, count(*) FILTER (call_id % 3 = 0) AS miss_or_partial_count, count(*) FILTER (call_id % 4 = 0) AS search_count FROM d WHERE call_id % 17 = 0 GROUP BY traffic)
SELECT m.*, coalesce(feedback_count, 0) AS feedback_count, coalesce(miss_or_partial_count, 0) AS miss_or_partial_count, coalesce(search_count, 0) AS search_count, {R('coalesce(feedback_count, 0) / calls * 100.0', 1)} AS feedback_coverage_pct FROM m LEFT JOIN f USING (traffic)""")
def agg_retrieval_measurement(t):
    return L.measure_by_class(calls(t), feedback(t))


@query("fn_traffic_class", f"WITH {CALLS} SELECT {TRAFFIC} AS by_use, {TRAFFIC} AS by_origin, coalesce(surface, '-') AS surface, count(*) AS n FROM c GROUP BY ALL")
def fn_traffic_class(t):
    s, u, tool = F.col("source"), F.col("surface"), F.col("tool")
    return calls(t).groupBy(L.traffic_class(s, u, tool).alias("by_use"), L.traffic_class_by_origin(s, u, tool).alias("by_origin"), F.coalesce("surface", F.lit("-")).alias("surface")).agg(F.count("*").alias("n"))


def turns(t) -> DataFrame:
    """conversations as trace events."""
    raw = T.estimate_tokens("text").cast("double")
    i = F.col("conv_id") + F.col("turn")
    return t("conversations").select(
        F.col("conv_id").alias("session_id"), F.timestamp_seconds(F.col("conv_id") * 3600 + F.col("turn") * 60).alias("ts"), F.when(i % 7 != 0, F.col("role")).alias("source"), (i % 5 != 0).alias("ok"),
        F.when(i % 6 == 0, 0.05).otherwise(0.02).alias("uncertainty"), raw.alias("raw_tokens"), F.floor(raw / 2).cast("double").alias("compact_tokens"), F.when(F.col("conv_id") % 2 == 0, raw - F.floor(raw / 2)).otherwise(0.0).cast("double").alias("saved_tokens"),
    )


TURNS = f"""t0 AS (SELECT *, ({tokens("coalesce(text, '')")})::DOUBLE AS raw, conv_id + turn AS i FROM conversations),
t AS (SELECT conv_id AS session_id, make_timestamp((conv_id * 3600 + turn * 60) * 1000000) AS ts, CASE WHEN i % 7 <> 0 THEN role END AS source, i % 5 <> 0 AS ok, CASE WHEN i % 6 = 0 THEN 0.05 ELSE 0.02 END AS uncertainty, raw AS raw_tokens, floor(raw / 2) AS compact_tokens, CASE WHEN conv_id % 2 = 0 THEN raw - floor(raw / 2) ELSE 0.0 END AS saved_tokens FROM t0),
b AS (SELECT session_id, coalesce(source, 'unknown') AS source, count(*) AS n FROM t GROUP BY ALL), bs AS (SELECT session_id, string_agg(source || '=' || n, ',' ORDER BY n DESC, source) AS by_source FROM b GROUP BY session_id),
s0 AS (SELECT session_id, count(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (uncertainty > 0.03) AS uncertain, count(*) FILTER (source IS NULL) AS unknown_source, sum(raw_tokens) AS raw_tokens, sum(compact_tokens) AS compact_tokens,
 coalesce(nullif(sum(saved_tokens), 0), greatest(0, sum(raw_tokens) - sum(compact_tokens))) AS saved_tokens FROM t GROUP BY session_id),
s AS (SELECT s0.*, by_source, CASE WHEN raw_tokens > 0 THEN {R('saved_tokens / raw_tokens * 100.0', 1)} ELSE 0.0 END AS saved_pct FROM s0 JOIN bs USING (session_id))"""


@query("agg_session_rollup", f"WITH {TURNS} SELECT * REPLACE (epoch(first_ts)::BIGINT AS first_ts, epoch(last_ts)::BIGINT AS last_ts) FROM s")
def agg_session_rollup(t):
    return L.sessions(turns(t)).withColumns({"first_ts": F.unix_timestamp("first_ts"), "last_ts": F.unix_timestamp("last_ts")})


def _gone(a: str, b: str) -> str:
    names = lambda x: f"list_filter(list_transform(string_split({x}.by_source, ','), lambda v: split_part(v, '=', 1)), lambda v: v <> 'unknown')"
    return f"array_to_string(list_sort(list_filter({names(a)}, lambda w: NOT list_contains({names(b)}, w))), ',')"


@query("agg_session_diff", f"""WITH {TURNS} SELECT {', '.join(f'c.{x} - b.{x} AS d_{x}' for x in ('events', 'failed', 'uncertain', 'unknown_source', 'saved_tokens', 'saved_pct'))}, {_gone('c', 'b')} AS added_sources, {_gone('b', 'c')} AS removed_sources,
 c.failed > b.failed AS more_failures, c.uncertain > b.uncertain AS more_uncertain, c.saved_tokens < b.saved_tokens AS fewer_saved, c.unknown_source > b.unknown_source AS more_unknown FROM s b, s c WHERE b.session_id = 1 AND c.session_id = 2""")
def agg_session_diff(t):
    return L.session_diff(L.sessions(turns(t)), 1, 2)


WINDOW = ("2024-01-05", "2024-01-06")


@query("agg_window_export", f"WITH {CALLS} SELECT count(*) AS events, count(DISTINCT session_id) AS sessions, count(*) FILTER (NOT good) AS failed, sum(saved_tokens) AS saved_tokens FROM c WHERE ts >= TIMESTAMP '{WINDOW[0]}' AND ts < TIMESTAMP '{WINDOW[1]}'")
def agg_window_export(t):
    return L.window_export(calls(t), *WINDOW)


@query("agg_service_rollup", f"WITH {CALLS}, d AS (SELECT *, {TRAFFIC} AS traffic FROM c) SELECT service, {METRICS}, count(*) FILTER (NOT good AND traffic <> 'proof') AS actionable_errors, count(*) FILTER (NOT good AND traffic = 'proof') AS proof_errors, count(*) FILTER (uncertainty > 0.03 AND traffic <> 'proof') AS actionable_uncertain, count(*) FILTER (uncertainty > 0.03 AND traffic = 'proof') AS proof_uncertain, count(DISTINCT tool) AS tools FROM d GROUP BY service")
def agg_service_rollup(t):
    return L.service_rollup(calls(t).withColumn("traffic", L.traffic_class(F.col("source"), F.col("surface"), F.col("tool"))))


@query("recommendations", f"""WITH {CALLS}, d AS (SELECT *, {TRAFFIC} AS traffic FROM c), s AS (SELECT service, {METRICS}, count(*) FILTER (NOT good AND traffic <> 'proof') AS actionable_errors, count(*) FILTER (uncertainty > 0.03 AND traffic <> 'proof') AS actionable_uncertain FROM d GROUP BY service)
SELECT service, 'fix failing calls' AS recommendation FROM s WHERE actionable_errors > 0 UNION ALL SELECT service, 'look at slow calls' FROM s WHERE p95_ms > 100 UNION ALL SELECT service, 'raise savings' FROM s WHERE savings_pct < 10 UNION ALL SELECT service, 'review uncertain answers' FROM s WHERE actionable_uncertain > 0""")
def recommendations(t):
    return L.recommendations(L.service_rollup(calls(t).withColumn("traffic", L.traffic_class(F.col("source"), F.col("surface"), F.col("tool")))))


@query("agg_rollup_by", f"""WITH {CALLS}, r AS (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY duration_ms) - 1 AS r, count(*) OVER (PARTITION BY tool) AS n FROM c)
SELECT tool, count(*) AS requests, count(*) FILTER (good) AS ok_count, count(*) FILTER (NOT good) AS errors, sum(saved_tokens) AS saved_tokens, CASE WHEN sum(raw_tokens) > 0 THEN {R('sum(saved_tokens) / sum(raw_tokens) * 100.0', 1)} ELSE 0.0 END AS savings_pct, max(CASE WHEN r = least(n - 1, floor(n * 0.95)) THEN duration_ms END) AS p95_ms FROM r GROUP BY tool""")
def agg_rollup_by(t):
    return L.rollup_by(calls(t), "tool")


RANGE = ("2024-01-01", "2024-02-05")
DAYS = f"d AS (SELECT CAST(g.d AS DATE) AS day, count(call_id) AS calls, count(*) FILTER (NOT good) AS failed, count(DISTINCT service) AS services, coalesce(sum(raw_tokens), 0) AS raw_tokens, coalesce(sum(saved_tokens), 0) AS saved_tokens FROM generate_series(DATE '{RANGE[0]}', DATE '{RANGE[1]}', INTERVAL 1 DAY) g(d) LEFT JOIN c ON CAST(c.ts AS DATE) = CAST(g.d AS DATE) GROUP BY 1)"


@query("agg_daily", f"WITH {CALLS}, {DAYS} SELECT * FROM d")
def agg_daily(t):
    return L.days(calls(t), *RANGE)


@query("agg_weekly", f"""WITH {CALLS}, {DAYS}, w AS (SELECT day, CAST(sum(calls) OVER w AS BIGINT) AS calls, CAST(sum(failed) OVER w AS BIGINT) AS failed, sum(raw_tokens) OVER w AS raw_tokens, sum(saved_tokens) OVER w AS saved_tokens, max(services) OVER w AS most_services, count(*) FILTER (calls > 0) OVER w AS active_days FROM d WINDOW w AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
SELECT *, CASE WHEN calls > 0 THEN {R('failed / calls * 100.0', 1)} ELSE 0.0 END AS failed_pct, CASE WHEN raw_tokens > 0 THEN {R('saved_tokens / raw_tokens * 100.0', 1)} ELSE 0.0 END AS saved_pct FROM w""")
def agg_weekly(t):
    return L.weeks(L.days(calls(t), *RANGE))


@query("agg_review_queue", f"""WITH {CALLS}, i AS (SELECT 'P0' AS priority, service, 'failure' AS kind, ts FROM c WHERE NOT good UNION ALL SELECT 'P1', service, 'slow', ts FROM c WHERE duration_ms >= 1000 UNION ALL SELECT 'P2', service, 'uncertain', ts FROM c WHERE uncertainty > 0.03)
SELECT priority, service, kind, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS days, floor(epoch(min(ts)))::BIGINT AS first_ts FROM i GROUP BY ALL""")
def agg_review_queue(t):
    return L.review_queue(calls(t)).withColumn("first_ts", F.unix_timestamp("first_ts"))


@query("agg_readiness_gates", f"""WITH {CALLS}, {DAYS}, s AS (SELECT count(*) FILTER (calls > 0) AS active, sum(calls) AS calls, sum(failed) AS failed, sum(saved_tokens) AS saved FROM d),
g AS (SELECT 'active_days' AS gate, active >= 5 AS passed FROM s UNION ALL SELECT 'calls', calls >= 100 FROM s UNION ALL SELECT 'failures', 100 * failed <= 10.0 * calls FROM s UNION ALL SELECT 'savings', saved > 0 FROM s)
SELECT *, CASE WHEN (SELECT bool_and(passed) FROM g) THEN 'ready' ELSE 'not_ready' END AS verdict FROM g""")
def agg_readiness_gates(t):
    return L.readiness(L.days(calls(t), *RANGE))
