"""Analytics of append-only logs: counts, percentiles, sessions, services, days and weeks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.text import round_to

# What a source, surface or tool name says about its traffic.
SURFACES = ("claude", "codex", "cursor", "windsurf")
BENCHMARK_WORDS = ("golden", "benchmark", "bench", "from-traces", "trace-candidates", "dataset-runner", "regression")
PROOF_WORDS = ("smoke", "e2e", "proof", "test", "fixture")
CLASSES = ("production_like", "proof", "benchmark", "unknown")


def finite(x: Column) -> Column:
    """The number, or 0 where it is missing or no finite number."""
    x = x.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), 0.0).otherwise(x)


def label(x: Column, most: int = 80) -> Column:
    clean = F.substring(F.trim(x), 1, most)
    return F.when(clean != "", clean)


def infer_surface(source: Column) -> Column:
    out, low = F.when(F.lit(False), ""), F.lower(F.coalesce(source, F.lit("")))
    for name in SURFACES:
        out = out.when(low.contains(name), name)
    return out


def _any(low: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def traffic_class(source: Column, surface: Column, tool: Column | None = None, explicit: Column | None = None) -> Column:
    """benchmark before proof before production_like; a valid explicit class wins."""
    parts = [F.coalesce(x, F.lit("")) for x in (source, surface, F.lit("") if tool is None else tool)]
    low = F.lower(F.concat_ws(" ", *parts))
    out = F.when(_any(low, BENCHMARK_WORDS), "benchmark").when(_any(low, PROOF_WORDS), "proof")
    out = out.when(low.rlike(r"\b(" + "|".join(SURFACES) + r"|agent)\b"), "production_like").otherwise("unknown")
    return out if explicit is None else F.when(explicit.isin(*CLASSES), explicit).otherwise(out)


def traffic_class_by_origin(source: Column, surface: Column, tool: Column, explicit: Column | None = None) -> Column:
    """The other order: production_like before benchmark before proof."""
    low = F.lower(F.concat_ws(" ", *(F.coalesce(x, F.lit("")) for x in (source, surface, tool))))
    out = F.when(low.rlike(r"\b(" + "|".join(SURFACES) + r"|agent)\b"), "production_like").when(_any(low, BENCHMARK_WORDS), "benchmark").when(_any(low, PROOF_WORDS), "proof").otherwise("unknown")
    return out if explicit is None else F.when(explicit.isin(*CLASSES), explicit).otherwise(out)


def count_by(rows: DataFrame, key: str) -> DataFrame:
    """(key, n) with a missing key as unknown; the most frequent first, then by key."""
    return rows.groupBy(F.coalesce(F.col(key), F.lit("unknown")).alias(key)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key)


def nearest_rank(x: str, share: float) -> Column:
    """The value at rank ceil(share * n), 0 of nothing."""
    return F.coalesce(F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {x})"), F.lit(0.0))


def floor_rank(rows: DataFrame, keys: list[str], x: str, shares: dict[str, float]) -> DataFrame:
    """The value at place floor(share * n) of each group, from 0.

    Ranks come from a window over the group's rows, not from a list of them, so a group may be of any size.
    """
    total = Window.partitionBy(*keys)
    ranked = rows.withColumns({"_n": F.count("*").over(total), "_r": F.row_number().over(total.orderBy(x)) - 1})
    at = lambda p: F.max(F.when(F.col("_r") == F.least(F.col("_n") - 1, F.floor(F.col("_n") * p)), F.col(x))).alias
    return ranked.groupBy(*keys).agg(*(at(p)(name) for name, p in shares.items()))


def call_metrics(usd_per_million: float = 3.0) -> list[Column]:
    """Aggregates of (ok, duration_ms, raw_tokens, compact_tokens, saved_tokens); a missing ok is a success."""
    ok = F.coalesce(F.col("ok"), F.lit(True))
    raw, small, saved = (F.sum(F.when(ok, finite(F.col(c))).otherwise(0.0)) for c in ("raw_tokens", "compact_tokens", "saved_tokens"))
    return [
        F.count("*").alias("calls"), F.count_if(ok).alias("ok_calls"), F.count_if(~ok).alias("failed_calls"), raw.alias("raw_tokens"), small.alias("compact_tokens"), saved.alias("saved_tokens"),
        F.when(raw > 0, round_to((raw - small) / raw * 100.0, 1)).otherwise(0.0).alias("savings_pct"), F.when(raw > 0, round_to(saved / raw * 100.0, 1)).otherwise(0.0).alias("saved_pct"),
        round_to(saved / 1e6 * usd_per_million, 4).alias("saved_usd"), nearest_rank("duration_ms", 0.5).alias("p50_ms"), nearest_rank("duration_ms", 0.95).alias("p95_ms"), F.coalesce(F.max("duration_ms"), F.lit(0.0)).alias("max_ms"),
    ]


def measure(calls: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return calls.groupBy(*(keys or [])).agg(*call_metrics())


def measure_by_class(calls: DataFrame, feedback: DataFrame) -> DataFrame:
    """Calls and feedback per traffic class; feedback of no own class takes that of its call."""
    calls = calls.withColumn("traffic", traffic_class(F.col("source"), F.col("surface"), F.col("tool")))
    of_call = calls.groupBy("call_id").agg(F.max_by("traffic", "ts").alias("call_traffic"))
    own = F.nullif(traffic_class(F.col("source"), F.col("surface")), F.lit("unknown"))
    judged = feedback.withColumn("own", own).join(of_call, "call_id", "left").withColumn("traffic", F.coalesce("own", "call_traffic", F.lit("unknown")))
    told = judged.groupBy("traffic").agg(F.count("*").alias("feedback_count"), F.count_if(F.col("outcome") != "helpful").alias("miss_or_partial_count"), F.count_if("had_to_search").alias("search_count"))
    both = measure(calls, ["traffic"]).join(told, "traffic", "full_outer").fillna(0)
    return both.withColumn("feedback_coverage_pct", F.when(F.col("calls") > 0, round_to(F.col("feedback_count") / F.col("calls") * 100.0, 1)).otherwise(0.0))


def sessions(events: DataFrame, least_uncertainty: float = 0.03) -> DataFrame:
    """Per session: events, times, counts by source, failures, uncertain events, tokens; saved falls back to raw - compact."""
    by = events.groupBy("session_id", F.coalesce("source", F.lit("unknown")).alias("source")).agg(
        F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_if(~F.coalesce("ok", F.lit(True))).alias("failed"), F.count_if(F.col("uncertainty") > least_uncertainty).alias("uncertain"),
        *(F.sum(finite(F.col(c))).alias(c) for c in ("raw_tokens", "compact_tokens", "saved_tokens")),
    )
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "source")))  # a row a source, so a short list
    out = by.groupBy("session_id").agg(
        F.sum("n").alias("events"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("failed").alias("failed"), F.sum("uncertain").alias("uncertain"), F.sum(F.when(F.col("source") == "unknown", F.col("n")).otherwise(0)).alias("unknown_source"),
        *(F.sum(c).alias(c) for c in ("raw_tokens", "compact_tokens", "saved_tokens")), F.array_join(F.transform(order, lambda x: F.concat(x["source"], F.lit("="), (-x["minus"]).cast("string"))), ",").alias("by_source"),
    )
    saved = F.coalesce(F.nullif(F.col("saved_tokens"), F.lit(0.0)), F.greatest(F.lit(0.0), F.col("raw_tokens") - F.col("compact_tokens")))
    return out.withColumn("saved_tokens", saved).withColumn("saved_pct", F.when(F.col("raw_tokens") > 0, round_to(F.col("saved_tokens") / F.col("raw_tokens") * 100.0, 1)).otherwise(0.0))


def session_diff(rolled: DataFrame, baseline: str | int, candidate: str | int) -> DataFrame:
    """Candidate minus baseline, and regression flags."""
    pick = lambda x, p: rolled.filter(F.col("session_id") == x).select(*(F.col(c).alias(p + c) for c in rolled.columns))
    names = lambda p: F.filter(F.transform(F.split(p + "by_source", ","), lambda x: F.substring_index(x, "=", 1)), lambda x: x != "unknown")
    both = pick(baseline, "b_").crossJoin(pick(candidate, "c_"))  # one row each
    d = lambda c: (F.col("c_" + c) - F.col("b_" + c))
    gone = lambda a, b: F.array_join(F.array_sort(F.array_except(names(a), names(b))), ",")
    return both.select(
        *(d(c).alias("d_" + c) for c in ("events", "failed", "uncertain", "unknown_source", "saved_tokens", "saved_pct")), gone("c_", "b_").alias("added_sources"), gone("b_", "c_").alias("removed_sources"),
        (d("failed") > 0).alias("more_failures"), (d("uncertain") > 0).alias("more_uncertain"), (d("saved_tokens") < 0).alias("fewer_saved"), (d("unknown_source") > 0).alias("more_unknown"),
    )


def window_export(events: DataFrame, since: str, until: str) -> DataFrame:
    """Totals of a half-open window; the comparison reaches the scan."""
    from strataloom.functions.predicates import in_window

    return events.filter(in_window(F.col("ts"), since, until)).agg(F.count("*").alias("events"), F.count_distinct("session_id").alias("sessions"), F.count_if(~F.coalesce("ok", F.lit(True))).alias("failed"), F.sum(finite(F.col("saved_tokens"))).alias("saved_tokens"))


def service_rollup(calls: DataFrame) -> DataFrame:
    """Per service: calls, failures actionable or of proof loops, uncertainty, tokens, times."""
    ok, proof = F.coalesce("ok", F.lit(True)), F.col("traffic") == "proof"
    unsure = F.col("uncertainty") > 0.03
    return calls.groupBy("service").agg(*call_metrics(), F.count_if(~ok & ~proof).alias("actionable_errors"), F.count_if(~ok & proof).alias("proof_errors"), F.count_if(unsure & ~proof).alias("actionable_uncertain"), F.count_if(unsure & proof).alias("proof_uncertain"), F.count_distinct("tool").alias("tools"))


def rollup_by(calls: DataFrame, key: str) -> DataFrame:
    """Requests, successes, errors, savings and the floor-rank p95, the most requests first."""
    ok = F.coalesce("ok", F.lit(True))
    raw, saved = F.sum(finite(F.col("raw_tokens"))), F.sum(finite(F.col("saved_tokens")))
    base = calls.groupBy(key).agg(F.count("*").alias("requests"), F.count_if(ok).alias("ok_count"), F.count_if(~ok).alias("errors"), saved.alias("saved_tokens"), F.when(raw > 0, round_to(saved / raw * 100.0, 1)).otherwise(0.0).alias("savings_pct"))
    return base.join(floor_rank(calls, [key], "duration_ms", {"p95_ms": 0.95}), key).orderBy(F.desc("requests"), key)


def days(calls: DataFrame, first: str, last: str) -> DataFrame:
    """A row for each day of the range, days without calls too."""
    calendar = calls.sparkSession.sql(f"SELECT explode(sequence(DATE '{first}', DATE '{last}')) AS day")
    per = calls.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("calls"), F.count_if(~F.coalesce("ok", F.lit(True))).alias("failed"), F.count_distinct("service").alias("services"), F.sum(finite(F.col("raw_tokens"))).alias("raw_tokens"), F.sum(finite(F.col("saved_tokens"))).alias("saved_tokens"))
    return calendar.join(per, "day", "left").fillna(0)


def weeks(daily: DataFrame) -> DataFrame:
    """Sums of each row's last seven days, the most services of a day, and ratios to one digit."""
    w = Window.orderBy("day").rowsBetween(-6, 0)  # a row a day
    out = daily.select("day", *(F.sum(c).over(w).alias(c) for c in ("calls", "failed", "raw_tokens", "saved_tokens")), F.max("services").over(w).alias("most_services"), F.count_if(F.col("calls") > 0).over(w).alias("active_days"))
    ratio = lambda a, b: F.when(F.col(b) > 0, round_to(F.col(a) / F.col(b) * 100.0, 1)).otherwise(0.0)
    return out.withColumns({"failed_pct": ratio("failed", "calls"), "saved_pct": ratio("saved_tokens", "raw_tokens")})


def review_queue(calls: DataFrame) -> DataFrame:
    """Issues by priority: failures P0, slow calls P1, uncertain ones P2; merged by (priority, service, kind)."""
    ok = F.coalesce("ok", F.lit(True))
    found = F.array_compact(F.array(F.when(~ok, F.struct(F.lit("P0").alias("priority"), F.lit("failure").alias("kind"))), F.when(F.col("duration_ms") >= 1000, F.struct(F.lit("P1").alias("priority"), F.lit("slow").alias("kind"))), F.when(F.col("uncertainty") > 0.03, F.struct(F.lit("P2").alias("priority"), F.lit("uncertain").alias("kind")))))
    rows = calls.select("service", "ts", F.explode(found).alias("x"))
    return rows.groupBy("x.priority", "service", "x.kind").agg(F.count("*").alias("n"), F.count_distinct(F.to_date("ts")).alias("days"), F.min("ts").alias("first_ts"))


def readiness(daily: DataFrame, least_days: int = 5, least_calls: int = 100, most_failed_pct: float = 10.0) -> DataFrame:
    """Named gates over the days, each passed or not, and the verdict."""
    total = daily.agg(F.count_if(F.col("calls") > 0).alias("active"), F.sum("calls").alias("calls"), F.sum("failed").alias("failed"), F.sum("saved_tokens").alias("saved"))
    gates = {"active_days": F.col("active") >= least_days, "calls": F.col("calls") >= least_calls, "failures": 100 * F.col("failed") <= most_failed_pct * F.col("calls"), "savings": F.col("saved") > 0}
    rows = total.select(F.explode(F.array(*(F.struct(F.lit(n).alias("gate"), c.alias("passed")) for n, c in gates.items()))).alias("g")).select("g.*")
    every = F.min("passed").over(Window.partitionBy(F.lit(1)))  # four rows
    return rows.withColumn("verdict", F.when(every, "ready").otherwise("not_ready"))


def recommendations(rolled: DataFrame) -> DataFrame:
    """Threshold rules over services."""
    rules = F.array_compact(F.array(F.when(F.col("actionable_errors") > 0, "fix failing calls"), F.when(F.col("p95_ms") > 100, "look at slow calls"), F.when(F.col("savings_pct") < 10, "raise savings"), F.when(F.col("actionable_uncertain") > 0, "review uncertain answers")))
    return rolled.select("service", F.explode(rules).alias("recommendation"))
