"""Smaller operators on cases, scopes, regions and policies."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.session import spread


def scope_matches(query: str, scope: str, fields: list[str]) -> Column:
    """Given fields are equal but for case and the query's tags are among the scope's; an empty query matches nothing."""
    q, s = (lambda f: F.col(f"{query}.{f}")), (lambda f: F.col(f"{scope}.{f}"))
    given = lambda f: F.coalesce(q(f), F.lit("")) != ""
    fits, some = F.lit(True), F.size(F.coalesce(q("tags"), F.array().cast("array<string>"))) > 0
    for f in fields:
        fits = fits & (~given(f) | F.coalesce(F.lower(q(f)) == F.lower(s(f)), F.lit(False)))
        some = some | given(f)
    tags = F.size(F.array_except(F.coalesce(q("tags"), F.array().cast("array<string>")), F.coalesce(s("tags"), F.array().cast("array<string>")))) == 0
    return some & fits & tags


def to_number(x: Column, otherwise: float, low: float, high: float) -> Column:
    """A clamped number, with a value for what is none."""
    n = x.try_cast("double")
    return F.least(F.lit(high), F.greatest(F.lit(low), F.when(n.isNull() | F.isnan(n), otherwise).otherwise(n)))


def clip(x0: Column, y0: Column, x1: Column, y1: Column, width: int, height: int) -> Column:
    """A region inside the image; null if nothing is left."""
    cut = lambda v, most: F.least(F.lit(most), F.greatest(F.lit(0), v))
    a, b, c, d = cut(x0, width), cut(y0, height), cut(x1, width), cut(y1, height)
    return F.when((c > a) & (d > b), F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1")))


def near_boxes(boxes: DataFrame, gap: int = 20, cell: int | None = None) -> DataFrame:
    """Pairs (a < b) of boxes (image, box_id, x0, y0, x1, y1) at most `gap` apart.

    Boxes are put into the grid cells that they, widened by the gap, touch and meet by equality there: the one that begins
    further right only in its first column, so a pair counts once, in its first common row. Unless given, a cell is
    as large as the mean box, so a box lies in some four cells. All pairs are made, which grow as the square of
    the boxes on a picture.
    """
    w, h = F.col("x1") - F.col("x0") + 2 * gap, F.col("y1") - F.col("y0") + 2 * gap
    if cell is None:
        mean = boxes.agg(F.avg(w), F.avg(h), F.sqrt(F.avg(w.cast("double") * h))).first()
        cell = max(1, math.ceil(max((m for m in mean if m is not None), default=1)))
    at = lambda v: F.floor(v / cell)
    rows = spread(boxes.select("image", "box_id", "x0", "y0", "x1", "y1")).withColumn("cy", F.explode(F.sequence(at(F.col("y0") - gap), at(F.col("y1") + gap))))
    side = lambda s, cx: rows.select("image", cx.alias("cx"), "cy", *(F.col(c).alias(f"{s}_{c}") for c in ("box_id", "x0", "y0", "x1", "y1")))
    right, left = side("a", at(F.col("x0") - gap)), side("b", F.explode(F.sequence(at(F.col("x0") - gap), at(F.col("x1") + gap))))
    near = (F.col("a_x0") - gap <= F.col("b_x1")) & (F.col("a_y0") - gap <= F.col("b_y1")) & (F.col("b_y0") - gap <= F.col("a_y1")) & (F.col("b_x0") - gap <= F.col("a_x1"))
    ordered = (F.col("b_x0") < F.col("a_x0")) | ((F.col("b_x0") == F.col("a_x0")) & (F.col("b_box_id") < F.col("a_box_id")))
    first = F.col("cy") == F.greatest(at(F.col("a_y0") - gap), at(F.col("b_y0") - gap))
    # merged, not broadcast: the few tasks that read a small file would make all pairs
    both = right.join(left.hint("merge"), ["image", "cx", "cy"]).filter(near & ordered & first & (F.col("a_box_id") != F.col("b_box_id")))
    return both.select("image", F.least("a_box_id", "b_box_id").alias("a"), F.greatest("a_box_id", "b_box_id").alias("b"))


def approvals(images: DataFrame, approved: DataFrame) -> DataFrame:
    """approved if the stored hash is this one, stale if it is another, else unapproved."""
    both = images.join(approved.select("name", F.col("hash").alias("was")), "name", "left")
    return both.withColumn("status", F.when(F.col("was").isNull(), "unapproved").when(F.col("was") == F.col("hash"), "approved").otherwise("stale")).drop("was")


def index_status(index: DataFrame, files: DataFrame) -> DataFrame:
    """Indexed files that are missing, or differ in size or time, are stale."""
    now = files.select("path", F.col("size").alias("size_now"), F.col("mtime").alias("mtime_now"))
    both = index.join(now, "path", "left")
    return both.select("path", F.when(F.col("size_now").isNull(), "missing").when((F.col("size_now") != F.col("size")) | (F.col("mtime_now") != F.col("mtime")), "changed").otherwise("fresh").alias("status"))


def feedback_cases(feedback: DataFrame) -> DataFrame:
    """Candidate cases from feedback: the corrected or raw query, expected else missing paths; the first of each (query, paths)."""
    paths = F.array_sort(F.array_distinct(F.when(F.size("expected_paths") > 0, F.col("expected_paths")).otherwise(F.col("missing_paths"))))
    query = F.coalesce(F.nullif(F.trim("corrected_query"), F.lit("")), F.trim("query"))
    rows = feedback.filter(F.col("outcome") != "helpful").select("feedback_id", query.alias("query"), paths.alias("paths")).filter((F.col("query") != "") & (F.size("paths") > 0))
    return rows.groupBy("query", F.array_join("paths", ",").alias("paths")).agg(F.min("feedback_id").alias("feedback_id"))


def inherited(profiles: DataFrame, deepest: int = 8) -> DataFrame:
    """(profile, ancestor, depth) along `extends` (profile, parent); a cycle ends the walk. One row a profile, few in all."""
    out = profiles.select("profile", F.col("profile").alias("ancestor"), F.lit(0).alias("depth"), F.array("profile").alias("seen"))
    level = out
    up = profiles.filter("parent is not null").select(F.col("profile").alias("ancestor"), "parent")
    for depth in range(1, deepest + 1):
        level = level.join(up, "ancestor").filter(~F.array_contains("seen", F.col("parent"))).select("profile", F.col("parent").alias("ancestor"), F.lit(depth).alias("depth"), F.concat("seen", F.array("parent")).alias("seen"))
        out = out.unionByName(level)
    return out.drop("seen")


def presence_score(checks: list[Column]) -> tuple[Column, Column]:
    """Share of checks that hold, and a rating."""
    score = sum((F.coalesce(c, F.lit(False)).cast("double") for c in checks[1:]), F.coalesce(checks[0], F.lit(False)).cast("double")) / len(checks)
    return score, F.when(score >= 0.75, "strong").when(score >= 0.5, "usable").otherwise("weak")


def counter_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per counter: true counts one, a positive number its value, all else nothing."""
    value = lambda c: F.when(F.col(c).cast("string") == "true", 1.0).otherwise(F.greatest(F.lit(0.0), F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(0.0))))
    return rows.agg(*(F.sum(value(c)).alias(c) for c in keys)).unpivot([], keys, "counter", "total")


#: Fixed: what feedback on a retrieval asks to be done, by what it says.
UPGRADES = {
    "promote": "Promote this query to a golden benchmark candidate before changing ranking.",
    "paths": "Add expected_paths/missing_paths to the benchmark so future ranking changes are measurable.",
    "query": "Inspect corrected_query for synonym/query-expansion rules.",
    "search": "Compare frontier-discovered files with ranked_files and adjust scoring only if the benchmark fails reproducibly.",
    "context": "Check path policy, generated-file filtering, and over-boosted context_hints for false positives.",
    "keep": "Keep as positive trace; no retrieval upgrade needed.",
}
OUTCOMES = ("helpful", "partial", "miss", "wrong_context", "manual_search_needed")


def record_feedback(rows: DataFrame) -> DataFrame:
    """Feedback rows of a known outcome, with benchmark_candidate and the plan that they ask for."""
    o, some = F.col("outcome"), lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0
    searched = F.coalesce("frontier_had_to_search", F.lit(False))
    asks = F.array_compact(
        F.array(
            F.when(o != "helpful", F.lit(UPGRADES["promote"])), F.when(some(F.col("expected_paths")) | some(F.col("missing_paths")), F.lit(UPGRADES["paths"])),
            F.when(F.trim(F.coalesce("corrected_query", F.lit(""))) != "", F.lit(UPGRADES["query"])), F.when(searched, F.lit(UPGRADES["search"])), F.when(o == "wrong_context", F.lit(UPGRADES["context"])),
        )
    )
    plan = F.when(F.size(asks) > 0, asks).otherwise(F.array(F.lit(UPGRADES["keep"])))
    return rows.filter(o.isin(*OUTCOMES)).withColumns({"benchmark_candidate": (o != "helpful") | searched, "upgrade_plan": plan})


def import_feedback(rows: DataFrame, date: str = "", helpful: bool = False, others: bool = False) -> DataFrame:
    """Feedback rows that become cases: of a day (a prefix of ts), candidates unless `others`, none that was helpful unless `helpful`."""
    o = F.coalesce("outcome", F.lit(""))
    candidate = F.coalesce("benchmark_candidate", F.lit(False)) | ((o != "") & (o != "helpful"))
    out = rows.filter(F.col("ts").startswith(date)) if date else rows
    out = out if helpful else out.filter(o != "helpful")
    out = out if others else out.filter(candidate)
    return out.withColumn("tags", F.array(F.lit("retrieval-feedback"), F.coalesce(F.nullif(o, F.lit("")), F.lit("unknown-outcome"))))


def inherit_traffic(feedback: DataFrame, calls: DataFrame) -> DataFrame:
    """feedback (call_id, own, ...) with traffic: its own class, if known, else that of the last call (call_id, at, traffic) with its id."""
    last = calls.groupBy("call_id").agg(F.max_by("traffic", "at").alias("of_call"))
    return feedback.join(last, "call_id", "left").withColumn("traffic", F.coalesce(F.nullif("own", F.lit("unknown")), "of_call")).drop("of_call")


def helpful_split(rows: DataFrame, feedback: DataFrame, key: str) -> DataFrame:
    """rows with helpful: whether feedback (key, outcome) calls them so."""
    good = feedback.filter("outcome = 'helpful'").select(key)
    return rows.join(good, key, "left_semi").withColumn("helpful", F.lit(True)).unionByName(rows.join(good, key, "left_anti").withColumn("helpful", F.lit(False)))


def query_of(cases: DataFrame, overrides: DataFrame, key: str, summary: str) -> DataFrame:
    """(key, query): the override (key, query), else the case's summary, else nothing."""
    over = overrides.select(key, F.col("query").alias("_over"))
    return cases.select(key, summary).join(over, key, "left").select(key, F.coalesce("_over", summary, F.lit("")).alias("query"))


def pairwise_gaps(groups: DataFrame, name: str, value: str) -> DataFrame:
    """(a, b, gap) of each two groups of a handful, a before b."""
    side = lambda x: groups.select(F.col(name).alias(x), F.col(value).alias(f"_{x}"))
    return side("a").join(side("b"), F.col("a") < F.col("b")).select("a", "b", (F.col("_a") - F.col("_b")).alias("gap"))


def command_source(explicit: Column, from_file: Column, builtin: Column) -> Column:
    """Where a command comes from: asked for, the policy file, built in, or nowhere."""
    given = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    return F.when(given(explicit), "explicit").when(given(from_file), "file").when(given(builtin), "builtin").otherwise("unavailable")


def license_of(raw: Column) -> Column:
    """A package's license from its JSON value: a text, a list (joined by OR), or an object with a type."""
    v = F.try_parse_json(raw)
    kind = F.schema_of_variant(v)
    items = F.filter(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))), lambda x: F.trim(x) != "")
    text = F.when(kind == "STRING", F.trim(F.try_variant_get(v, "$", "string"))).when(kind.startswith("ARRAY"), F.array_join(items, " OR ")).when(kind.startswith("OBJECT"), F.trim(F.try_variant_get(v, "$.type", "string")))
    return F.nullif(text, F.lit(""))


def peer_evidence(dependencies: DataFrame, peers: DataFrame, providers: DataFrame) -> DataFrame:
    """Dependencies (name) that a provider (package) names as its peer (package, name)."""
    return dependencies.join(peers.join(providers.select("package").distinct(), "package", "left_semi"), "name", "left_semi")


def coverage(requests: DataFrame, excluded: tuple[str, ...] = (), core: tuple[str, ...] = ()) -> DataFrame:
    """(service, profile, requests, production_like, errors, status, in_denominator) of requests (service, traffic, ok, error).

    A service counts if it is active; one that is left out by its class counts all the same when it has an error that
    is no proof, no benchmark and no refusal by policy.
    """
    from .safety import is_caller_rejection

    bad = ~F.col("ok") & ~F.col("traffic").isin("proof", "benchmark") & ~is_caller_rejection(F.col("error"))
    out = requests.groupBy("service").agg(F.count("*").alias("requests"), F.count_if(F.col("traffic") == "production_like").alias("production_like"), F.count_if(bad).alias("errors"))
    left_out, active = F.col("service").isin(*excluded) if excluded else F.lit(False), F.col("production_like") > 0
    forced = (F.col("errors") > 0) & (left_out | ~active)
    status = F.when(forced, "force_kept_recent_error").when(left_out, "traffic_class_excluded").when(active, "active").otherwise("visible_idle")
    profile = F.when(F.col("service").isin(*core), "core").otherwise("extended") if core else F.lit("extended")
    return out.withColumns({"profile": profile, "status": status, "in_denominator": forced | (~left_out & active)})


def coverage_gates(services: DataFrame) -> DataFrame:
    """(profile, services, counted, ready, passed): a tier passes if it counts services and all of them are ready."""
    ready = F.col("in_denominator") & (F.col("production_like") > 0) & (F.col("errors") == 0)
    out = services.groupBy("profile").agg(F.count("*").alias("services"), F.count_if("in_denominator").alias("counted"), F.count_if(ready).alias("ready"))
    return out.withColumn("passed", (F.col("counted") > 0) & (F.col("ready") == F.col("counted")))


def trace_source(explicit: Column, *about: Column) -> Column:
    """Where a call comes from: a proof loop if any text about it speaks of one, else as it says itself (80 characters), else unknown."""
    said = F.trim(F.coalesce(explicit, F.lit("")))
    joined = F.lower(F.concat_ws(" ", said, *about))
    return F.when(joined.rlike("benchmark|smoke|regression"), "proof_loop").when(said != "", F.substring(said, 1, 80)).otherwise("unknown")
