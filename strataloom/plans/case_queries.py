"""Cases, scopes, regions and policies on the tables of a folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.operators import cases as C

from .registry import query
from .scalar_queries import scalar

K = lambda: F.col("p_partkey")
PART = ("part", "p_partkey")

scalar("fn_to_number", *PART, lambda: C.to_number(F.when(K() % 3 == 0, "x").when(K() % 3 == 1, F.col("p_size").cast("string")), 12.0, 1.0, 40.0), "CAST(CASE WHEN p_partkey % 3 = 1 THEN least(40.0, greatest(1.0, p_size)) ELSE 12.0 END AS DOUBLE)")
scalar("fn_region_normalize", *PART, lambda: F.to_json(C.clip(K().cast("int") % 80 - 10, F.lit(5), K().cast("int") % 80 + 10, F.lit(90), 64, 64)), "CASE WHEN least(64, greatest(0, p_partkey % 80 + 10)) > least(64, greatest(0, p_partkey % 80 - 10)) THEN '{\"x0\":' || least(64, greatest(0, p_partkey % 80 - 10)) || ',\"y0\":5,\"x1\":' || least(64, greatest(0, p_partkey % 80 + 10)) || ',\"y1\":64}' END")
scalar("agg_context_quality", *PART, lambda: C.presence_score([K() % n == 0 for n in (2, 3, 4, 5, 6, 7, 8, 9)])[0], " + ".join(f"(p_partkey % {n} = 0)::DOUBLE" for n in (2, 3, 4, 5, 6, 7, 8, 9)).join(("(", ") / 8")))


@query("pred_scope_match", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN FALSE ELSE (p_partkey % 5 <> 1 OR p_partkey % 2 = 0) AND (p_partkey % 5 <> 2 OR p_partkey % 3 = 0) END AS fits FROM part")
def pred_scope_match(t):
    k = K()
    q = F.struct(F.when(k % 5 == 1, "APP").alias("page"), F.when(k % 5 == 2, F.array(F.lit("dark"))).when(k % 5 >= 3, F.array(F.lit("any"))).alias("tags"))
    s = F.struct(F.when(k % 2 == 0, "app").otherwise("web").alias("page"), F.when(k % 3 == 0, F.array(F.lit("dark"), F.lit("any"))).otherwise(F.array(F.lit("any"))).alias("tags"))
    return t("part").select("p_partkey", q.alias("q"), s.alias("s")).select("p_partkey", C.scope_matches("q", "s", ["page"]).alias("fits"))


@query("join_boxes_near", "WITH b AS (SELECT p_brand AS image, p_partkey AS id, p_partkey * 37 % 2000 AS x0, p_partkey * 53 % 1500 AS y0, p_partkey * 37 % 2000 + p_size AS x1, p_partkey * 53 % 1500 + p_size AS y1 FROM part) SELECT a.image, a.id AS a, b.id AS b FROM b a JOIN b ON a.image = b.image AND a.id < b.id AND a.x0 - 20 <= b.x1 AND b.x0 - 20 <= a.x1 AND a.y0 - 20 <= b.y1 AND b.y0 - 20 <= a.y1")
def join_boxes_near(t):
    k = K()
    boxes = t("part").select(F.col("p_brand").alias("image"), k.alias("box_id"), (k * 37 % 2000).alias("x0"), (k * 53 % 1500).alias("y0"), (k * 37 % 2000 + F.col("p_size")).alias("x1"), (k * 53 % 1500 + F.col("p_size")).alias("y1"))
    return C.near_boxes(boxes)


@query("raster_approval", "SELECT p_name || p_partkey AS name, CASE WHEN p_partkey % 3 = 0 THEN 'unapproved' WHEN p_partkey % 2 = 0 THEN 'approved' ELSE 'stale' END AS status FROM part")
def raster_approval(t):
    name = F.concat("p_name", K().cast("string")).alias("name")
    images = t("part").select(name, F.lit("h").alias("hash"))
    known = t("part").filter(K() % 3 != 0).select(name, F.when(K() % 2 == 0, "h").otherwise("old").alias("hash"))
    return C.approvals(images, known).select("name", "status")


@query("graph_status", "SELECT 'f' || p_partkey AS path, CASE WHEN p_partkey % 4 = 0 THEN 'missing' WHEN p_partkey % 3 = 0 THEN 'changed' ELSE 'fresh' END AS status FROM part")
def graph_status(t):
    path = F.concat(F.lit("f"), K().cast("string")).alias("path")
    index = t("part").select(path, F.col("p_size").alias("size"), F.lit(1).alias("mtime"))
    files = t("part").filter(K() % 4 != 0).select(path, F.col("p_size").alias("size"), F.when(K() % 3 == 0, 2).otherwise(1).alias("mtime"))
    return C.index_status(index, files)


@query("trace_to_benchmark", "WITH f AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'fixed ' || event_id % 50 ELSE 'query ' || event_id % 70 END AS query, CASE WHEN event_id % 3 = 0 THEN 'a,b' ELSE 'm' || event_id % 5 END AS paths FROM events WHERE event_type <> 'view') SELECT query, paths, min(event_id) AS feedback_id FROM f GROUP BY ALL")
def trace_to_benchmark(t):
    i = F.col("event_id")
    text = lambda *x: F.concat(F.lit(x[0]), (i % x[1]).cast("string"))
    rows = t("events").select(
        i.alias("feedback_id"), F.when(F.col("event_type") == "view", "helpful").otherwise("partial").alias("outcome"), text("query ", 70).alias("query"), F.when(i % 4 == 0, text("fixed ", 50)).otherwise(" ").alias("corrected_query"),
        F.when(i % 3 == 0, F.array(F.lit("b"), F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("expected_paths"), F.array(text("m", 5)).alias("missing_paths"),
    )
    return C.feedback_cases(rows)


@query("join_policy_profile", "WITH RECURSIVE p AS (SELECT n_nationkey AS profile, CASE WHEN n_nationkey > 0 THEN n_nationkey // 2 END AS parent FROM nation), w AS (SELECT profile, profile AS ancestor, 0 AS depth FROM p UNION ALL SELECT w.profile, p.parent, depth + 1 FROM w JOIN p ON p.profile = w.ancestor WHERE p.parent IS NOT NULL) SELECT * FROM w")
def join_policy_profile(t):
    n = F.col("n_nationkey")
    return C.inherited(t("nation").select(n.alias("profile"), F.when(n > 0, F.floor(n / 2).cast("int")).alias("parent")))


@query("agg_quality_counters", "WITH r AS (SELECT CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS DOUBLE) AS failed, sum(greatest(0.0, value - 50)) AS excess FROM events) SELECT 'failed' AS counter, failed AS total FROM r UNION ALL SELECT 'excess', excess FROM r")
def agg_quality_counters(t):
    rows = t("events").select((F.col("event_type") == "error").alias("failed"), (F.col("value") - 50).alias("excess"))
    return C.counter_sums(rows, ["failed", "excess"])

