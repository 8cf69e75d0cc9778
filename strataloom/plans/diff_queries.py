"""Diffs on part, supplier and documents; history on lineitem and orders; evaluation on labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataloom.functions import text as T
from strataloom.operators import diffs as D
from strataloom.operators import evaluation as E
from strataloom.operators import history as H

from .registry import query

K = lambda: F.col("p_partkey")
VERSION = lambda k: F.concat((k % 7).cast("string"), F.lit("."), (k % 5).cast("string"), F.lit(".0"))
SV = lambda k: f"CAST(({k}) % 7 AS VARCHAR) || '.' || CAST(({k}) % 5 AS VARCHAR) || '.0'"


def lock(t, new: bool):
    p = t("part")
    rows = p.filter(K() % 10 != (3 if new else 4)).select(F.concat(F.lit("pkg-"), K().cast("string")).alias("name"), VERSION(K() + F.when((K() % 4 == 0) & F.lit(new), 1).otherwise(0)).alias("version"), K().alias("place"))
    return rows.unionByName(rows.filter("place % 9 = 0").withColumn("version", F.lit("9.9.9")).withColumn("place", F.col("place") + 1_000_000))


def lock_sql(new: bool) -> str:
    x = f"SELECT 'pkg-' || p_partkey AS name, {SV('p_partkey' + (' + CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END' if new else ''))} AS version, p_partkey AS place FROM part WHERE p_partkey % 10 <> {3 if new else 4}"
    return f"SELECT name, CASE WHEN place % 9 = 0 THEN '9.9.9' ELSE version END AS version FROM ({x})"


@query("join_lockfile_diff", f"""WITH o AS ({lock_sql(False)}), n AS ({lock_sql(True)}), j AS (SELECT coalesce(o.name, n.name) AS name, o.version AS old_version, n.version AS new_version FROM o FULL JOIN n ON o.name = n.name),
k AS (SELECT *, CASE WHEN old_version IS NULL THEN 'added' WHEN new_version IS NULL THEN 'removed' WHEN old_version <> new_version THEN 'changed' END AS change FROM j)
SELECT *, coalesce(change = 'changed' AND CAST(split_part(new_version, '.', 1) AS INT) > CAST(split_part(old_version, '.', 1) AS INT), FALSE) AS major_bump FROM k WHERE change IS NOT NULL""")
def join_lockfile_diff(t):
    return D.lockfile_diff(lock(t, False), lock(t, True))


def docs_and_mirrors(t):
    d = t("documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.substring("text", 1, 20).alias("title"), T.stable_hash(F.col("text")).alias("hash"), "doc_id")
    i = F.col("doc_id")
    m = d.filter(i % 5 != 0).select("path", F.when(i % 3 == 0, "other").when(i % 4 == 0, "").otherwise(F.col("title")).alias("title"), F.when(i % 7 == 0, "old").otherwise(F.col("hash")).alias("hash"))
    lost = d.filter(i % 50 == 1).select(F.concat("path", F.lit("-gone")).alias("path"), "title", "hash")
    return d.drop("doc_id"), m.unionByName(lost)


DM = """d AS (SELECT source || '/' || doc_id AS path, substr(text, 1, 20) AS title, substr(sha256(text), 1, 16) AS hash, doc_id AS i FROM documents),
m AS (SELECT path, CASE WHEN i % 3 = 0 THEN 'other' WHEN i % 4 = 0 THEN '' ELSE title END AS title, CASE WHEN i % 7 = 0 THEN 'old' ELSE hash END AS hash FROM d WHERE i % 5 <> 0 UNION ALL SELECT path || '-gone', title, hash FROM d WHERE i % 50 = 1),
c AS (SELECT coalesce(d.path, m.path) AS path, list_filter([CASE WHEN m.path IS NULL THEN 'missing_mirror' END, CASE WHEN d.path IS NULL THEN 'missing_source' END, CASE WHEN d.path IS NOT NULL AND m.title <> '' AND m.title <> d.title THEN 'title_mismatch' END, CASE WHEN d.path IS NOT NULL AND m.hash <> '' AND m.hash <> d.hash THEN 'stale' END], lambda x: x IS NOT NULL) AS issues FROM d FULL JOIN m ON d.path = m.path)"""


@query("join_full_diff", f"WITH {DM} SELECT path, array_to_string(issues, ',') AS issues FROM c")
def join_full_diff(t):
    return D.mirror_diff(*docs_and_mirrors(t)).withColumn("issues", F.array_join("issues", ","))


@query("mirror_plan", f"""WITH {DM} SELECT path, CASE WHEN list_contains(issues, 'missing_mirror') THEN 'create' WHEN list_contains(issues, 'missing_source') THEN 'archive' WHEN list_contains(issues, 'stale') THEN 'refresh' ELSE 'retitle' END AS "update" FROM c WHERE len(issues) > 0""")
def mirror_plan(t):
    return D.mirror_plan(D.mirror_diff(*docs_and_mirrors(t)))


@query("join_registry_diff", f"WITH {DM} SELECT path, 'missing' AS issue FROM d WHERE path NOT IN (SELECT path FROM m) UNION ALL SELECT path, 'stale' FROM m WHERE path NOT IN (SELECT path FROM d)")
def join_registry_diff(t):
    return D.registry_diff(*docs_and_mirrors(t))


@query("join_env", "SELECT DISTINCT c_nationkey AS nation, 'undeclared' AS issue FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 3 = 0) UNION ALL SELECT n_nationkey, 'unused' FROM nation WHERE n_nationkey % 3 = 0 AND n_nationkey NOT IN (SELECT c_nationkey FROM customer)")
def join_env(t):
    return D.set_diff(t("customer").select(F.col("c_nationkey").alias("nation")), t("nation").filter("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("nation")), "nation")


def contracts(t, new: bool):
    fields = F.array(*(F.when(K() % n == 0, F.lit(f"f{n}")) for n in (2, 3, 5)), *([F.when(K() % 4 == 0, F.lit("extra"))] if new else []))
    rows = t("part").select(F.when(K() % 2 == 0, "operation").otherwise("schema").alias("kind"), F.concat(F.lit("k"), K().cast("string")).alias("key"), F.array_compact(fields).alias("required"), K().alias("i"))
    return (rows.filter("i % 11 <> 0") if new else rows).drop("i")


@query("join_contract_diff", """WITH r AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'operation' ELSE 'schema' END AS kind, 'k' || p_partkey AS key, p_partkey AS i FROM part)
SELECT kind, key, 'removed' AS change, NULL AS field FROM r WHERE i % 11 = 0 UNION ALL SELECT kind, key, 'newly_required', 'extra' FROM r WHERE i % 11 <> 0 AND i % 4 = 0""")
def join_contract_diff(t):
    return D.contract_diff(contracts(t, False), contracts(t, True))


@query("breaking_changes", """WITH r AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'operation' ELSE 'schema' END AS kind, 'k' || p_partkey AS key, p_partkey AS i FROM part),
c AS (SELECT kind, key, 'removed' AS change, NULL AS field FROM r WHERE i % 11 = 0 UNION ALL SELECT kind, key, 'newly_required', 'extra' FROM r WHERE i % 11 <> 0 AND i % 4 = 0),
w AS (SELECT *, row_number() OVER (PARTITION BY change ORDER BY kind, key) AS rank FROM c) SELECT *, CASE WHEN change = 'removed' THEN 'high' ELSE 'medium' END AS severity FROM w WHERE rank <= 10""")
def breaking_changes(t):
    return D.breaking_changes(D.contract_diff(contracts(t, False), contracts(t, True)))


def snapshots(t):
    half = F.when(F.year("o_orderdate") % 2 == 0, "new").otherwise("old")
    return t("orders").groupBy(half.alias("snapshot")).agg(F.count("*").cast("double").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").cast("double").alias("finished"), F.max("o_totalprice").alias("dearest"), F.count_distinct("o_custkey").cast("double").alias("customers"))


SNAP = "s AS (SELECT CASE WHEN year(o_orderdate) % 2 = 0 THEN 'new' ELSE 'old' END AS snapshot, count(*)::DOUBLE AS orders, (count(*) FILTER (o_orderstatus = 'F'))::DOUBLE AS finished, max(o_totalprice) AS dearest, count(DISTINCT o_custkey)::DOUBLE AS customers FROM orders GROUP BY 1)"


@query("agg_snapshot_delta", f"WITH {SNAP}, u AS (UNPIVOT s ON orders, finished, dearest, customers INTO NAME metric VALUE value), m AS (SELECT metric, max(value) FILTER (snapshot = 'old') AS before, max(value) FILTER (snapshot = 'new') AS after FROM u GROUP BY metric) SELECT *, after - before AS delta, after - before > 0 AS finding FROM m")
def agg_snapshot_delta(t):
    return D.snapshot_delta(snapshots(t), ["orders", "finished", "dearest", "customers"], "old", "new")


@query("agg_budget", f"WITH {SNAP}, b AS (SELECT 'orders' AS metric, orders AS actual, 100.0 AS allowed FROM s WHERE snapshot = 'new' UNION ALL SELECT 'finished', finished, 1e9 FROM s WHERE snapshot = 'new' UNION ALL SELECT 'customers', customers, 10.0 FROM s WHERE snapshot = 'new') SELECT *, actual - allowed AS over_by FROM b WHERE actual > allowed")
def agg_budget(t):
    return D.over_budget(snapshots(t).filter("snapshot = 'new'"), {"orders": 100, "finished": 1e9, "customers": 10})


def packages(t):
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (K() % n + 1).cast("int"))
    return t("part").select(
        F.concat(F.lit("pkg-"), K().cast("string")).alias("name"), VERSION(K()).alias("version"), pick(("MIT", "AGPL-3.0", "", "Apache-2.0"), 4).alias("license"),
        pick(("https://registry.npmjs.org/x", "git+ssh://x", "http://x", "", "file:../x"), 5).alias("resolved"), F.when(K() % 6 != 0, "sha512-x").alias("integrity"), (K() % 9 == 0).alias("has_install_script"),
    )


PKG = f"""p0 AS (SELECT 'pkg-' || p_partkey AS name, {SV('p_partkey')} AS version, ['MIT', 'AGPL-3.0', '', 'Apache-2.0'][p_partkey % 4 + 1] AS license, ['https://registry.npmjs.org/x', 'git+ssh://x', 'http://x', '', 'file:../x'][p_partkey % 5 + 1] AS resolved, CASE WHEN p_partkey % 6 <> 0 THEN 'sha512-x' END AS integrity, p_partkey % 9 = 0 AS script, ['npm', 'git', 'http', 'missing', 'file'][p_partkey % 5 + 1] AS resolved_kind FROM part),
p AS (SELECT *, array_to_string(list_filter([CASE WHEN license = '' THEN 'missing-license' END, CASE WHEN contains(lower(license), 'agpl') THEN 'disallowed-license' END, CASE WHEN resolved_kind IN ('git', 'file', 'http') THEN resolved_kind || '-source' END, CASE WHEN resolved_kind = 'missing' THEN 'missing-resolved' END, CASE WHEN integrity IS NULL THEN 'missing-integrity' END, CASE WHEN script THEN 'install-script' END], lambda x: x IS NOT NULL), ',') AS flags FROM p0)"""


@query("fn_supply_flags", f"WITH {PKG} SELECT name, resolved_kind, flags FROM p")
def fn_supply_flags(t):
    return D.supply_flags(packages(t)).select("name", "resolved_kind", F.array_join("flags", ",").alias("flags"))


@query("agg_supply_chain", f"WITH {PKG} SELECT resolved_kind, count(*) AS packages, count(*) FILTER (contains(flags, 'disallowed-license')) AS disallowed, count(*) FILTER (contains(flags, 'install-script')) AS scripts, count(*) FILTER (flags = '') AS clean FROM p GROUP BY resolved_kind")
def agg_supply_chain(t):
    has = lambda x: F.count_if(F.array_contains("flags", x))
    return D.supply_flags(packages(t)).groupBy("resolved_kind").agg(F.count("*").alias("packages"), has("disallowed-license").alias("disallowed"), has("install-script").alias("scripts"), F.count_if(F.size("flags") == 0).alias("clean"))


@query("agg_license_counts", f"WITH {PKG} SELECT coalesce(nullif(license, ''), 'UNKNOWN') AS license, count(*) AS n FROM p GROUP BY 1")
def agg_license_counts(t):
    return packages(t).groupBy(F.coalesce(F.nullif(F.col("license"), F.lit("")), F.lit("UNKNOWN")).alias("license")).agg(F.count("*").alias("n"))


@query("agg_package_age", """WITH p AS (SELECT p_partkey AS k, 'pkg-' || p_partkey AS name FROM part), r AS (SELECT k, DATE '2024-01-01' - CAST(k % 800 AS INT) AS modified, k % 13 = 0 AS deprecated FROM p WHERE k % 6 <> 0),
j AS (SELECT name, CAST(greatest(0, date_diff('day', modified, DATE '2024-01-01')) AS INT) AS age_days, deprecated, modified FROM p LEFT JOIN r USING (k))
SELECT name, CASE WHEN modified IS NULL THEN NULL ELSE age_days END AS age_days, CASE WHEN coalesce(deprecated, FALSE) THEN 'deprecated' WHEN modified IS NULL THEN 'unknown' WHEN age_days >= 365 THEN 'stale' ELSE 'fresh' END AS status FROM j""")
def agg_package_age(t):
    names = t("part").select(F.concat(F.lit("pkg-"), K().cast("string")).alias("name"), K().alias("k"))
    registry = names.filter("k % 6 <> 0").select("name", F.date_sub(F.lit("2024-01-01").cast("date"), (F.col("k") % 800).cast("int")).alias("modified"), (F.col("k") % 13 == 0).alias("deprecated"))
    return D.package_age(names, registry, "2024-01-01").select("name", F.when(F.col("modified").isNotNull(), F.col("age_days")).alias("age_days"), "status")


# --- history ----------------------------------------------------------------------------------


def changes(t):
    return t("lineitem").select(F.col("l_orderkey").alias("hash"), F.col("l_partkey").alias("path"))


@query("agg_hotspots", "SELECT l_partkey AS path, count(DISTINCT l_orderkey) AS commits FROM lineitem GROUP BY 1 ORDER BY commits DESC, path LIMIT 50")
def agg_hotspots(t):
    return H.hotspots(changes(t), 50)


@query("join_cochange", """WITH c AS (SELECT DISTINCT l_orderkey AS hash, l_partkey AS path FROM lineitem), o AS (SELECT path, hash FROM c WHERE hash IN (SELECT hash FROM c WHERE path = 7) AND path <> 7),
r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY hash) AS r FROM o) SELECT path, count(*) AS commits, string_agg(CASE WHEN r <= 5 THEN CAST(hash AS VARCHAR) END, ',' ORDER BY hash) AS sample FROM r GROUP BY path""")
def join_cochange(t):
    return H.cochange(changes(t), 7)


@query("agg_blame", """WITH l AS (SELECT l_partkey AS file, o_custkey AS author, o_orderdate AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey), p AS (SELECT file, author, count(*) AS lines, max(ts) AS last_at FROM l GROUP BY ALL)
SELECT file, author, lines, lines / sum(lines) OVER (PARTITION BY file) AS share, row_number() OVER (PARTITION BY file ORDER BY lines DESC, last_at DESC, author) AS rank FROM p""")
def agg_blame(t):
    lines = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").alias("file"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("at"))
    return H.blame_summary(lines).drop("last_at")


@query("win_fill_forward", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN substr(text, 1, 20) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS header FROM conversations")
def win_fill_forward(t):
    rows = t("conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.substring("text", 1, 20)).alias("header"))
    return H.filled_forward(rows, "conv_id", "turn", "header")


# --- evaluation -------------------------------------------------------------------------------


def judged(t, seed: int):
    """Per source: the good documents are expected; those returned are ranked by a hash."""
    docs = t("documents").select("doc_id", "source")
    expected = docs.join(t("labels").filter("quality = 1 and toxic = 1"), "doc_id").select(F.col("source").alias("case_id"), F.col("doc_id").alias("path"))
    order = F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(f"-{seed}")))
    returned = docs.select(F.col("source").alias("case_id"), F.col("doc_id").alias("path"), F.row_number().over(Window.partitionBy("source").orderBy(order)).alias("rank"))
    return E.evaluate(expected, returned.filter("rank <= 20"), docs.select(F.col("source").alias("case_id")).distinct())


def judged_sql(seed: int) -> str:
    return f"""(WITH x AS (SELECT source AS case_id, doc_id AS path FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 1), r AS (SELECT source AS case_id, doc_id AS path, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || '-{seed}')) AS rank FROM documents),
h AS (SELECT x.case_id, rank FROM x LEFT JOIN (SELECT * FROM r WHERE rank <= 20) r USING (case_id, path)), b AS (SELECT case_id, count(*) AS expected, count(*) FILTER (rank <= 5) AS h5, count(*) FILTER (rank <= 10) AS h10, min(rank) AS first_rank FROM h GROUP BY case_id)
SELECT case_id, coalesce(expected, 0) AS expected, CASE WHEN expected > 0 THEN floor(h5 / expected * 10000.0 + 0.5) / 10000.0 ELSE 0.0 END AS recall5, CASE WHEN expected > 0 THEN floor(h10 / expected * 10000.0 + 0.5) / 10000.0 ELSE 0.0 END AS recall10, first_rank, coalesce(h10, 0) > 0 AS passed, coalesce(1.0 / first_rank, 0.0) AS reciprocal FROM (SELECT DISTINCT source AS case_id FROM documents) LEFT JOIN b USING (case_id))"""


@query("agg_recall_at_k", f"SELECT * FROM {judged_sql(1)}")
def agg_recall_at_k(t):
    return judged(t, 1)


TOTALS = "count(*) AS cases, count(*) FILTER (NOT passed) AS failed, floor(avg(recall5) * 100 * 10.0 + 0.5) / 10.0 AS recall5_pct, floor(avg(recall10) * 100 * 10.0 + 0.5) / 10.0 AS recall10_pct, floor(avg(reciprocal) * 10000.0 + 0.5) / 10000.0 AS mrr"


@query("agg_mrr", f"SELECT {TOTALS} FROM {judged_sql(1)}")
def agg_mrr(t):
    return E.run_totals(judged(t, 1))


@query("agg_run_compare", f"WITH a AS (SELECT {TOTALS} FROM {judged_sql(1)}), b AS (SELECT {TOTALS} FROM {judged_sql(2)}), d AS (SELECT {', '.join(f'b.{c} - a.{c} AS d_{c}' for c in ('cases', 'failed', 'recall5_pct', 'recall10_pct', 'mrr'))} FROM a, b) SELECT *, d_failed > 0 OR d_recall5_pct < 0 OR d_recall10_pct < 0 OR d_mrr < 0 AS regression FROM d")
def agg_run_compare(t):
    rows = judged(t, 1).withColumn("run_id", F.lit("a")).unionByName(judged(t, 2).withColumn("run_id", F.lit("b")))
    return E.compare_runs(E.run_totals(rows, ["run_id"]), "a", "b")


@query("agg_dataset_list", "SELECT source AS dataset, count(*) AS cases, count(*) FILTER (quality = 1) AS reviewed, count(*) FILTER (quality = 0) AS candidate, CAST(sum(doc_id % 4) AS BIGINT) AS expected_paths FROM documents JOIN labels USING (doc_id) GROUP BY source")
def agg_dataset_list(t):
    cases = t("documents").join(t("labels"), "doc_id").select(F.col("source").alias("dataset"), F.when(F.col("quality") == 1, "reviewed").otherwise("candidate").alias("status"), F.array_repeat(F.lit("p"), (F.col("doc_id") % 4).cast("int")).alias("expected_paths"))
    return E.datasets(cases)


@query("sink_upsert_case", "SELECT doc_id AS case_id, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 5 END AS created_at, CASE WHEN doc_id % 2 = 0 THEN 5 ELSE 1 END AS updated_at, CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE source END AS note FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def sink_upsert_case(t):
    d = t("documents").select(F.col("doc_id").alias("case_id"), F.col("source").alias("note"))
    old = d.filter("case_id % 3 = 0").withColumns({"created_at": F.lit(1), "updated_at": F.lit(1)})
    new = d.filter("case_id % 2 = 0").withColumns({"note": F.lit("new"), "created_at": F.lit(5), "updated_at": F.lit(5)})
    return E.upsert_cases(old, new)
