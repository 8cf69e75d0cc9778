"""Comparing two states of something: lockfiles, mirrors, registries, contracts, environments, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.text import major

LICENSES = ("agpl", "gpl-3.0", "sspl", "commons-clause")  # fixed: disallowed unless a caller says otherwise


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of the highest order for each key, without a sort of the group."""
    value = F.max_by(F.struct(*rows.columns), order).alias("row")
    return rows.groupBy(F.col(key).alias("_key")).agg(value).select("row.*")


def lockfile_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Added, removed and changed packages (name, version, place), and whether the major version rose."""
    side = lambda frame, p: last_wins(frame, "name", "place").select("name", F.col("version").alias(p))
    both = side(old, "old_version").join(side(new, "new_version"), "name", "full_outer")
    kind = F.when(F.col("old_version").isNull(), "added").when(F.col("new_version").isNull(), "removed").when(F.col("old_version") != F.col("new_version"), "changed")
    out = both.withColumn("change", kind).filter("change is not null")
    return out.withColumn("major_bump", F.coalesce((F.col("change") == "changed") & (major(F.col("new_version")) > major(F.col("old_version"))), F.lit(False)))


def mirror_diff(docs: DataFrame, mirrors: DataFrame) -> DataFrame:
    """docs (path, title, hash) against mirrors (path, title, hash); titles and hashes are compared only where a mirror has them."""
    m = mirrors.select(F.col("path").alias("m_path"), F.col("title").alias("m_title"), F.col("hash").alias("m_hash"))
    both = docs.join(m, docs.path == m.m_path, "full_outer")
    given = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    issues = F.array_compact(
        F.array(
            F.when(F.col("m_path").isNull(), "missing_mirror"), F.when(F.col("path").isNull(), "missing_source"),
            F.when(F.col("path").isNotNull() & given("m_title") & (F.col("m_title") != F.col("title")), "title_mismatch"), F.when(F.col("path").isNotNull() & given("m_hash") & (F.col("m_hash") != F.col("hash")), "stale"),
        )
    )
    return both.select(F.coalesce("path", "m_path").alias("path"), issues.alias("issues"))


def mirror_plan(compared: DataFrame) -> DataFrame:
    """One update a path: create, archive, refresh, else retitle."""
    has = lambda x: F.array_contains("issues", x)
    update = F.when(has("missing_mirror"), "create").when(has("missing_source"), "archive").when(has("stale"), "refresh").when(has("title_mismatch"), "retitle")
    return compared.withColumn("update", update).filter("update is not null").select("path", "update")


def registry_diff(docs: DataFrame, registry: DataFrame) -> DataFrame:
    """Paths missing from a registry that is not empty, and registered paths without a document."""
    missing = docs.select("path").join(registry.select("path"), "path", "left_anti").withColumn("issue", F.lit("missing"))
    some = registry.limit(1).select(F.lit(1).alias("some"))
    missing = missing.join(F.broadcast(some)).drop("some")
    stale = registry.select("path").join(docs.select("path"), "path", "left_anti").withColumn("issue", F.lit("stale"))
    return missing.unionByName(stale)


def set_diff(used: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """Keys of one side only."""
    one = lambda a, b, name: a.select(key).distinct().join(b.select(key), key, "left_anti").withColumn("issue", F.lit(name))
    return one(used, declared, "undeclared").unionByName(one(declared, used, "unused"))


def contract_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Removed operations, removed schemas and newly required fields; rows (kind, key, required array)."""
    k = ["kind", "key"]
    gone = old.join(new, k, "left_anti").select("kind", "key", F.lit("removed").alias("change"), F.lit(None).cast("string").alias("field"))
    o = old.select(*k, F.col("required").alias("before"))
    more = new.join(o, k).select("kind", "key", F.lit("newly_required").alias("change"), F.explode(F.array_except("required", "before")).alias("field"))
    return gone.unionByName(more)


def breaking_changes(changes: DataFrame, most: int = 10) -> DataFrame:
    """At most so many of each change, with a severity."""
    w = Window.partitionBy("change").orderBy("kind", "key", F.coalesce("field", F.lit("")))
    ranked = changes.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
    return ranked.withColumn("severity", F.when(F.col("change") == "removed", "high").otherwise("medium"))


def snapshot_delta(rows: DataFrame, metrics: list[str], old: str, new: str) -> DataFrame:
    """Metrics that rose between two snapshots (rows: snapshot and the metrics)."""
    long = rows.unpivot(["snapshot"], metrics, "metric", "value")
    by = long.groupBy("metric").agg(F.max(F.when(F.col("snapshot") == old, F.col("value"))).alias("before"), F.max(F.when(F.col("snapshot") == new, F.col("value"))).alias("after"))
    return by.withColumn("delta", F.col("after") - F.col("before")).withColumn("finding", F.col("delta") > 0)


def over_budget(totals: DataFrame, budgets: dict[str, float]) -> DataFrame:
    """(metric, actual, allowed, over_by) of the columns beyond their budget."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("actual"), F.lit(float(b)).alias("allowed")) for m, b in budgets.items())))
    return totals.select(each.alias("x")).select("x.*").filter("actual > allowed").withColumn("over_by", F.col("actual") - F.col("allowed"))


def resolved_kind(resolved: Column) -> Column:
    r = F.lower(F.coalesce(resolved, F.lit("")))
    return F.when(r == "", "missing").when(r.startswith("git"), "git").when(r.startswith("file:"), "file").when(r.startswith("link:"), "link").when(r.startswith("http:"), "http").when(r.startswith("https://registry.npmjs.org"), "npm").when(r.startswith("https:"), "https").otherwise("other")


def license_disallowed(license: Column, disallowed: tuple[str, ...] = LICENSES) -> Column:
    low = F.lower(license)
    out = F.lit(False)
    for x in disallowed:
        out = out | F.coalesce(low.contains(x), F.lit(False))
    return out


def supply_flags(packages: DataFrame) -> DataFrame:
    """Flags of packages (name, version, license, resolved, integrity, has_install_script)."""
    kind = resolved_kind(F.col("resolved"))
    flags = F.array_compact(
        F.array(
            F.when(F.coalesce("license", F.lit("")) == "", "missing-license"), F.when(license_disallowed(F.col("license")), "disallowed-license"), F.when(kind.isin("git", "file", "link", "http", "other"), F.concat(kind, F.lit("-source"))),
            F.when(kind == "missing", "missing-resolved"), F.when(F.coalesce("integrity", F.lit("")) == "", "missing-integrity"), F.when(F.col("has_install_script"), "install-script"),
        )
    )
    return packages.withColumns({"resolved_kind": kind, "flags": flags})


def package_age(packages: DataFrame, registry: DataFrame, as_of: str, stale_days: int = 365) -> DataFrame:
    """Packages joined with a registry (name, modified, deprecated): stale, deprecated or of unknown age."""
    both = packages.join(registry.select("name", "modified", "deprecated"), "name", "left")
    age = F.datediff(F.lit(as_of).cast("date"), F.to_date("modified"))
    return both.withColumn("age_days", F.when(age.isNotNull(), F.greatest(F.lit(0), age))).withColumn("status", F.when(F.coalesce("deprecated", F.lit(False)), "deprecated").when(F.col("age_days").isNull(), "unknown").when(F.col("age_days") >= stale_days, "stale").otherwise("fresh"))
