"""Sinks: appended event lines, artifacts by content, ledgers, links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.functions.text import artifact_key


def append_events(events: DataFrame, path: str, service: str, version: str) -> None:
    events.withColumns({"service": F.lit(service), "version": F.lit(version)}).write.mode("append").json(path)


def write_artifacts(rows: DataFrame, path: str, prefix: str, text: str = "text") -> DataFrame:
    """Write each distinct text under its content key; returns the rows with their key."""
    keyed = rows.withColumn("artifact", artifact_key(prefix, F.col(text)))
    keyed.select("artifact", text).dropDuplicates(["artifact"]).write.mode("append").parquet(path)
    return keyed


def init_ledger(features: DataFrame, existing: DataFrame) -> DataFrame:
    """Features not in the ledger yet, as open; those that are stay as they are."""
    new = features.join(existing.select("feature_id"), "feature_id", "left_anti").select("feature_id", F.lit(False).alias("passed"), F.lit(None).cast("string").alias("evidence"))
    return existing.unionByName(new)


def mark_passed(ledger: DataFrame, marks: DataFrame) -> DataFrame:
    """Flip to passed once, and only with evidence."""
    m = marks.filter("evidence is not null and evidence <> ''").groupBy("feature_id").agg(F.min("evidence").alias("new_evidence"))
    flips = ~F.col("passed") & F.col("new_evidence").isNotNull()
    return ledger.join(m, "feature_id", "left").select("feature_id", (F.col("passed") | flips).alias("passed"), F.when(flips, F.col("new_evidence")).otherwise(F.col("evidence")).alias("evidence"))


def link_registry(existing: DataFrame, new: DataFrame) -> DataFrame:
    return existing.unionByName(new).dropDuplicates(["test_file", "impl_glob"])


def markdown_list(rows: DataFrame, group: str, order: str, text: str, most: int = 20) -> DataFrame:
    """One Markdown list a group, of its first rows."""
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(order)
    top = rows.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most)
    return top.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.col(text).alias("t")))), lambda x: F.concat(F.lit("- "), x["t"])), "\n").alias("markdown"))
