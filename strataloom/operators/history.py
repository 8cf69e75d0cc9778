"""Commit history: hotspots, co-change, blame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hotspots(changes: DataFrame, top: int | None = None) -> DataFrame:
    """Distinct commits of each file, the most first; changes (hash, path)."""
    out = changes.groupBy("path").agg(F.count_distinct("hash").alias("commits")).orderBy(F.desc("commits"), "path")
    return out.limit(top) if top else out


def cochange(changes: DataFrame, target, samples: int = 5) -> DataFrame:
    """Files changed in the same commits as a target: distinct commits, and the first sample hashes.

    The target's commits are few against all changes, so the join filters before it counts; samples are
    taken by rank, not from a collected list of a file's commits.
    """
    of = changes.filter(F.col("path") == target).select("hash").distinct()
    pairs = changes.join(of, "hash", "left_semi").filter(F.col("path") != target).select("path", "hash").distinct()
    w = Window.partitionBy("path").orderBy("hash")
    ranked = pairs.withColumn("rank", F.row_number().over(w))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= samples, F.col("hash")))), lambda x: x.cast("string")), ",")
    return ranked.groupBy("path").agg(F.count("*").alias("commits"), listed.alias("sample"))


def blame_summary(lines: DataFrame) -> DataFrame:
    """Per file and author (file, line, author, at): lines, last time, share, rank by lines and time."""
    per = lines.groupBy("file", "author").agg(F.count("*").alias("lines"), F.max("at").alias("last_at"))
    w = Window.partitionBy("file")
    return per.withColumns({"share": F.col("lines") / F.sum("lines").over(w), "rank": F.row_number().over(w.orderBy(F.desc("lines"), F.desc("last_at"), "author"))})


def filled_forward(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The last value seen so far, as porcelain blame needs for its headers."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(w))
