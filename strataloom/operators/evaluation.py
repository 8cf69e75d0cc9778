"""Retrieval evaluation: recall at k, reciprocal rank, run comparison, imported feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.functions.text import round_to


def evaluate(expected: DataFrame, returned: DataFrame, cases: DataFrame) -> DataFrame:
    """Per case: recall@5 and @10, first rank, pass. expected (case_id, path), returned (case_id, path, rank from 1)."""
    first = returned.groupBy("case_id", "path").agg(F.min("rank").alias("rank"))
    # ranks count distinct paths, so earlier repeats must not push a path down
    hits = expected.select("case_id", "path").distinct().join(first, ["case_id", "path"], "left")
    by = hits.groupBy("case_id").agg(F.count("*").alias("expected"), F.count_if(F.col("rank") <= 5).alias("hits5"), F.count_if(F.col("rank") <= 10).alias("hits10"), F.min("rank").alias("first_rank"))
    out = cases.select("case_id").join(by, "case_id", "left").fillna(0, ["expected", "hits5", "hits10"])
    share = lambda h: F.when(F.col("expected") > 0, round_to(F.col(h) / F.col("expected"), 4)).otherwise(0.0)
    return out.select("case_id", "expected", share("hits5").alias("recall5"), share("hits10").alias("recall10"), "first_rank", (F.col("hits10") > 0).alias("passed"), F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("reciprocal"))


def run_totals(results: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return results.groupBy(*(keys or [])).agg(
        F.count("*").alias("cases"), F.count_if(~F.col("passed")).alias("failed"), round_to(F.avg("recall5") * 100, 1).alias("recall5_pct"), round_to(F.avg("recall10") * 100, 1).alias("recall10_pct"), round_to(F.avg("reciprocal"), 4).alias("mrr")
    )


def compare_runs(totals: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """Candidate minus baseline and whether the candidate holds; totals has run_id, one row a run."""
    names = ["cases", "failed", "recall5_pct", "recall10_pct", "mrr"]
    at = lambda run, c: F.max(F.when(F.col("run_id") == run, F.col(c)))
    out = totals.agg(*((at(candidate, c) - at(baseline, c)).alias("d_" + c) for c in names))
    return out.withColumn("regression", (F.col("d_failed") > 0) | (F.col("d_recall5_pct") < 0) | (F.col("d_recall10_pct") < 0) | (F.col("d_mrr") < 0))


def datasets(cases: DataFrame) -> DataFrame:
    return cases.groupBy("dataset").agg(F.count("*").alias("cases"), F.count_if(F.col("status") == "reviewed").alias("reviewed"), F.count_if(F.col("status") == "candidate").alias("candidate"), F.sum(F.size("expected_paths")).alias("expected_paths"))


def upsert_cases(old: DataFrame, new: DataFrame) -> DataFrame:
    """Newest row of each case_id with the oldest created_at."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    keep = [c for c in old.columns if c not in ("case_id", "created_at")]
    return rows.groupBy("case_id").agg(F.min("created_at").alias("created_at"), F.max_by(F.struct(*keep), F.struct("_new", "updated_at")).alias("r")).select("case_id", "created_at", "r.*")
