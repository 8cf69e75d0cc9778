"""Browser traces: failures, slow calls, and what happened around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def network_summary(calls: DataFrame, slow_ms: float = 1000.0) -> DataFrame:
    s = F.col("status")
    return calls.agg(F.count("*").alias("total"), F.count_if(s.between(400, 499)).alias("client_errors"), F.count_if(s >= 500).alias("server_errors"), F.count_if(F.col("duration_ms") >= slow_ms).alias("slow"), F.max("duration_ms").alias("slowest_ms"))


def slowest(calls: DataFrame, least_ms: float = 1000.0, top: int = 10) -> DataFrame:
    return calls.filter(F.col("duration_ms") >= least_ms).orderBy(F.desc("duration_ms"), "call_id").limit(top)


def console_summary(messages: DataFrame) -> DataFrame:
    return messages.groupBy("type").agg(F.count("*").alias("n"), F.min("at_ms").alias("first_ms"))


def around(points: DataFrame, spans: DataFrame, key: str, margin_ms: int = 1500, bucket_ms: int = 60_000) -> DataFrame:
    """Spans (key, span_id, start_ms, end_ms) that overlap a point's window (key, point_id, at_ms ± margin).

    A range join by time buckets: both sides are put into the buckets they touch and meet by equality, and a
    pair counts in the first bucket that both touch, so it is made once.
    """
    bucket = lambda x: F.floor(x / bucket_ms)
    p = points.withColumns({"lo": F.col("at_ms") - margin_ms, "hi": F.col("at_ms") + margin_ms})
    p = p.withColumn("b", F.explode(F.sequence(bucket(F.col("lo")), bucket(F.col("hi")))))
    s = spans.withColumn("b", F.explode(F.sequence(bucket(F.col("start_ms")), bucket(F.greatest("start_ms", "end_ms")))))
    both = p.join(s, [key, "b"]).filter((F.col("end_ms") >= F.col("lo")) & (F.col("start_ms") <= F.col("hi")))
    return both.filter(F.col("b") == F.greatest(bucket(F.col("lo")), bucket(F.col("start_ms")))).drop("b", "lo", "hi")


def merge_actions(rows: DataFrame) -> DataFrame:
    """Rows of one call_id as one: first values in order, earliest start, latest end."""
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("pos", c)))[c].alias(c)
    out = rows.groupBy("call_id").agg(first("api_name"), first("selector"), first("error"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return out.withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))


def failures(actions: DataFrame, console: DataFrame, network: DataFrame) -> DataFrame:
    """(run_id, prio, at_ms, what) of what failed in each run; the least row explains it."""
    a = actions.filter("error is not null").select("run_id", F.lit(0).alias("prio"), F.col("end_ms").alias("at_ms"), F.col("error").alias("what"))
    c = console.filter("type = 'error'").select("run_id", F.lit(1).alias("prio"), "at_ms", F.col("text").alias("what"))
    n = network.filter("status >= 400").select("run_id", F.when(F.col("status") >= 500, 2).otherwise(3).alias("prio"), F.col("end_ms").alias("at_ms"), F.col("url").alias("what"))
    return a.unionByName(c).unionByName(n)


def first_failure(actions: DataFrame, console: DataFrame, network: DataFrame) -> DataFrame:
    """The failure that explains a run: a failed action, else a console error, else a 5xx, a 4xx."""
    w = Window.partitionBy("run_id").orderBy("prio", "at_ms", "what")
    return failures(actions, console, network).withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")
