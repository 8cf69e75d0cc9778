"""The daily roll-up as a stream: append-only logs in, counters per day and service out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(path)


def daily(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Calls, failures and saved tokens per day and service; state is a row for each open day and service."""
    day = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "service")
    out = day.agg(F.count("*").alias("calls"), F.count_if(~F.coalesce("ok", F.lit(True))).alias("failed"), F.sum(F.coalesce("saved_tokens", F.lit(0.0))).alias("saved_tokens"))
    return out.select(F.to_date("w.start").alias("day"), "service", "calls", "failed", "saved_tokens")


def write(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    return stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
