"""Queries over streams, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from ..streaming import monitor
from .base import query

S = SparkSession


def _events(spark: S, d: str) -> DataFrame:
    log = monitor.tail(spark, f"{d}/events.parquet", table(spark, d, "events").schema)
    return log.withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1", base=False)
def stream_totals(spark: S, d: str) -> DataFrame:
    totals = _events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return monitor.run_to_end(totals, "complete", "totals")


@query("SELECT event_id, unnest(list_filter([CASE WHEN value > 50 THEN 'large' END, CASE WHEN event_type = 'error' THEN 'error' END], lambda x: x IS NOT NULL)) AS flag FROM events", base=False)
def stream_flags(spark: S, d: str) -> DataFrame:
    found = monitor.flags(_events(spark, d), {"large": F.col("value") > 50, "error": F.col("event_type") == "error"}, ["event_id"])
    return monitor.run_to_end(found, "append", "flags")


@query("SELECT start, event_type, n, total FROM (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2) WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE", base=False)
def stream_windows(spark: S, d: str) -> DataFrame:
    """Windows that the watermark has closed by the end of the log."""
    return monitor.run_to_end(monitor.windowed_counts(_events(spark, d), "ts", "event_type", "value"), "append", "windows")


@query("SELECT user_id, count(*) AS sessions FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR ts - b > INTERVAL 30 MINUTE GROUP BY 1", base=False)
def sessions(spark: S, d: str) -> DataFrame:
    e = table(spark, d, "events")
    s = e.groupBy("user_id", F.session_window("ts", "30 minutes 1 microsecond")).agg(F.count(F.lit(1)).alias("n"))
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"))
