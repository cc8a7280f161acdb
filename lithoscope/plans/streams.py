"""Queries that run as Structured Streaming, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithoscope.streaming import pipeline


def _events(spark, d):
    return pipeline.file_stream(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_id", "user_id", "event_type", "value")


def stream_event_counts(spark, d):
    """Complete-mode counts per tumbling day and type."""
    s = _events(spark, d).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n")).select(F.unix_seconds("window.start").alias("day"), "event_type", "n")
    return pipeline.drain_to_table(spark, s, "event-counts", "complete")


def stream_rate(spark, d):
    s = _events(spark, d).groupBy(F.window("ts", "2 hours", "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.unix_seconds("window.end").alias("at"), "event_type", "n")
    return pipeline.drain_to_table(spark, s, "event-rate", "complete")


def stream_debounced(spark, d):
    s = _events(spark, d).groupBy("user_id", F.session_window("ts", "300 seconds")).agg(F.max_by("event_type", F.struct("ts", "event_type")).alias("event"), F.count("*").alias("n")).select("user_id", F.unix_micros("session_window.start").alias("began"), "event", "n")
    return pipeline.drain_to_table(spark, s, "debounced", "complete")


QUERIES = {f.__name__: f for f in (stream_event_counts, stream_rate, stream_debounced)}
SQL = {
    "stream_event_counts": "SELECT epoch_us(ts) // 86400000000 * 86400 AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_rate": "SELECT (epoch_us(ts) // 3600000000 + k) * 3600 AS at, event_type, count(*) AS n FROM events, (VALUES (1), (2)) t(k) GROUP BY ALL",
    "stream_debounced": "WITH e AS (SELECT user_id, epoch_us(ts) AS us, event_type FROM events), f AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) >= 300000000 OR lag(us) OVER (PARTITION BY user_id ORDER BY us) IS NULL THEN 1 ELSE 0 END AS f FROM e), g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY us) AS g FROM f) SELECT user_id, min(us) AS began, arg_max(event_type, (us, event_type)) AS event, count(*) AS n FROM g GROUP BY user_id, g",
}
