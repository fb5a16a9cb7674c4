"""Queries over event streams, with the SQL of their batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from notarium.sources.tables import table
from notarium.streaming.watch import stream_activity

QUERIES, SQL = {}, {}


def session_window_events(spark, folder):
    """Sessions of each user's events with gaps of 30 minutes at most."""
    events = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = stream_activity(events)
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("begin", "end")})


def hourly_events(spark, folder):
    """Events per hour and type."""
    return table(spark, folder, "events").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("hour"), "event_type").agg(
        F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value")
    )


QUERIES = {"session_window_events": session_window_events, "hourly_events": hourly_events}
SQL = {
    "session_window_events": """WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
  SELECT user_id, min(ts) AS begin, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS events, round(sum(value), 4) AS value FROM s GROUP BY user_id, n""",
    "hourly_events": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY ALL",
}
