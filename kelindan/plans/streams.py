"""Queries that run as streams over what is landed, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelindan.streaming import feeds


def _events(spark: SparkSession, d: str) -> DataFrame:
    return feeds.read_table_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    seen = feeds.first_seen(_events(spark, d).select("user_id", "event_type"), ["user_id", "event_type"])
    return feeds.run_available(seen, "dedup")


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts of the windows that the watermark, two days behind the newest row, has closed."""
    daily = feeds.run_available(feeds.windowed_counts(_events(spark, d), "ts", "1 day", "2 days", "event_type"), "windows")
    return daily.select(F.col("begins").cast("date").cast("string").alias("day"), "event_type", "n")


def stream_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select("user_id", "event_id", (F.col("event_type") == "error").alias("bad"))
    runs = feeds.run_available(feeds.failure_islands(rows, "user_id", "event_id", "bad"), "runs")
    return runs.select("user_id", "run", "length")


QUERIES = {"stream_dedup": stream_dedup, "stream_windows": stream_windows, "stream_runs": stream_runs}

ORACLES = {
    "stream_dedup": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_windows": """SELECT ts::DATE::VARCHAR AS day, event_type, count(*) AS n FROM events
        WHERE ts::DATE + 1 <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY GROUP BY ALL""",
    "stream_runs": """WITH m AS (SELECT user_id, event_id, event_type = 'error' AS bad, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run,
            max(CASE WHEN event_type <> 'error' THEN event_id END) OVER (PARTITION BY user_id) AS last_ok FROM events)
        SELECT user_id, run::BIGINT AS run, count(*) AS length FROM m WHERE bad GROUP BY user_id, run, last_ok HAVING count(*) >= 3 AND max(event_id) < last_ok""",
}
