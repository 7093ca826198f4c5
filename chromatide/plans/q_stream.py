"""Registered query: streaming metrics."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from chromatide.plans.registry import query
from chromatide.session import scratch_path
from chromatide.streaming.metrics import events_stream, read_table, run_to_table, staged_files, stream_metrics, with_prediction


@contextmanager
def utc(spark):
    """Event times are UTC wall-clock values and windows are aligned in UTC; the session's zone comes back afterwards."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@query("stream_metrics", sql="""
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS label, COUNT(*) AS n,
  SUM(CASE WHEN event_type = substr(event_type, CAST(1 + event_id % 2 AS INT), CAST(3 + event_id % 4 AS INT)) THEN 1 ELSE 0 END) AS n_correct,
  round(SUM(CASE WHEN event_type = substr(event_type, CAST(1 + event_id % 2 AS INT), CAST(3 + event_id % 4 AS INT)) THEN 1 ELSE 0 END)
        / COUNT(*), 6) AS accuracy
FROM events GROUP BY 1, 2""")
def stream_metrics_query(spark, sf):
    with utc(spark):
        agg = stream_metrics(with_prediction(events_stream(spark, sf)), "1 day", "1 day")
        out = scratch_path(spark, "stream_out")
        run_to_table(agg, out, scratch_path(spark, "stream_ckpt"), "complete")
    return spark.read.parquet(out).withColumn("accuracy", F.round("accuracy", 6))


_HIT = "event_type = substr(event_type, CAST(1 + event_id % 2 AS INT), CAST(3 + event_id % 4 AS INT))"


@query("stream_metrics_append", sql=f"""
WITH e AS (SELECT *, date_trunc('day', ts) AS day, max(ts) OVER () AS last,
  date_diff('day', CAST(min(ts) OVER () AS DATE), CAST(ts AS DATE)) AS d,
  date_diff('day', CAST(min(ts) OVER () AS DATE), CAST(max(ts) OVER () AS DATE)) + 1 AS days FROM events)
SELECT strftime(day, '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS label, COUNT(*) AS n, SUM(CASE WHEN {_HIT} THEN 1 ELSE 0 END) AS n_correct,
  round(SUM(CASE WHEN {_HIT} THEN 1 ELSE 0 END) / COUNT(*), 6) AS accuracy
FROM e WHERE NOT (floor(d * 4 / days) = 0 AND event_id % 50 = 0) AND day + INTERVAL 2 DAY <= last GROUP BY 1, 2""")
def stream_metrics_append(spark, sf):
    """Four micro-batches in append mode: windows behind the watermark are emitted once, rows that come behind it are dropped."""
    with utc(spark):
        source = scratch_path(spark, "stream_src")
        events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
        staged_files(events, source)
        stream = (spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source))
        out = scratch_path(spark, "stream_out")
        run_to_table(stream_metrics(with_prediction(stream), "1 day", "1 day"), out, scratch_path(spark, "stream_ckpt"), "append")
    return read_table(spark, out).withColumn("accuracy", F.round("accuracy", 6))
