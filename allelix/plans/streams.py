"""Queries that run as streams over the table of events; their oracles are batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from allelix.plans.fixtures import table
from allelix.plans.registry import query
from allelix.streaming import events as E


def _events(spark, sf_dir):
    return E.stream(spark, f"{sf_dir}/events.parquet")


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    return E.run_to_end(E.tumbling_counts(_events(spark, sf_dir), "1 day"), "complete").select(E.wall_time(F.col("start")).alias("start"), "event_type", "n")


@query("SELECT w AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '12 hours', ts), time_bucket(INTERVAL '12 hours', ts) - INTERVAL '12 hours']) AS w FROM events) GROUP BY 1")
def stream_sliding(spark, sf_dir):
    return E.run_to_end(E.sliding_counts(_events(spark, sf_dir), "24 hours", "12 hours"), "complete").select(E.wall_time(F.col("start")).alias("start"), "n")


@query("SELECT event_type, count(*) AS n FROM (SELECT DISTINCT ON (event_id) * FROM events) GROUP BY 1")
def stream_distinct(spark, sf_dir):
    return E.run_to_end(E.distinct_events(_events(spark, sf_dir)), "append").groupBy("event_type").agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new ROWS UNBOUNDED PRECEDING) AS s FROM f) SELECT user_id, min(ts) AS start, count(*) AS n FROM i GROUP BY user_id, s""")
def event_sessions(spark, sf_dir):
    return E.sessions(table(spark, sf_dir, "events"), "6 hours")
