"""Streaming forms on the events table, read as a table for comparison; the tests run them as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators.merge import latest
from graphloom.plans.registry import query
from graphloom.plans.trade import load
from graphloom.streaming import pipelines


@query(
    """WITH o AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS opens FROM events),
g AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM o)
SELECT user_id, max(ts) AS at, arg_max(event_type, (ts, event_type)) AS value, count(*) AS n FROM g GROUP BY user_id, run"""
)
def st_debounce(spark, d):
    return pipelines.debounce(load(spark, d, "events"), "user_id", "ts", "event_type", "2 hours")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def st_tumbling_counts(spark, d):
    return pipelines.tumbling_counts(load(spark, d, "events"), "ts", "event_type")


@query("SELECT user_id, event_type, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def st_upsert(spark, d):
    return latest(load(spark, d, "events").select("user_id", "event_type", "ts", "event_id"), ("user_id", "event_type"), "ts").select("user_id", "event_type", "ts", F.col("event_id"))


@query("SELECT user_id, event_type, last_at, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_at DESC, event_type) AS rank FROM (SELECT user_id, event_type, max(ts) AS last_at FROM events GROUP BY ALL)) WHERE rank <= 3")
def st_history_state(spark, d):
    return pipelines.history(load(spark, d, "events"), "user_id", "ts", "event_type", 3)
